"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback encodes each word of a text by itself. Characters per token, the share of
byte-fallback tokens and the entropy of the text's token distribution (as a share of the most that so many tokens
can have) are compared with bands of the text's language and script. The bands come from all documents of the
group that pass the base rules: the quartiles, widened by a multiple of the spread between them. The fewer documents of
like length a group has, the nearer its band lies to the wide one of its whole language and script.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from itertools import accumulate, chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store, small
from ._text import words

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: The symbols of the contract.
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id bigint, lang string, script string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double"


def repeat_words(hashes: np.ndarray, window: int) -> int:
    """Words inside windows of so many words that occur twice or more, all occurrences counted."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(n + window, np.int64)
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    np.add.at(again, at, 1)
    np.add.at(again, at + window, -1)
    return int((np.cumsum(again)[: len(hashes)] > 0).sum())


def script_of(text: str) -> str:
    """Latin, or the block of the majority of all letters, by ranges of code points."""
    if text.isascii():
        return "latin"
    seen: Counter[str] = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            seen["latin" if c < "ɐ" else "greek" if c < "Ѐ" else "cyrillic" if c < "԰" else "semitic" if c < "ࠀ" else "indic" if c < "က" else "cjk" if "⺀" <= c < "퟿" else "other"] += k
    return max(sorted(seen), key=seen.__getitem__) if seen else "none"


def summed(keys: np.ndarray) -> np.ndarray:
    """One sorted ``token << 31 | count`` for each token of such keys, with the sum of its counts; no text holds 2**31 of a token."""
    keys = np.sort(keys)
    token = keys >> 31
    first = np.flatnonzero(np.diff(token, prepend=-1))
    return token[first] << 31 | np.add.reduceat(keys & (2**31 - 1), first) if len(first) else keys


class Pieces:
    """Tokens of words, each word encoded by itself and kept in flat arrays.

    Words are taken ``slice`` at a time, whichever texts they are of. All is forgotten before a slice once ``limit`` words
    are held, so the memory is bounded by both. New words are encoded in calls of many, which takes a third of the time
    of a call each.
    """

    def __init__(self, model: str | None = None, limit: int = 400_000, slice: int = 100_000):
        import public_tokenizers
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.limit, self.slice = limit, slice
        self.clear()

    def clear(self) -> None:
        #: Numbers of words by their first occurrence; tokens of word k are ids[ends[k]:ends[k + 1]].
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.ends = array("i"), array("q", [0])

    def tokens(self, texts: np.ndarray, flat: list[str]) -> np.ndarray:
        """The ``summed`` tokens of words of the texts numbered so; a token's number is text * vocabulary + id."""
        if len(self.number) >= self.limit:
            self.clear()
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        new = [*islice(reversed(self.number), len(self.number) - known)][::-1]
        for k in range(0, len(new), 20_000):
            found = self.sp.encode(new[k : k + 20_000], num_threads=1)
            self.ends.extend(islice(accumulate(map(len, found), initial=len(self.ids)), 1, None))
            self.ids.extend(chain.from_iterable(found))
        ids, ends = np.asarray(self.ids), np.asarray(self.ends)
        pairs, times = np.unique(texts * len(self.number) + at, return_counts=True)
        text, word = np.divmod(pairs, len(self.number))
        length = ends[word + 1] - ends[word]
        own = ids[np.repeat(ends[word] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        return summed((np.repeat(text, length) * len(self.is_byte) + own) << 31 | np.repeat(times, length))

    def tally(self, texts: list[list[str]]) -> tuple[list[int], list[int], list[float]]:
        """Tokens, byte-fallback tokens and token entropy (0 for fewer than two tokens) of each of the texts, given by their words."""
        n = len(texts)
        of = np.repeat(np.arange(n), np.fromiter(map(len, texts), np.int64, n))
        flat = chain.from_iterable(texts)
        parts = [self.tokens(of[k : k + self.slice], [*islice(flat, self.slice)]) for k in range(0, len(of), self.slice)]
        keys = summed(np.concatenate(parts)) if parts else of
        text, own = np.divmod(keys >> 31, len(self.is_byte))
        total = keys & (2**31 - 1)
        tokens = np.bincount(text, total, n)
        fallback = np.bincount(text, total * self.is_byte[own], n)
        most = np.log(np.maximum(tokens, 2))
        entropy = np.where(tokens > 1, (most - np.bincount(text, total * np.log(total), n) / np.maximum(tokens, 2)) / most, 0.0)
        return tokens.astype(np.int64).tolist(), fallback.astype(np.int64).tolist(), entropy.tolist()


def lots(rows, chars: int = 500_000, most: int = 1_000):
    """The rows (doc, lang, text) in lists of at most ``most`` rows and ``chars`` characters; a longer text is a list of its own."""
    lot, held = [], 0
    for row in rows:
        size = len(row[2] or "")
        if lot and (held + size > chars or len(lot) == most):
            yield lot
            lot, held = [], 0
        lot.append(row)
        held += size
    if lot:
        yield lot


def measure(batches, model: str | None, min_words: int, window: int, repeat_percent: int):
    pieces = Pieces(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("script", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("n_tokens", pa.int64()), *((n, pa.float64()) for n in MEASURES)])
    for batch in batches:
        rows = []
        for lot in lots(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            split = [words(text) for _, _, text in lot]
            for (doc, lang, text), w, tokens, fallback, entropy in zip(lot, split, *pieces.tally(split), strict=True):
                text = text or ""
                seen: set[str] = set()
                dup = 0
                for line in text.split("\n"):
                    if line in seen:
                        dup += 1
                    elif line.strip(" \t\n\v\f\r"):
                        seen.add(line)
                chars, symbols = sum(map(len, w)), sum(map(text.count, SYMBOLS))
                again = repeat_words(np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64), window)
                failed = len(w) < min_words or 100 * again > repeat_percent * len(w)
                rows.append((doc, lang, script_of(text), len(w), chars, symbols, dup, again, failed, tokens, chars / tokens if tokens else 0.0, fallback / tokens if tokens else 0.0, entropy))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def bands(rows: DataFrame, keys: list[str], spread: float, least: dict[str, float], prefix: str) -> DataFrame:
    """Limits of each measure by group, and the size of the group."""
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 1000).alias(f"q_{m}") for m in MEASURES]
    out = rows.groupBy(*keys).agg(F.count("*").alias(f"{prefix}k"), *quartiles)
    limits = []
    for m in MEASURES:
        low, high = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        margin = F.greatest(spread * (high - low), F.lit(least[m]))
        limits += [(low - margin).alias(f"{prefix}low_{m}"), (high + margin).alias(f"{prefix}high_{m}")]
    return out.select(*keys, f"{prefix}k", *limits)


def limits(passed: DataFrame, spread: float, prior_rows: float) -> DataFrame:
    """low and high of each measure by lang_group, script and octave: the mean of the fine and the wide band, weighted by
    the number of documents of the fine group and by ``prior_rows``."""
    fine = bands(passed, ["lang_group", "script", "octave"], spread, {"chars_per_token": 0.02, "byte_share": 0.02, "token_entropy": 0.01}, "fine_")
    wide = bands(passed, ["lang_group", "script"], 2 * spread, {"chars_per_token": 0.5, "byte_share": 0.05, "token_entropy": 0.15}, "wide_")
    near = F.col("fine_k") / (F.col("fine_k") + prior_rows)
    mean = [(near * F.col(f"fine_{side}_{m}") + (1 - near) * F.col(f"wide_{side}_{m}")).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")]
    return fine.join(wide, ["lang_group", "script"]).select("lang_group", "script", "octave", *mean)


def fertility_rules(docs: DataFrame, spread: float = 3.0, prior_rows: float = 30, min_words: int = 20, window: int = 8, repeat_percent: int = 30, model: str | None = None, store: Store | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the counts, the measures and the verdict ``kept``.

    The measures of a short text scatter more and its entropy is higher, so a band is that of the documents of like
    length (the same power of two of words) in the language and script, all of them that pass the base rules. It
    reaches ``spread`` times the quartile distance below the first and above the third quartile, and a little beyond
    them at least, so that a uniform group rejects nothing. The wide band is that of the whole language and script, with
    twice the spread and a wide least margin; a band is the mean of both, where the wide one weighs as ``prior_rows``
    documents of like length. A null language is a group of its own. Null and empty texts have no words and fail the
    base rules, as do documents under ``min_words`` words and those with over ``repeat_percent`` percent of repeated
    words. Rows that repeat a doc_id are judged each; ties cannot arise; an empty table gives an empty result. Other
    columns are not read. Texts of any length are measured whole, short ones in lots and long ones by slices of their words
    that are added up, and by the hashes of their windows. The bands are broadcast if they are small, which they are for any sane number of languages.
    """
    store = store or Store(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = store.table(src.mapInArrow(lambda it: measure(it, model, min_words, window, repeat_percent), SCHEMA), "quality")
    rows = rows.withColumns({"lang_group": F.struct(F.col("lang").isNull().alias("none"), F.coalesce("lang", F.lit("")).alias("name")), "octave": F.floor(F.log2(F.greatest("n_words", F.lit(1))))})
    found = store.table(limits(rows.filter("not base_failed"), spread, prior_rows), "bands")
    judged = rows.join(small(found, F.length("lang_group.name") + 96), ["lang_group", "script", "octave"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return judged.select(*(f.split()[0] for f in SCHEMA.split(", ")), *(f"{side}_{m}" for m in MEASURES for side in ("low", "high")), kept.alias("kept"))
