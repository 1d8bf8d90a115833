"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs of other scripts and full-width forms to Latin letters, digits and signs
that stand for letters inside a word to those letters. Every word then stands between single spaces, so a pattern can
be a whole word (`` idiot ``) or the start of one (`` vequ``). The weights of all matches, without those inside an
exception phrase, are divided by the length in words; a logistic function of that gives the score.

The lexicon is learnt: word starts that occur in toxic training texts and hardly in others, each weighted by its
log-odds.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import Store, fresh
from ._text import words

# Letters of other scripts that look like Latin ones, and what each stands for.
LOOKS_LIKE = dict(zip("аеорсухіјѕԁһкмтвнгпαορυνικετω", "aeopcyxijsdhkmtbhrnaopuviketw", strict=True))
# Digits and signs that stand for letters.
DIGITS = dict(zip("013457@$!|", "oieastasil", strict=True))
# Phrases in which a word of the lexicon means no offence.
EXCEPTIONS = ("trash can", "trash cans", "clown fish", "class clown", "scum line", "sore loser")

_TABLE = str.maketrans(LOOKS_LIKE)
_DIGITS = str.maketrans(DIGITS)
_EDGE = re.compile(r"[^\w@$]+|_+")
_OTHER = re.compile("[\u0370-\u052f]")


def fold(text: str | None) -> str:
    """The text's words, folded, with one space before, between and after."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        if _OTHER.search(text):
            text = text.translate(_TABLE)
    out = []
    for w in words(text):
        if not w.isalpha():
            w = w.strip(".,;:?\"'()[]{}<>*#%&-_=+/\\~`^!")
            if not w.isalpha() and any(c.isalpha() for c in w):
                w = w.translate(_DIGITS)
                w = _EDGE.sub(" ", w).strip()
        if w:
            out.append(w)
    return f" {' '.join(out)} "


@dataclass
class Lexicon:
    """Patterns on folded text with weights, exception phrases, and the logistic function of the weight a word."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    bias: float = -1.0
    base: int = 50

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        if len(a):
            a.make_automaton()
        return a if len(a) else None

    def density(self, automaton, text: str | None) -> float:
        """Weight of the matches for each ``base`` words, or for the whole of a shorter text."""
        folded = fold(text)
        if automaton is None or not self.weights:
            return 0.0
        hits, safe = [], []
        for end, (n, w) in automaton.iter(folded):
            (safe if w is None else hits).append((end - n + 1, end, w))
        total = sum(w for s, e, w in hits if not any(a <= s and e <= b + 1 for a, b, _ in safe))
        return total * self.base / max(self.base, folded.count(" ") - 1)

    def score(self, density: float) -> float:
        x = self.bias + self.slope * math.log1p(max(0.0, density))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def starts(folded: str, least: int, most: int) -> set[str]:
    out = set()
    for w in set(folded.split(" ")):
        if len(w) >= least and w.isalpha():
            out.update(" " + w[:k] for k in range(least, min(len(w), most) + 1))
            out.add(f" {w} ")
    return out


def sample_features(batches, least: int, most: int):
    """Arrow batches of (toxic, text) to counts by pattern of the partition's texts."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[toxic].update(starts(fold(text), least, most))
    names = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(names), 10_000):
        part = names[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][p] for p in part], pa.int64()), pa.array([counts[0][p] for p in part], pa.int64())], ["pattern", "pos", "neg"])


def sketches(batches):
    """Arrow batches with the text last: the text becomes the MinHash signature of its 5-word shingles."""
    from .jaccard import BANDS, ROWS, multipliers, shingles, signature, word_hashes

    cache, mult = word_hashes(), multipliers(BANDS * ROWS)
    for batch in batches:
        sigs = [signature(shingles(t, 5, cache), mult).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sigs, pa.binary())], [*batch.schema.names[:-1], "sig"])


def without_copies(sigs: np.ndarray, alike: float = 0.8) -> list[int]:
    """The rows, in order, that share less than ``alike`` of their MinHash values with every row kept before them. Rows that
    share none of the 24 bands count as less alike."""
    from .jaccard import band_keys

    keys, kept, held = band_keys(sigs).tolist(), [], {}
    for i, own in enumerate(keys):
        near = sorted({j for band, key in enumerate(own) for j in held.get((band, key), ())})
        if near and ((sigs[near] == sigs[i]).mean(axis=1) >= alike).any():
            continue
        kept.append(i)
        for band, key in enumerate(own):
            held.setdefault((band, key), []).append(i)
    return kept


def choose(found: list[tuple[str, int, int]], n_pos: int, n_neg: int, keep: float = 0.8) -> dict[str, float]:
    """The patterns to use: along each word, the longest start that still has most of the toxic texts of the first
    that is clean; and the whole words that none of these covers. Weight: log-odds with half a text added to each count."""
    pos = {p: (a, b) for p, a, b in found}
    weight = lambda p: math.log((pos[p][0] + 0.5) / (n_pos + 1)) - math.log((pos[p][1] + 0.5) / (n_neg + 1))
    followers: dict[str, list[str]] = {}
    for p in pos:
        followers.setdefault(p[:-1], []).append(p)
    out: dict[str, float] = {}
    for p in sorted((p for p in pos if not p.endswith(" ")), key=len):
        if any(p[:k] in pos and not p[:k].endswith(" ") for k in range(2, len(p))):
            continue  # a shorter start is in the list
        best = p
        while longer := [q for q in followers.get(best, ()) if pos[q][0] >= keep * pos[p][0]]:
            best = max(longer, key=lambda q: (pos[q][0], q))
        out[best] = weight(best)
    for p in (p for p in pos if p.endswith(" ")):
        if not any(p[:k] in out for k in range(2, len(p) + 1)):
            out[p] = weight(p)
    return out


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 3000, least: int = 3, most: int = 12, min_texts: int = 4, min_share: float = 0.01, min_ratio: float = 50, max_patterns: int = 5000, store: Store | None = None) -> Lexicon:
    """Learn a lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``per_class`` labelled documents of each class serve, those with the least hashes of their ids; of near
    copies among them (see :func:`without_copies`) that with the least doc_id. A pattern needs ``min_texts`` toxic texts,
    ``min_share`` of them, and at least ``min_ratio`` times the rate of the others; the ``max_patterns`` heaviest are the
    lexicon, whose size that bounds. Without toxic labels the lexicon is empty. An id labelled both ways is toxic; null ids and
    labels are passed over; of several texts of one id that with the least hash serves, so the sample has at most
    ``2 * per_class`` rows whatever repeats. Null texts have no words, long ones serve whole. Tables with the same rows
    give the same lexicon, however they are partitioned. Other columns are not read.
    """
    store = store or Store(docs.sparkSession)
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    key = F.xxhash64("doc_id", F.lit("sample"))
    picked = None
    for c in (0, 1):
        part = marked.filter(F.col("toxic") == c).orderBy(key, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    picked = store.table(picked, "picked")  # at most 2 * per_class rows
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("hash", F.xxhash64("text"))
    texts = store.table(texts.groupBy("doc_id", "toxic").agg(F.min(F.struct("hash", "text"))["text"].alias("text")), "sample")
    signed = texts.mapInArrow(sketches, "doc_id bigint, toxic int, sig binary").orderBy("doc_id").collect()  # at most 2 * per_class rows
    ids = []
    for c in (0, 1):
        own = [r for r in signed if r["toxic"] == c]
        ids += [own[i]["doc_id"] for i in without_copies(np.stack([np.frombuffer(r["sig"], np.uint32) for r in own]))] if own else []
    kept = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")
    single = texts.join(F.broadcast(kept), "doc_id")
    classes = {r["doc_id"]: r["toxic"] for r in signed}
    n_pos = sum(classes[i] for i in ids)
    n_neg = len(ids) - n_pos
    if not n_pos:
        return Lexicon(bias=-3.0)
    counted = single.select("toxic", "text").mapInArrow(lambda it: sample_features(it, least, most), "pattern string, pos bigint, neg bigint").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    support = max(min_texts, min_share * n_pos)
    odds = (F.col("pos") + 0.5) / (n_pos + 1) >= min_ratio * F.col("neg") / (n_neg + 1)
    strong = counted.filter((F.col("pos") >= support) & odds).orderBy(F.desc("pos"), "neg", "pattern").limit(max_patterns * (most + 1))
    found = [(r["pattern"], r["pos"], r["neg"]) for r in strong.collect()]
    weights = dict(sorted(choose(found, n_pos, n_neg).items(), key=lambda x: (-x[1], x[0]))[:max_patterns])
    lexicon = Lexicon(weights)
    seen = sorted(single.select("doc_id", "text").mapInArrow(lambda it: densities(it, lexicon), "doc_id bigint, density double").collect())  # at most 2 * per_class rows
    x, y = np.array([math.log1p(r["density"]) for r in seen]), np.array([classes[r["doc_id"]] for r in seen])
    lexicon.slope, lexicon.bias = logistic(x, y)
    return lexicon


def densities(batches, lexicon: Lexicon):
    a = lexicon.automaton()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.density(a, t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "density"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float]:
    """Slope and bias by Newton's method, both classes weighted alike."""
    if not len(x) or y.min() == y.max():
        return 1.0, -1.0
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    a, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (share * (p - y)) + ridge * w
        w = w - np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
    return float(w[0]), float(w[1])


def scored(batches, lexicon: Lexicon, text_at: int, schema: pa.Schema):
    a = lexicon.automaton()
    for batch in batches:
        scores = [lexicon.score(lexicon.density(a, t)) for t in batch.column(text_at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema=schema)


def score(docs: DataFrame, lexicon: Lexicon, name: str = "toxicity") -> DataFrame:
    """``docs`` (text, and whatever else) with a column ``name``, 0 to 1.

    A null or empty text scores what no match scores. Long texts are matched whole. Repeated rows score alike; an
    empty table gives an empty result; a column of that name is replaced.
    """
    docs = docs.drop(name)
    out = T.StructType([*docs.schema.fields]).add(name, T.DoubleType())
    schema, at = to_arrow_schema(out), docs.columns.index("text")
    return docs.mapInArrow(lambda it: scored(it, lexicon, at, schema), out)


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def reject(docs: DataFrame, lexicon: Lexicon, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (text, and whatever else) that score less than ``at``, with their columns as they are.

    Null and empty texts score what no match scores and stay, unless ``at`` is below that. Rows are judged each, so those
    that repeat stay or go together; an empty table gives an empty result."""
    (name,) = fresh(docs, "score")
    return score(docs, lexicon, name).filter(F.col(name) < at).select(*docs.columns)
