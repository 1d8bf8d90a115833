"""Token counts by section, from whole documents encoded once.

The byte-level vocabulary loses nothing, so the byte lengths of a document's tokens add up to their offsets. Sections
are given as byte spans in order; a token goes to the section that holds its first byte (rule ``first``), its last
byte (``last``), or in parts by its bytes in each (``share``). Both lists are sorted, so the interval join is one
search of the boundaries.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id bigint, section bigint, start_char bigint, end_char bigint, n_tokens double, n_crossing bigint, doc_tokens bigint"
RULES = ("first", "last", "share")


def encoder(vocab: str | None):
    import public_tokenizers
    import tiktoken

    with open(vocab or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def attribute(token_sizes: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those that cross its start. ``ends``: the sections' end offsets in bytes."""
    stop = np.cumsum(token_sizes)
    start = stop - token_sizes
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop - 1, side="right")
    n = np.bincount(last if rule == "last" else first, minlength=len(ends)).astype(float)
    cross = np.flatnonzero(first != last)
    crossing = np.bincount(last[cross], minlength=len(ends))
    if rule == "share":
        for t in cross:
            edges = np.clip(np.concatenate([[start[t]], ends[first[t] : last[t]], [stop[t]]]), start[t], stop[t])
            n[first[t]] -= 1
            n[first[t] : last[t] + 1] += np.diff(edges) / token_sizes[t]
    return n, crossing


def count(batches, vocab: str | None, rule: str):
    encoding, sizes = encoder(vocab)
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = (text or "").split("\n")
            chars = np.cumsum([len(x) + 1 for x in lines])
            chars[-1] -= 1  # the last line has no line feed
            ends = chars if not text or text.isascii() else np.cumsum([len(x.encode()) + 1 for x in lines])
            ends[-1] -= ends is not chars
            ids = encoding.encode_ordinary(text) if text else []
            n, crossing = attribute(sizes[ids], ends, rule) if ids else (np.zeros(len(lines)), np.zeros(len(lines), int))
            for c, v in zip(cols, ([doc] * len(lines), range(len(lines)), [0, *chars[:-1].tolist()], chars.tolist(), n.tolist(), crossing.tolist(), [len(ids)] * len(lines)), strict=True):
                c.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 4 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])


def section_tokens(docs: DataFrame, rule: str = "first", vocab: str | None = None) -> DataFrame:
    """One row per line of each row of ``docs`` (doc_id, text): its span of characters and its tokens.

    Sections are the lines with their line feed; they cover the text, so their tokens add up to doc_tokens whatever
    the rule. A null or empty text has one empty section without tokens. Rows that repeat a doc_id are counted each;
    an empty table gives an empty result; other columns are not read. Texts of any length are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(lambda it: count(it, vocab, rule), SCHEMA)
