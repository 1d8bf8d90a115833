"""Packing token sequences by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and one rest. The rests, by length class of
``grain`` tokens, are the orders of a cutting-stock problem: a linear program over patterns (how many rests of
each class share a sequence) is solved by column generation, where a knapsack dynamic program prices the
columns with the program's duals. The solution is rounded down; what is left over is packed by first fit over
the class counts. Documents, ranked within their class, then take the places of the patterns in order.

Only the histogram of length classes (``seq_len / grain`` rows) reaches the driver. Ranks come from counts by
(class, salt), so no task sees more of a class than one salt of it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Store, small
from ._text import WordBpe

#: Bins that pieces of one length class are dealt to, at least; one more for each so many pieces.
SALTS, ROWS_A_SALT = 251, 1_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rank_key bigint"


def cut(batches, vocab: str | None, seq_len: int, end_id: int):
    """Arrow batches of (doc_id, text) to pieces: full sequences, then the rest."""
    bpe, end = WordBpe(vocab), struct.pack("<I", end_id)
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = memoryview(bpe.ids(text or "") + end)
            n = len(ids) // 4
            for start in range(0, n, seq_len):
                part = ids[4 * start : 4 * (start + seq_len)]
                crc = zlib.crc32(part)
                for c, v in zip(cols, (doc, start, len(part) // 4, crc, n, crc), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank_key"])


def price(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best pattern for item sizes 1..len(values) within ``room``."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        m = min(c, len(values))
        gains = values[:m] + best[c - 1 :: -1][:m]
        k = int(gains.argmax())
        best[c], last[c] = (gains[k], k + 1) if gains[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(len(values), int), room
    while c > 0:
        if last[c]:
            pattern[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[room]), pattern


def patterns(counts: np.ndarray, room: int, max_columns: int = 20_000) -> list[tuple[int, np.ndarray]]:
    """(times, items by size) that hold ``counts[i]`` items of size ``i + 1`` in bins of ``room``.

    Revised simplex on the covering program, starting from one homogeneous pattern per size that occurs.
    ``max_columns`` bounds the pivots of a program of at most ``room`` rows, whose size does not depend on the number of
    documents; stopping early costs some padding and never an item.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    need = counts[sizes].astype(float)
    m = len(sizes)
    basis = np.diag(room // (sizes + 1)).astype(float)
    inverse = np.diag(1.0 / basis.diagonal())
    x = inverse @ need
    for _ in range(max_columns):
        duals = inverse.sum(axis=0)
        values = np.full(room, -1.0)
        values[sizes] = duals
        worth, pattern = price(values, room)
        if worth <= 1 + 1e-7:
            break
        column = pattern[sizes].astype(float)
        d = inverse @ column
        steps = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(steps.argmin())
        if not np.isfinite(steps[r]):
            break
        basis[:, r] = column
        inverse[r] /= d[r]
        rest = np.delete(np.arange(m), r)
        inverse[rest] -= np.outer(d[rest], inverse[r])
        x = np.maximum(inverse @ need, 0)
    out, left = [], counts.astype(int).copy()
    for j in np.argsort(-x):
        items = np.zeros(len(counts), int)
        items[sizes] = basis[:, j].astype(int)
        used = np.flatnonzero(items)
        times = min([int(np.floor(x[j] + 1e-9)), *(left[used] // items[used])])
        if times > 0:
            out.append((times, items))
            left -= times * items
    # what rounding left: fill one bin after another, largest first, as often as the counts allow
    while left.any():
        items, free = np.zeros(len(counts), int), room
        for i in np.flatnonzero(left)[::-1]:
            k = min(free // (i + 1), left[i])
            items[i], free = k, free - k * (i + 1)
        used = np.flatnonzero(items)
        times = int((left[used] // items[used]).min())
        out.append((times, items))
        left -= times * items
    return out


def places(plan: list[tuple[int, np.ndarray]]) -> tuple[dict[int, tuple], int]:
    """By class: where each pattern's places begin, places a sequence, first sequence; and how many sequences."""
    by_class: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for times, items in plan:
        for i in np.flatnonzero(items):
            rows = by_class.setdefault(int(i), [(0, 0, 0)])
            rows.append((rows[-1][0] + times * int(items[i]), int(items[i]), first))
        first += times
    return {i: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for i, rows in by_class.items()}, first


def assign(batches, by_class: dict[int, tuple], names: list[str]):
    """Arrow batches with class and rank first to the sequence of each."""
    for batch in batches:
        cls, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        seq = np.zeros(len(cls), np.int64)
        for c in np.unique(cls):
            ends, per, first = by_class[int(c)]
            at = cls == c
            k = np.searchsorted(ends, rank[at], side="right")
            seq[at] = first[k] + (rank[at] - ends[k - 1]) // per[k]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(seq)], [*names, "sequence_id"])


def pack(docs: DataFrame, seq_len: int = 2048, grain: int = 8, end_id: int = 1, vocab: str | None = None, store: Store | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text; other columns are not read. A null or empty text is the end id alone. Rows that repeat
    a doc_id are packed each. An empty table gives an empty result. Texts of any length are cut into sequences
    of their own and one rest. Ties in length are ranked by a hash of the ids, then by doc_id and start.
    """
    store = store or Store(docs.sparkSession)
    pieces = store.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: cut(it, vocab, seq_len, end_id), PIECES), "pieces")
    room = seq_len // grain
    size = F.ceil(F.col("length") / grain).cast("long")
    salts = SALTS + pieces.count() // ROWS_A_SALT
    rest = pieces.withColumns({"class": size - 1, "salt": F.pmod(F.col("rank_key") + F.coalesce("doc_id", F.lit(0)), F.lit(salts))})
    groups = store.table(rest.groupBy("class", "salt").count(), "classes")
    counts = np.zeros(room, np.int64)
    for r in groups.groupBy("class").agg(F.sum("count").alias("n")).collect():  # at most seq_len / grain rows
        counts[r["class"]] = r["n"]
    by_class, _ = places(patterns(counts, room))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = groups.select("class", "salt", before.alias("base"))  # at most seq_len / grain * salts rows
    within = F.row_number().over(Window.partitionBy("class", "salt").orderBy("rank_key", "doc_id", "start"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = rest.withColumn("at", within - 1).join(small(store.table(base, "bases"), F.lit(24)), ["class", "salt"]).select("class", (F.col("base") + F.col("at")).alias("rank"), *names)
    dealt = ranked.mapInArrow(lambda it: assign(it, by_class, names), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint")
    # a sequence holds at most seq_len pieces
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


__all__ = ["pack", "patterns", "price"]
