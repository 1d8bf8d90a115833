"""Removing repeated runs of lines by winnowing over line hashes.

A gram is the shortest run of lines from some line on that has ``gram_words`` words; its hash joins the hashes of
its lines. Of all grams inside each shortest run of ``min_words`` words, the one with the least hash is a
fingerprint, so two documents that share a run of at least ``min_words`` words share a fingerprint in it. Every
fingerprint is joined with its first occurrence (the least document, then line); both sides are compared line by
line outwards, as far as ``min_words`` words reach: further on the next shared fingerprint carries on. Matches that
touch form a run; a run of at least ``min_words`` words is deleted, the first occurrence stays.

A gram's first occurrence can stand among other lines than a later one's, so windows (the shortest runs of
``min_words`` words from some line on or up to some line, which together cover every longer run) are compared too.
A window goes by its fingerprint; those of shared fingerprints are grouped by their hashes, and each but the first of
its group is a match. This finds the repeats of all earlier occurrences.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import Store, fresh, join_hot
from ._text import words

GRAMS = "doc bigint, txt bigint, h bigint, a int, b int, before array<bigint>, after array<bigint>, w array<bigint>, wa array<int>, wb array<int>"


def units(text: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """Lines of a text; and, of those with a word, the line number, the hash of the words and their number."""
    lines = (text or "").split("\n")
    at, hashes, sizes = [], [], []
    for i, line in enumerate(lines):
        if w := words(line):
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(" ".join(w)) - 2**63)
            sizes.append(len(w))
    return lines, at, hashes, sizes


def ends(sizes: list[int], least: int) -> list[int]:
    """For each line, the last line of the shortest run from it on with at least so many words; -1: none."""
    out, j, total = [], 0, 0
    for i, n in enumerate(sizes):
        while j < len(sizes) and total < least:
            total += sizes[j]
            j += 1
        out.append(j - 1 if total >= least else -1)
        total -= n
    return out


def fingerprints(hashes: list[int], sizes: list[int], min_words: int, gram_words: int) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(hash, first line, last line, windows that go by it) of the grams that winnowing selects, in order."""
    gram_end, span_end = ends(sizes, gram_words), ends(sizes, min_words)
    grams = [None if e < 0 else (hashes[i] if e == i else xxhash.xxh3_64_intdigest(repr(hashes[i : e + 1])) - 2**63) for i, e in enumerate(gram_end)]
    picked: dict[int, tuple[int, int, int, list[tuple[int, int]]]] = {}
    of_start: list[list[tuple[int, int]]] = []
    for i, last in enumerate(span_end):
        if last >= 0:
            best = min((grams[k], -k) for k in range(i, last + 1) if grams[k] is not None and gram_end[k] <= last)
            windows = picked.setdefault(-best[1], (best[0], -best[1], gram_end[-best[1]], []))[3]
            windows.append((i, last))
            of_start.append(windows)
    n = len(sizes)
    for last, back in zip(range(n - 1, -1, -1), ends(sizes[::-1], min_words), strict=True):
        if back >= 0 and span_end[i := n - 1 - back] != last:
            of_start[i].append((i, last))
    return [picked[k] for k in sorted(picked)]


def scan(batches, min_words: int, gram_words: int):
    """Arrow batches of (doc, txt, text) to fingerprints with the line hashes on either side, nearest first."""
    schema = pa.schema([("doc", pa.int64()), ("txt", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("w", pa.list_(pa.int64())), ("wa", pa.list_(pa.int32())), ("wb", pa.list_(pa.int32()))])
    for batch in batches:
        rows = []
        for doc, txt, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, _, hashes, sizes = units(text)
            if sum(sizes) < min_words:
                continue
            found, raw = fingerprints(hashes, sizes, min_words, gram_words), array("q", hashes).tobytes()
            for h, a, b, windows in found:
                low, total = a, 0
                while low and (total := total + sizes[low - 1]) < min_words:
                    low -= 1
                high, total = b + 1, sum(sizes[a + 1 : b + 1])
                while high < len(sizes) and (total := total + sizes[high]) < min_words:
                    high += 1
                whole = [xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j + 8]) - 2**63 for i, j in windows]
                rows.append((doc, txt, h, a, b, hashes[low:a][::-1], hashes[b + 1 : high], whole, [i for i, _ in windows], [j for _, j in windows]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 10, schema, strict=True)], schema=schema)


def rewrite(batches, text_at: int, runs_at: int, min_words: int, schema: pa.Schema):
    """Delete the runs; the column of runs becomes the number of lines deleted."""
    for batch in batches:
        texts, gone = [], []
        for text, runs in zip(batch.column(text_at).to_pylist(), batch.column(runs_at).to_pylist(), strict=True):
            dropped: set[int] = set()
            if runs:
                lines, at, _, sizes = units(text)
                merged: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in runs):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    if sum(sizes[a : b + 1]) >= min_words:
                        dropped.update(at[a : b + 1])
            texts.append("\n".join(line for i, line in enumerate(lines) if i not in dropped) if dropped else text)
            gone.append(len(dropped))
        cols = list(batch.columns)
        cols[text_at], cols[runs_at] = pa.array(texts, schema.field(text_at).type), pa.array(gone, pa.int64())
        yield pa.RecordBatch.from_arrays(cols, schema=schema)


def dedup_lines(docs: DataFrame, min_words: int = 50, gram_words: int = 25, store: Store | None = None) -> DataFrame:
    """``docs`` (doc_id, text, and whatever else) without later repeats of runs of lines; adds n_removed_lines.

    The first occurrence is that in the least doc_id (null first), at the earliest line. Lines are compared by
    their words; lines without words neither match nor end a run. Null texts and texts under ``min_words`` words
    stay as they are; a text may become empty, its row stays. Rows alike in doc_id and text count as one document
    and are treated alike; rows that share only the id are told apart by their text. A column of the added name
    is replaced. An empty table gives an empty result. Texts of any length are taken whole: a text's lines, and at most
    ``min_words`` line hashes on either side of each fingerprint, are what a task holds of it. Fingerprints and windows
    that very many texts share are joined where they are.
    """
    store = store or Store(docs.sparkSession)
    docs = docs.drop("n_removed_lines")
    k1, k2, runs = fresh(docs, "doc", "txt", "runs")
    keyed = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), k2: F.xxhash64("text")})
    grams = store.table(keyed.select(k1, k2, "text").mapInArrow(lambda it: scan(it, min_words, gram_words), GRAMS), "grams")
    place = F.struct("doc", "txt", "a", "before", "after")
    first = store.table(grams.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first")
    grown = lambda side: F.expr(f"array_min(filter(sequence(0, least(size({side}), size(first.{side}))), i -> i = least(size({side}), size(first.{side})) or {side}[i] <> first.{side}[i]))")
    later = F.struct("doc", "txt", "a") != F.struct(*(F.col("first")[c].alias(c) for c in ("doc", "txt", "a")))
    met = join_hot(grams, first, ["h"], "n", grams.count())
    shared = store.table(met.select("doc", "txt", "h", "w", "wa", "wb", F.when(later, F.struct((F.col("a") - grown("before")).alias("a"), (F.col("b") + grown("after")).alias("b"))).alias("run")), "shared")
    windows = store.table(shared.select("doc", "txt", "h", F.explode(F.arrays_zip("w", "wa", "wb")).alias("x")).select("doc", "txt", "h", "x.*"), "windows")
    place = F.struct("doc", "txt", "wa")
    first = store.table(windows.groupBy("h", "w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-windows")
    again = join_hot(windows, first, ["h", "w"], "n", windows.count()).filter(place != F.col("first")).select("doc", "txt", F.struct(F.col("wa").alias("a"), F.col("wb").alias("b")).alias("run"))
    spans = shared.filter("run is not null").select("doc", "txt", "run").unionAll(again)
    found = spans.groupBy("doc", "txt").agg(F.collect_set("run").alias(runs)).toDF(k1, k2, runs)
    joined = keyed.join(found, [k1, k2], "left").select(*docs.columns, runs)
    out = T.StructType([*docs.schema.fields]).add("n_removed_lines", T.LongType())
    schema = to_arrow_schema(out)
    text_at, runs_at = docs.columns.index("text"), len(docs.columns)
    return joined.mapInArrow(lambda it: rewrite(it, text_at, runs_at, min_words, schema), out)
