"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of word shingles. Documents with equal sets are one class and are represented by the least
doc_id. The representatives' MinHash signatures are banded; two that share a band are a candidate pair. Signatures
are compared a few values at a time: once ``m`` of the first ``n`` agree, the posterior probability (uniform prior)
that the similarity reaches the threshold is P(Binomial(n + 1, threshold) <= m), and the pair is dropped when that
falls below ``tolerance``. Survivors are joined to groups, the texts of a group are brought together, and every pair
in it that the same pruning leaves is verified on the exact sets.

No plan node emits pairs: buckets and groups are compared in blocks, inside a task, and a block gives the edges of a
spanning forest and each document's number of links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import Store, fresh, join_hot
from ._text import Cache, words

BANDS, ROWS = 24, 5
BLOCK = 512
STEP = 20


def word_hashes() -> Cache:
    return Cache(lambda w: xxhash.xxh3_64_intdigest(w))


def shingles(text: str | None, n: int, cache: Cache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words if there are fewer; empty without a word."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    out = np.zeros(max(1, len(w) - n + 1), np.uint64)
    for k in range(min(n, len(w))):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (h[k : k + len(out)] + (out >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Least value of each hash function, as 32 bits."""
    best = np.full(len(mult), 2**64 - 1, np.uint64)
    for i in range(0, len(values), 1024):
        x = values[i : i + 1024, None] * mult[None, :]
        x ^= x >> np.uint64(31)
        best = np.minimum(best, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(documents, bands) 64-bit keys."""
    x = np.zeros((len(sigs), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for r in range(ROWS):
        x = (x ^ sigs[:, r::ROWS][:, :BANDS].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(28)
    return x


def least_matches(n_hashes: int, threshold: float, tolerance: float) -> dict[int, int]:
    """By hashes compared: the fewest matches whose posterior probability still reaches the tolerance."""
    out = {}
    for n in range(STEP, n_hashes + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, keep: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that incremental comparison leaves."""
    agree = np.zeros(len(i), np.int32)
    for n, least in keep.items():
        if not len(i):
            break
        agree = agree + (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(axis=1, dtype=np.int32)
        ok = agree >= least
        i, j, agree = i[ok], j[ok], agree[ok]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every node which has a pair to the first node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def sign(batches, n: int):
    """Arrow batches of (doc, txt, text) to class digest, signature and number of shingles."""
    cache, mult = word_hashes(), multipliers(BANDS * ROWS)
    for batch in batches:
        digest, sigs, sizes = [], [], []
        for text in batch.column(2).to_pylist():
            s = shingles(text, n, cache)
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s, mult).tobytes() if len(s) else None)
            sizes.append(len(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], ["doc", "txt", "digest", "sig", "n"])


def unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def spread(batches):
    """Arrow batches of (rep, sig) to (band, key, rep)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = band_keys(unpack(batch.column(1))).view(np.int64)
        rep = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(keys.ravel()), pa.array(rep)], ["band", "key", "rep"])


def groups(batches, n_keys: int):
    """Runs of rows that share their first ``n_keys`` columns, from batches sorted by them: (key, table of the rest)."""
    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            k = tuple(c[s] for c in cols)
            if k != key and parts:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = k
            parts.append(batch.slice(s, e - s))
    if parts:
        yield key, pa.Table.from_batches(parts)


def pairs(m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs in a block if k is 0, else of the first m with the k others."""
    return np.triu_indices(m, 1) if not k else tuple(x.ravel() for x in np.indices((m, k)))


def bucket_edges(batches, threshold: float, tolerance: float):
    """Batches sorted by (band, key, block a, block b) with (block, rep, sig): a forest of each block's survivors."""
    keep = least_matches(BANDS * ROWS, threshold, tolerance)
    for (band, _, a, b), rows in groups(batches, 4):
        blk, rep = rows.column("blk").to_numpy(), rows.column("rep").to_numpy()
        order = np.argsort(blk, kind="stable")
        blk, rep, sigs = blk[order], rep[order], unpack(rows.column("sig").combine_chunks())[order]
        m = len(rep) if a == b else int((blk == a).sum())
        first, second = sigs[:m], sigs if a == b else sigs[m:]
        i, j = pairs(m, 0 if a == b else len(second))
        if band and len(i):  # a pair is compared in the first band that it shares
            p, q = band_keys(first)[:, :band], band_keys(second)[:, :band]
            shared = np.zeros(len(i), bool)
            for t in range(band):
                shared |= p[i, t] == q[j, t]
            i, j = i[~shared], j[~shared]
        i, j = prune(first, second, i, j, keep)
        if len(i):
            at, root = forest(len(rep), i, j if a == b else j + m)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[root])], ["u", "v"])


def expand(batches, n: int):
    """Arrow batches with the text last: the text becomes its signature and its shingles."""
    cache, mult = word_hashes(), multipliers(BANDS * ROWS)
    for batch in batches:
        sets = [shingles(t, n, cache) for t in batch.column(batch.num_columns - 1).to_pylist()]
        sigs = pa.array([signature(s, mult).tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sigs, pa.array([s.tobytes() for s in sets], pa.binary())], ["root", "blk", "nb", "rep", "sig", "shingles"])


def common(sets: list[np.ndarray], m: int, i: np.ndarray, j: np.ndarray, cells: int = 2**23) -> np.ndarray:
    """Sizes of the intersections of set i with set m + j (m is 0 within a block), each exact."""
    n_all = sum(map(len, sets))
    if len(i) * 40 < n_all / 8 + len(sets) ** 2 / 50:  # microseconds, about
        return np.array([len(np.intersect1d(sets[p], sets[m + q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    terms, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # terms of one set alone are in no intersection
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = count[inverse] > 1
    owner, inverse, width = owner[use], column[inverse[use]], int((count > 1).sum())
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    total = np.zeros((m or len(sets), len(sets) - m), np.float32)
    step = max(64, cells // len(sets))
    for low in range(0, width, step):
        s, e = np.searchsorted(inverse, [low, low + step])
        x = np.zeros((len(sets), min(step, width - low)), np.float32)
        x[owner[s:e], inverse[s:e] - low] = 1
        total += x[: m or len(sets)] @ x[m:].T
    return total[i, j].astype(np.int64)


def group_links(batches, threshold: float, tolerance: float):
    """Batches sorted by (root, block a, block b) with (block, rep, sig, shingles): exact links of each block."""
    keep = least_matches(BANDS * ROWS, threshold, tolerance)
    num = round(threshold * 10**6)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])
    for (_, a, b), rows in groups(batches, 3):
        blk, rep = rows.column("blk").to_numpy(), rows.column("rep").to_numpy()
        order = np.argsort(blk, kind="stable")
        blk, rep, sigs = blk[order], rep[order], unpack(rows.column("sig").combine_chunks())[order]
        held = rows.column("shingles").to_pylist()
        held = [held[k] for k in order]
        once = sorted({(r, s): k for k, (r, s) in reversed(list(enumerate(zip(rep.tolist(), held, strict=True))))}.values())
        blk, rep, sigs, sets = blk[once], rep[once], sigs[once], [np.frombuffer(held[k], np.uint64) for k in once]  # repeated rows count once
        size = np.array([len(s) for s in sets], np.int64)
        m = 0 if a == b else int((blk == a).sum())
        i, j = pairs(m or len(rep), len(rep) - m if m else 0)
        lo, hi = np.minimum(size[i], size[m + j]), np.maximum(size[i], size[m + j])
        near = lo * 10**6 >= hi * num  # sets of so different sizes cannot reach the threshold
        i, j = prune(sigs, sigs[m:], i[near], j[near], keep)
        if not len(i):
            continue
        both = common(sets, m, i, j)
        ok = both * 10**6 >= num * (size[i] + size[m + j] - both)
        i, j = i[ok], j[ok] + m
        links = np.bincount(i, minlength=len(rep)) + np.bincount(j, minlength=len(rep))
        at, root = forest(len(rep), i, j)
        some = np.flatnonzero(links)
        u = np.concatenate([rep[at], rep[some]])
        v = pa.array([*rep[root].tolist(), *[None] * len(some)], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate([np.zeros(len(at), np.int64), links[some]]))], schema=schema)


def in_blocks(df: DataFrame, size: str) -> DataFrame:
    """Deal the rows of groups of ``size`` rows to ``nb`` blocks of about BLOCK rows each."""
    nb = F.ceil(F.col(size) / BLOCK).cast("int")
    blk = F.pmod(F.xxhash64("rep"), nb).cast("int")
    return df.withColumn("nb", nb).withColumn("blk", blk)


def paired(df: DataFrame) -> DataFrame:
    """Every row once for each pair of blocks, a <= b, that its block is in."""
    return df.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"a": F.least("blk", "o"), "b": F.greatest("blk", "o")}).drop("o")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, tolerance: float = 1e-6, store: Store | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies.

    class_id is the least doc_id that links of at least ``threshold`` lead to; n_links is the number of different
    shingle sets linked to the document's own, n_copies the number of rows with its very set (itself included).
    Fewer words than a shingle make one shingle; texts without a word (null, empty) are copies of each other. Rows
    that share a doc_id count as one document with each of their texts. A row without id takes no part: its class is
    null and its counts are 0. An empty table gives an empty result; other columns are not read. Texts of any length
    are taken whole: the shingles of one text, and of a block of ``BLOCK`` candidates, are in one task's memory. Ties cannot arise.
    """
    store = store or Store(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("txt"), "text")
    signed = store.table(src.filter("doc is not null").mapInArrow(lambda it: sign(it, shingle), "doc bigint, txt bigint, digest binary, sig binary, n bigint"), "signed")
    reps = store.table(signed.groupBy("digest").agg(F.min(F.struct("doc", "txt", "sig")).alias("r"), F.count("*").alias("copies")).select("digest", F.col("r.doc").alias("rep"), F.col("r.txt").alias("txt"), F.col("r.sig").alias("sig"), "copies"), "classes")
    with_words = reps.filter("sig is not null")
    buckets = with_words.select("rep", "sig").mapInArrow(spread, "band int, key bigint, rep bigint")
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = in_blocks(buckets.join(shared, ["band", "key"]), "size").join(with_words.select("rep", "sig"), "rep")
    work = paired(members).select("band", "key", "a", "b", "blk", "rep", "sig").repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b")
    candidates = components(work.mapInArrow(lambda it: bucket_edges(it, threshold, tolerance), "u bigint, v bigint"), store)
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size"))
    grouped = candidates.join(sizes, "root").join(with_words.select(F.col("rep").alias("node"), "txt"), "node").select("root", "size", F.col("node").alias("rep"), "txt")
    texts = in_blocks(grouped, "size").join(src, (F.col("rep") == F.col("doc")) & (grouped["txt"] == src["txt"])).select("root", "blk", "nb", "rep", "text")
    sets = store.table(texts.mapInArrow(lambda it: expand(it, shingle), "root bigint, blk int, nb int, rep bigint, sig binary, shingles binary"), "sets")
    checked = paired(sets).select("root", "a", "b", "blk", "rep", "sig", "shingles").repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")
    found = store.table(checked.mapInArrow(lambda it: group_links(it, threshold, tolerance), "u bigint, v bigint, links bigint"), "links")
    degree = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("v is not null").select("u", "v"), store).toDF("rep", "root")
    known = reps.filter("copies > 1").select("digest", "rep", "copies").unionByName(reps.filter("copies = 1").join(degree.select("rep"), "rep", "left_semi").select("digest", "rep", "copies"))
    of_class = known.join(degree, "rep", "left").join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "copies")
    out = join_hot(signed.select("doc", "digest"), store.table(of_class, "of-class"), ["digest"], "copies", signed.count(), "left").select(F.col("doc").alias("doc_id"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"))
    zero = F.lit(0).cast("long")
    return out.unionAll(src.filter("doc is null").select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies")))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """One row of ``docs`` for each class, of those with its least doc_id that with the least hash of its text; rows
    without id stay. Rows that share a doc_id but not the text are told apart, rows alike in both count once. Null and empty texts
    are copies of each other; an empty table gives an empty result; all columns stay, whatever their names."""
    node, txt = fresh(docs, "node", "txt")
    keyed = docs.filter("doc_id is not null").withColumn(txt, F.xxhash64("text")).withColumn(node, F.xxhash64(F.col("doc_id").cast("long"), txt))
    places = keyed.select(node, F.struct("doc_id", txt, node).alias("place"))
    classes = jaccard_classes(keyed.select(F.col(node).alias("doc_id"), "text"), **kw).select(F.col("doc_id").alias(node), "class_id").distinct()
    kept = places.join(classes, node).groupBy("class_id").agg(F.min("place").alias("place")).select(F.col("place")[node].alias(node))
    one = keyed.join(kept, node, "left_semi").dropDuplicates([node])
    return docs.filter("doc_id is null").unionByName(one.select(*docs.columns))
