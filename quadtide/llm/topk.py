"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards by a hash. A shard's tree splits at the median of the widest dimension down to its leaves, and
every node, inner ones too, has its tight bounding box. A query first opens, from the root on, the child whose box allows
the larger inner product, down to a leaf. Then a block of queries walks the tree best-first: of the nodes seen it opens the
one whose box allows the largest inner product to any of them, for those whose k-th best score is not above what the box
allows; what no query wants is left unseen with all below it. Shards are searched in rounds, of one, three, twelve shards
and so on; the k-th scores of all shards so far go with the queries to the next round. Shards and blocks meet in cogroups:
nothing of either is broadcast, and a shard is not repeated for each block.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Store

LEAF = 128
#: The score that every other one is above.
NONE = -(2**63)
HITS = "query_id bigint, vec_id bigint, score bigint"
FOUND = ["query_id", "vec_id", "score"]
#: So many blocks of queries come to a copy of a shard at most.
BLOCKS = 1024


def exact(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest type in which the products of integer rows are exact: every partial sum is below 2**24 or 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Tree:
    """Nodes in the order in which they were split; a leaf is a run of rows, an inner node has two children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.spans, self.children, low, high = [(0, len(ids))], [], [], []
        at = 0
        while at < len(self.spans):
            s, e = self.spans[at]
            part = vectors[order[s:e]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            self.children.append(())
            if e - s > leaf:
                mid, width = (e - s) // 2, high[-1] - low[-1]
                if width.any():  # equal vectors need no order, only bounded leaves
                    order[s:e] = order[s:e][np.argpartition(part[:, int(width.argmax())], mid)]
                self.children[at] = (len(self.spans), len(self.spans) + 1)
                self.spans += [(s, s + mid), (s + mid, e)]
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.stack(low), np.stack(high)

    def search(self, q_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray):
        """(query numbers, ids, scores) that may be among the k best of their query; kth: scores that k others have already."""
        kind = exact(queries, self.vectors)
        q, vectors = queries.astype(kind), self.vectors.astype(kind)
        bounds = (np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T).astype(np.int64)
        limit, scores, ids = kth.copy(), np.full((len(q), k), NONE), np.zeros((len(q), k), np.int64)

        def score(leaf: int, who: np.ndarray) -> None:
            s, e = self.spans[leaf]
            got = q[who] @ vectors[s:e].T
            use = got >= limit[who].astype(kind)[:, None]
            if not len(new := np.flatnonzero(use.any(axis=1))):
                return
            who = who[new]
            use = use[new] & (self.ids[None, s:e] != q_ids[who][:, None])
            got = np.where(use, got[new].astype(np.int64), NONE)
            v, i = np.hstack([scores[who], got]), np.hstack([ids[who], np.broadcast_to(self.ids[s:e], got.shape)])
            top = np.lexsort((i, ~v), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(v, top, 1), np.take_along_axis(i, top, 1)
            limit[who] = np.maximum(limit[who], scores[who, -1])

        first, inner = np.zeros(len(q), np.int64), np.array([bool(c) for c in self.children])
        left, right = (np.array([c[side] if c else 0 for c in self.children]) for side in (0, 1))
        rows = np.arange(len(q))
        while (down := inner[first]).any():
            a, b = left[first], right[first]
            first = np.where(down, np.where(bounds[rows, a] >= bounds[rows, b], a, b), first)
        for leaf in np.unique(first):
            who = rows[first == leaf]
            score(leaf, who[bounds[who, leaf] >= limit[who]])
        heap = [(0, 0, rows)]
        while heap:
            _, node, who = heapq.heappop(heap)
            who = who[bounds[who, node] >= limit[who]]
            if not len(who):
                continue
            if not self.children[node]:
                score(node, who[first[who] != node])
            for child in self.children[node]:
                if len(own := who[bounds[who, child] >= limit[who]]):
                    heapq.heappush(heap, (-int(bounds[own, child].max()), child, own))
        found = scores > NONE
        return np.nonzero(found)[0], ids[found], scores[found]


def pack(batches):
    """Batches sorted by a group with (group, id, values): one row per group, values in the smallest type that holds them."""
    from .jaccard import groups

    for (g,), rows in groups(batches, 1):
        ids, values = rows.column("id").to_numpy().astype(np.int64), rows.column("v").combine_chunks().flatten().to_numpy().astype(np.int64)
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
        yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([ids.tobytes()]), pa.array([values.astype(kind).tobytes()])], ["g", "ids", "m"])


def unpack(ids: bytes, m: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of what :func:`pack` made of vectors of ``width`` values."""
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.dtype(f"i{len(m) // (len(i) * width)}")).reshape(len(i), width).astype(np.int64)


def search(shard: pa.Table, work: pa.Table, k: int, width: int) -> pa.Table:
    """Of one shard and the query blocks that come to it: the candidates of each query."""
    out = [pa.Table.from_arrays([pa.array([], pa.int64())] * 3, FOUND)]
    if shard.num_rows and work.num_rows:
        tree = Tree(*unpack(shard.column("ids")[0].as_py(), shard.column("m")[0].as_py(), width))
        for ids, m, kth in zip(*(work.column(c).to_pylist() for c in ("ids", "m", "kth")), strict=True):
            q_ids, queries = unpack(ids, m, width)
            limit = np.full(len(q_ids), NONE) if kth is None else np.frombuffer(kth, np.int64)
            q, i, s = tree.search(q_ids, queries, k, limit)
            out.append(pa.Table.from_arrays([pa.array(q_ids[q]), pa.array(i), pa.array(s)], FOUND))
    return pa.concat_tables(out)


def searcher(k: int, width: int):
    """:func:`search` with two arguments, as a cogroup takes it."""
    return lambda shard, work: search(shard, work, k, width)


def with_kth(asked: pa.Table, reached: pa.Table) -> pa.Table:
    """One block of queries with the k-th score of each, NONE where it has fewer."""
    known = dict(zip(reached.column("query_id").to_pylist(), reached.column("score").to_pylist(), strict=True))
    out = [np.array([known.get(i, NONE) for i in np.frombuffer(ids, np.int64).tolist()], np.int64).tobytes() for ids in asked.column("ids").to_pylist()]
    return asked.select(["b", "ids", "m"]).append_column("kth", pa.array(out, pa.binary()))


def rounds(shards: int) -> list[tuple[int, int]]:
    """Which places of a block's order of shards each round searches: 1, 3, 12, 48 ... of them."""
    ends = [0, 1]
    while ends[-1] < shards:
        ends.append(min(shards, 4 * ends[-1]))
    return [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a < shards]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard_rows: int | None = None, block_rows: int = 512, store: Store | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` (vec_id, embedding) with the highest inner products.

    Components are floor(scale * x). Queries are the rows whose vec_id ``every`` divides; a query is no candidate of
    its own. Ties go to the smaller vec_id. Rows with a null id, a null or empty vector, or one with a null or
    non-finite component take no part, and vectors are compared with those of their own length only (a long vector is
    one like any other). Rows that repeat an id are candidates each; as queries, those of one id and length serve once, by
    the least of their vectors. An empty table gives an empty result. Other columns are not read.
    """
    store = store or Store(vectors.sparkSession)
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.filter(good).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    rows = store.table(rows.withColumn("w", F.size("v")), "vectors")
    sizes = rows.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()  # a row a vector length
    out = vectors.sparkSession.createDataFrame([], HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for r in sizes:
        if not r["q"]:
            continue
        w, rows_each = r["w"], shard_rows or max(4096, min(65536, r["n"] // 48))
        shards, blocks = math.ceil(r["n"] / rows_each), math.ceil(r["q"] / block_rows)
        own = rows.filter(F.col("w") == w)
        packed, block = "g int, ids binary, m binary", lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(blocks)).cast("int")
        tree = own.withColumn("g", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(shards)).cast("int"))
        trees = store.table(tree.select("g", "id", "v").repartition(shards, "g").sortWithinPartitions("g").mapInArrow(pack, packed), "shards")
        trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // BLOCKS))))
        asked = own.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("g", block("id"))
        asked = store.table(asked.select("g", "id", "v").repartition(blocks, "g").sortWithinPartitions("g").mapInArrow(pack, packed), "queries").toDF("b", "ids", "m")
        hits = None
        for start, end in rounds(shards):
            if hits is None:
                work = asked.withColumn("kth", F.lit(None).cast("binary"))
            else:
                reached = hits.filter(F.col("rank") == k).select(block("query_id").alias("b"), "query_id", "score")
                work = asked.groupBy("b").cogroup(reached.groupBy("b")).applyInArrow(with_kth, "b int, ids binary, m binary, kth binary")
            work = work.withColumn("at", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
            work = work.withColumns({"g": F.pmod(F.col("b") + F.col("at"), F.lit(shards)), "part": F.floor(F.col("b") / BLOCKS).cast("int")}).drop("at")
            found = trees.groupBy("g", "part").cogroup(work.groupBy("g", "part")).applyInArrow(searcher(k, w), HITS)
            both = found if hits is None else found.unionByName(hits.drop("rank"))
            hits = store.table(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "hits")
        out = out.unionByName(hits.drop("rank"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(embeddings: str = "embeddings", k: int = 20, every: int = 20, scale: int = 64) -> str:
    """:func:`top_k` as DuckDB SQL, by brute force."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {embeddings}
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % {every} = 0 GROUP BY vec_id, len(v)),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM a q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
