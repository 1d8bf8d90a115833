"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store, join_hot


def components(edges: DataFrame, store: Store, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the least node of its component.

    Each step is two aggregations or joins on one end of an edge and keeps at most as many edges as before, so a
    node with very many neighbours costs rows, never a list; its edges are joined where they are. Rounds are written to
    the store. Their number is logarithmic; ``max_rounds`` only turns a fault into an error. Null ends, loops and
    repeated edges are of no effect.
    """
    now = store.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, total = seen, 2 * seen[0]
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = join_hot(both, least, ["u"], "n", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store.table(large.filter("u <> v").distinct(), "large")
        small = store.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        linked = join_hot(large, small, ["u"], "n", total)
        now = store.table(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    raise RuntimeError("components did not settle")
