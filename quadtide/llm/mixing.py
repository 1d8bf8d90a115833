"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import Store, fresh, small
from ._text import WORD_SQL

#: Bins that documents of one source and size are dealt to, at least; one more for each so many rows.
SALTS, ROWS_A_SALT = 251, 1_000_000
#: Sizes of a block of the prefix sums.
BLOCK = 64


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, max_repeat: float) -> dict[str | None, float]:
    """Words that the mix should take from each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all words. A target
    stops at ``max_repeat`` times its source's size; the excess goes to the others by weight, until none is above.
    """
    ordered = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    cap = {s: max_repeat * n for s, n in ordered}
    total = share * sum(n for _, n in ordered)
    full: set = set()
    while True:
        left, open_ = total - sum(cap[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        level = left / open_ if open_ else 0.0
        above = {s for s, w in weight.items() if s not in full and level * w > cap[s]}
        if not above:
            return {s: float(cap[s]) if s in full else level * w for s, w in weight.items()}
        full |= above


def offset(seed: int, key: Column, draw: Column) -> Column:
    """A random multiple of 1/1024 in [0, 1), exact in the sums below."""
    text = F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), key["none"].cast("string"), F.lit(":"), key["name"])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(1024)) / 1024


def copies_at(offset: Column, rank: Column) -> Column:
    """Whole numbers that the prefix sum crosses at a document; its rank counts from 0."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return F.least(F.floor(offset + (rank + 1) * rate) - F.floor(offset + rank * rate), F.ceil(rate))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2, seed: int = 7, draws: int = 16, store: Store | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, and whatever else) with size, source_size, target and copies.

    copies is how often the mix takes the document. Within a source every document is expected
    target / source_size times; the prefix sum of that, with one random offset a source, crosses so many whole
    numbers at the document. Documents stand in the order of their size, so the words taken miss the target by less than
    the largest document of the source, whatever the offset. Of ``draws`` random offsets the one serves whose words come
    nearest the target (the first of them, if several): that choice looks at the sizes, so which documents are taken is
    not quite independent of them; with ``draws`` 1 it is. copies is at most the rate rounded up; the bound matters only
    where the prefix sum is rounded.

    The order's prefix sums come from counts by (source, size, salt), summed by blocks of sizes, by size and by salt: no
    task holds a source, nor the sizes of one. A null text has size 0, a null source is a source of its own, a source
    without words has target 0. Rows that repeat a doc_id are documents each. Ties in size follow doc_id. An empty table
    gives an empty result. Texts of any length are counted whole, in a streaming expression. Columns of the same names as
    the added ones are replaced. One row a source reaches the driver: the table of sources is a configuration, not data.
    """
    store = store or Store(docs.sparkSession)
    docs = docs.drop("size", "source_size", "target", "copies")
    u, salt, base, at, key, block = fresh(docs, "u", "salt", "base", "at", "key", "block")
    salts = SALTS + docs.count() // ROWS_A_SALT
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)).cast("long"), F.lit(0).cast("long"))
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    added = {"size": size, salt: F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(salts)), key: source}
    slim = store.table(docs.withColumns(added).select("doc_id", key, "size", salt), "sized")
    groups = store.table(slim.groupBy(key, "size", salt).agg(F.count("*").alias(at)).withColumn(block, F.floor(F.col("size") / BLOCK)), "sizes")
    found = groups.groupBy(key).agg(F.sum(F.col("size") * F.col(at)).alias("n")).collect()
    sums = {None if r[0]["none"] else r[0]["name"]: r["n"] for r in found}
    goal = targets(list(sums.items()), weights, share, max_repeat)
    plan = docs.sparkSession.createDataFrame([((s is None, s or ""), n, goal[s]) for s, n in sums.items()], f"{key} struct<none boolean, name string>, source_size bigint, target double")

    def before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Sums of ``at`` by keys and order, and of what stands before in the order."""
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.groupBy(*keys, order).agg(F.sum(at).alias(at)).select(*keys, order, F.coalesce(F.sum(at).over(w), F.lit(0)).alias(base))

    room = F.length(f"{key}.name") + 32
    of_block = small(store.table(before(groups, [key], block), "blocks"), room)
    of_size = before(groups, [key, block], "size").withColumnRenamed(base, "_size").join(of_block, [key, block]).select(key, "size", (F.col("_size") + F.col(base)).alias("_size"))
    of_size = small(store.table(of_size, "bases"), room)
    bases = before(groups, [key, "size"], salt).join(of_size, [key, "size"]).select(key, "size", salt, (F.col("_size") + F.col(base)).alias(base))
    within = F.row_number().over(Window.partitionBy(key, "size", salt).orderBy("doc_id")) - 1
    rank = F.col(base) + F.col(at)

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.withColumn(at, within).join(bases, [key, "size", salt]).join(small(plan, room), key)

    tried = [F.sum(F.col("size") * copies_at(offset(seed, F.col(key), F.lit(d)), rank)).alias(f"d{d}") for d in range(draws)]
    # copies in a bin of size and salt do not depend on which of its documents has which rank
    words_by_draw = ranked(slim, plan).groupBy(key, "target").agg(*tried)
    nearest = F.array_min(F.array(*(F.struct(F.abs(F.col(f"d{d}") - F.col("target")).alias("off"), F.lit(d).alias("d")) for d in range(draws))))["d"]
    chosen = store.table(plan.join(words_by_draw.select(key, offset(seed, F.col(key), nearest).alias(u)), key), "offsets")
    return ranked(docs.withColumns(added), chosen).withColumn("copies", copies_at(F.col(u), rank)).select(*docs.columns, "size", "source_size", "target", "copies")


def repeat(mixed: DataFrame) -> DataFrame:
    """Every document as often as its copies say, without the columns that :func:`mix` added; null copies are none."""
    (n,) = fresh(mixed, "copy")
    return mixed.filter("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(n, "size", "source_size", "target", "copies")


def sql(documents: str = "documents", seed: int = 7, draws: int = 16) -> str:
    """:func:`mix` with its default parameters as DuckDB SQL, one row per document."""
    return f"""
    WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::BIGINT AS size FROM {documents}),
    s AS (SELECT none, name, sum(size)::BIGINT AS n FROM d GROUP BY none, name),
    w AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY none, name) - 1) % 3)::INT]::DOUBLE AS weight FROM s),
    c AS (SELECT *, 2.0 * n / weight AS ratio FROM w),
    l AS (SELECT *, (1.5 * sum(n) OVER () - 2.0 * coalesce(sum(n) OVER (ORDER BY ratio, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, none, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
    v AS (SELECT coalesce(arg_min(level, (ratio, none, name)) FILTER (WHERE level <= ratio), 0) AS level FROM l),
    p AS (SELECT none, name, n AS source_size, least(2.0 * n, v.level * weight)::DOUBLE AS target FROM c, v),
    o AS (SELECT p.*, d, ((('0x' || substr(md5('{seed}:' || d || ':' || none::VARCHAR || ':' || name), 1, 8))::BIGINT) % 1024) / 1024.0::DOUBLE AS u FROM p, range({draws}) AS t(d)),
    r AS (SELECT d.doc_id, d.size, d.none, d.name,
        row_number() OVER (PARTITION BY d.none, d.name ORDER BY d.size, ((coalesce(doc_id, 0) % {SALTS}) + {SALTS}) % {SALTS}, doc_id) - 1 AS k FROM d),
    y AS (SELECT r.*, o.d, o.source_size, o.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, u FROM r JOIN o USING (none, name)),
    z AS (SELECT *, size * least(floor(u + (k + 1) * rate) - floor(u + k * rate), ceil(rate))::BIGINT AS taken FROM y),
    b AS (SELECT none, name, d, abs(sum(taken) - any_value(target)) AS off FROM z GROUP BY none, name, d),
    w1 AS (SELECT none, name, arg_min(d, (off, d)) AS d FROM b GROUP BY none, name)
    SELECT doc_id, size, source_size, round(target, 6) AS target, taken FROM z JOIN w1 USING (none, name, d)"""
