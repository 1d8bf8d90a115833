"""Deterministic domain views over the test tables, as DataFrames and as SQL of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEG_PER_PIXEL = 0.00002
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    side = F.pow(F.lit(2), 4 - F.col("rset")).cast("long")
    log = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", (e % 20).alias("img"), (e % 5).cast("int").alias("rset"))
    user = F.when(F.col("event_type") == "view", None).when(u % 13 == 0, "admin").otherwise(F.concat(F.lit("u"), (u % 50).cast("string")))
    return log.select("img", user.alias("user"), "rset", ((e * 7 + u) % side).alias("x"), ((e * 11 + u) % side).alias("y"), "ts", "event_id")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("img"), ((p * 37) % 340 - 170).cast("double").alias("lon0"), ((p * 17) % 120 - 60).cast("double").alias("lat0"), F.lit(8192).alias("width"), F.lit(8192).alias("height"), F.lit(4).alias("max_rset"), (F.col("p_size").cast("long") * DAY_MS).alias("collected")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 360 - 180).cast("double").alias("lon"), ((k * 104729) % 160 - 80).cast("double").alias("lat"))


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 tiles of grey values 0..255."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((2 * F.col("v").cast("double") + 1) * 127.5))).cast("int")
    return e.select(F.col("vec_id").alias("tile"), F.col("label").alias("img"), (F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), value.alias("v"))


def tile_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    return read(spark, sf_dir, "lineitem").select((o % 100).alias("img"), (n % 5).cast("int").alias("rset"), o.alias("x"), n.alias("y"), (F.col("l_quantity").cast("double") * 100).cast("long").alias("size"))


ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_sql(lat: str, lon: str, precision: str, longest: int = 9) -> str:
    qx, qy = (f"least(floor(({lon} + 180) / 360.0::DOUBLE * 1073741824), 1073741823)::BIGINT", f"least(floor(({lat} + 90) / 180.0::DOUBLE * 1073741824), 1073741823)::BIGINT")
    chars = []
    for k in range(longest):
        bits = [f"(({qx if i % 2 == 0 else qy} >> {29 - i // 2}) & 1) * {2 ** (4 - i % 5)}" for i in range(5 * k, 5 * k + 5)]
        chars.append(f"substr('{ALPHABET}', (1 + {' + '.join(bits)})::INT, 1)")
    return f"substr({' || '.join(chars)}, 1, {precision})"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(12742.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def precision_sql(km: str) -> str:
    from ..functions.geo import COARSEST, PRECISION_BY_KM

    return "CASE " + " ".join(f"WHEN {km} <= {limit} THEN {p}" for limit, p in PRECISION_BY_KM) + f" ELSE {COARSEST} END"


SQL = f"""
access_log AS (SELECT img, usr, rset, (event_id * 7 + user_id) % (2 ** (4 - rset))::BIGINT AS x, (event_id * 11 + user_id) % (2 ** (4 - rset))::BIGINT AS y, ts, event_id FROM (
    SELECT *, event_id % 20 AS img, (event_id % 5)::INT AS rset, CASE WHEN event_type = 'view' THEN NULL WHEN user_id % 13 = 0 THEN 'admin' ELSE 'u' || (user_id % 50) END AS usr FROM events)),
images AS (SELECT p_partkey AS img, ((p_partkey * 37) % 340 - 170)::DOUBLE AS lon0, ((p_partkey * 17) % 120 - 60)::DOUBLE AS lat0, 8192 AS width, 8192 AS height, 4 AS max_rset, p_size::BIGINT * {DAY_MS} AS collected FROM part),
points AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 104729) % 160 - 80)::DOUBLE AS lat FROM customer),
pixels AS (SELECT vec_id AS tile, label AS img, ((i - 1) % 8)::INT AS px, ((i - 1) // 8)::INT AS py, greatest(0, least(255, floor((2 * embedding[i]::DOUBLE + 1) * 127.5)))::INT AS v FROM embeddings, range(1, 65) AS t(i)),
objects AS (SELECT l_orderkey % 100 AS img, (l_linenumber % 5)::INT AS rset, l_orderkey AS x, l_linenumber::BIGINT AS y, (l_quantity::DOUBLE * 100)::BIGINT AS size FROM lineitem),
boxes AS (SELECT l.*, i.lon0 + x * 512 * (2 ** rset) * {DEG_PER_PIXEL} AS min_lon, i.lat0 - least((y + 1) * 512 * (2 ** rset), height) * {DEG_PER_PIXEL} AS min_lat,
    i.lon0 + least((x + 1) * 512 * (2 ** rset), width) * {DEG_PER_PIXEL} AS max_lon, i.lat0 - y * 512 * (2 ** rset) * {DEG_PER_PIXEL} AS max_lat FROM access_log l JOIN images i USING (img)),
widths AS (SELECT *, {haversine_sql('min_lat', 'min_lon', 'min_lat', 'max_lon')} AS km FROM boxes),
precise AS (SELECT *, {precision_sql('km')} AS p FROM widths),
cells AS (SELECT *, {geohash_sql('min_lat', 'min_lon', 'p')} AS location FROM precise),
summaries AS (SELECT location, 'global' AS usr, count(*) AS n FROM cells GROUP BY location UNION ALL SELECT location, usr, count(*) FROM cells WHERE usr IS NOT NULL AND usr <> 'admin' GROUP BY location, usr)
"""


def with_views(sql: str) -> str:
    return f"WITH {SQL}\n{sql}"
