"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo, tiles, visibility
from .operators import cluster, heatmap, priority, raster, warehouse
from .plans import domain
from .plans.domain import read
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "flagship"]


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return heatmap.summaries(domain.access_log(spark, d), domain.images(spark, d))


@query("SELECT location, usr AS \"user\", n AS \"requestCount\", length(location)::INT AS \"precisionLevel\" FROM summaries")
def a1_request_summaries(spark, d):
    return _summaries(spark, d).withColumn("precisionLevel", F.length("location"))


flagship = a1_request_summaries


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM access_log")
def a2_collection_window(spark, d):
    return domain.access_log(spark, d).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("SELECT location, sum(n)::BIGINT AS requests FROM summaries WHERE usr <> 'global' GROUP BY location")
def a3_requests_by_cell(spark, d):
    return _summaries(spark, d).filter("user <> 'global'").groupBy("location").agg(F.sum("requestCount").alias("requests"))


@query("SELECT usr AS \"user\", count(DISTINCT location) AS cells, sum(n)::BIGINT AS requests FROM summaries GROUP BY usr")
def a5_cells_by_user(spark, d):
    return _summaries(spark, d).groupBy("user").agg(F.countDistinct("location").alias("cells"), F.sum("requestCount").alias("requests"))


@query("SELECT img, min(min_lon) AS w, min(min_lat) AS s, max(max_lon) AS e, max(max_lat) AS n FROM boxes GROUP BY img")
def a8_envelopes(spark, d):
    boxes = heatmap.tile_boxes(domain.access_log(spark, d), domain.images(spark, d))
    return boxes.groupBy("img").agg(F.min("min_lon").alias("w"), F.min("min_lat").alias("s"), F.max("max_lon").alias("e"), F.max("max_lat").alias("n"))


@query("SELECT img, v, count(*) AS n FROM pixels WHERE v / 256.0 >= 0.2 / 256 GROUP BY img, v")
def a10_histogram(spark, d):
    return raster.histogram(domain.tile_pixels(spark, d))


_CUM = "h AS (SELECT img, v, count(*) AS n FROM pixels WHERE v / 256.0 >= 0.2 / 256 GROUP BY img, v), c AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY v)::BIGINT AS cum FROM h)"


@query(f"SELECT * FROM (WITH {_CUM} SELECT img, v, n, cum FROM c)")
def a12_cumulative_histogram(spark, d):
    return raster.cumulative(raster.histogram(domain.tile_pixels(spark, d)))


@query(f"SELECT * FROM (WITH {_CUM} SELECT img, v, n, sum(n) OVER (PARTITION BY img ORDER BY v ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)::BIGINT AS sum16 FROM h)")
def w3_look_back_sum(spark, d):
    return raster.look_back(raster.histogram(domain.tile_pixels(spark, d)))


_DRA = f"""{_CUM}, t AS (SELECT *, max(cum) OVER (PARTITION BY img) AS total, min(cum) OVER (PARTITION BY img) AS at_first FROM c),
p AS (SELECT img, min(v) AS e_first, coalesce(max(v) FILTER (WHERE cum < total), 0)::INT AS e_last, coalesce(min(v) FILTER (WHERE cum::DOUBLE / at_first > 1.02), 256)::INT AS e_min, coalesce(max(v) FILTER (WHERE cum::DOUBLE / total < 0.98), 0)::INT AS e_max FROM t GROUP BY img)"""


@query(f"SELECT * FROM (WITH {_DRA} SELECT * FROM p)")
def a13_dra_parameters(spark, d):
    return raster.dra_parameters(raster.cumulative(raster.histogram(domain.tile_pixels(spark, d))))


_EQ = f"""{_DRA}, q AS (SELECT x.*, e_min, greatest(e_first, e_min - 0.1::DOUBLE * (e_max - e_min)) AS lo, least(e_last, e_max + 0.1::DOUBLE * (e_max - e_min)) AS hi FROM pixels x JOIN p USING (img)),
e AS (SELECT *, CASE WHEN hi > lo THEN 255 / (hi - lo) * (v - e_min) ELSE 0 END AS eq FROM q)"""


def _equalised(spark, d):
    pixels = domain.tile_pixels(spark, d)
    return raster.equalise(pixels, raster.dra_parameters(raster.cumulative(raster.histogram(pixels))))


@query(f"SELECT * FROM (WITH {_EQ} SELECT img, tile, px, py, v, round(eq, 6) AS eq FROM e)")
def r8_equalise(spark, d):
    return _equalised(spark, d).select("img", "tile", "px", "py", "v", F.round("eq", 6).alias("eq"))


@query(f"SELECT * FROM (WITH {_EQ} SELECT img, tile, px, py, round(CASE WHEN v = 0 THEN 0 ELSE pow(greatest(0, least(1, eq * (1 / 255.0::DOUBLE))), 0.8::DOUBLE) END, 6) AS tone FROM e)")
def r9_tone_curve(spark, d):
    return raster.tone_curve(_equalised(spark, d)).select("img", "tile", "px", "py", F.round("tone", 6).alias("tone"))


@query("SELECT img, tile, px // 2 AS px, py // 2 AS py, round(avg(v), 6) AS v FROM pixels GROUP BY img, tile, px // 2, py // 2")
def r14_reduce_by_two(spark, d):
    return raster.reduce_by_two(domain.tile_pixels(spark, d)).select("img", "tile", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.round("v", 6).alias("v"))


@query("SELECT img, rset, x, y, size, coalesce(sum(size) OVER (PARTITION BY img ORDER BY rset, y, x, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM objects")
def w1_index_offsets(spark, d):
    return raster.offsets(domain.tile_objects(spark, d))


@query("SELECT img, rset, x, y, size, o AS \"offset\" FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY img ORDER BY rset, y, x, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM objects) WHERE o < 60000 AND o + size > 20000")
def j14_byte_range(spark, d):
    return raster.offsets(domain.tile_objects(spark, d)).filter("offset < 60000 AND offset + size > 20000")


@query("SELECT img, sum(size)::BIGINT AS bytes, count(*) AS n FROM objects GROUP BY img")
def a17_index_bytes(spark, d):
    return domain.tile_objects(spark, d).groupBy("img").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


@query("SELECT location, usr AS \"user\", n AS \"requestCount\" FROM summaries WHERE usr = 'u7' AND length(location) = 5")
def p1_term_filters(spark, d):
    return warehouse.search_summaries(_summaries(spark, d), "u7", 5, limit=None)


@query("SELECT location, usr AS \"user\", n AS \"requestCount\" FROM summaries WHERE usr = 'global' AND location IN (SELECT location FROM cells WHERE floor((min_lon + 180) / 360 * pow(2, ceil(p * 2.5))) / pow(2, ceil(p * 2.5)) * 360 - 180 BETWEEN -60 AND 90 AND floor((min_lat + 90) / 180 * pow(2, floor(p * 2.5))) / pow(2, floor(p * 2.5)) * 180 - 90 BETWEEN -30 AND 40)")
def p5_bbox_search(spark, d):
    return warehouse.search_summaries(_summaries(spark, d), bbox="-60,-30,90,40", limit=None)


@query("SELECT location, usr AS \"user\", n AS \"requestCount\" FROM summaries WHERE location LIKE 's%'")
def p10_cell_prefix(spark, d):
    return _summaries(spark, d).filter(F.col("location").startswith("s"))


@query("SELECT location, usr AS \"user\", n AS \"requestCount\" FROM summaries WHERE usr = 'global' ORDER BY location, usr LIMIT 10000")
def o2_capped_search(spark, d):
    return warehouse.search_summaries(_summaries(spark, d))


@query("SELECT *, row_number() OVER (PARTITION BY img ORDER BY rset, y, x, size)::BIGINT AS position FROM objects")
def o1_tile_order(spark, d):
    return raster.ordered(domain.tile_objects(spark, d))


@query("SELECT DISTINCT usr AS \"user\" FROM summaries WHERE usr <> 'global' AND usr NOT IN (SELECT 'u' || (c_custkey % 33) FROM customer)")
def j6_unseen_users(spark, d):
    users = read(spark, d, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 33).cast("string")).alias("user"))
    return warehouse.unseen_users(_summaries(spark, d), users)


@query("SELECT o_custkey AS k, o_orderdate AS at, o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def k1_upsert_latest(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("v"))
    rows = rows.withColumn("o", F.struct("at", "v"))
    return warehouse.upsert(rows.filter("v % 2 = 0"), rows.filter("v % 2 = 1"), ["k"], "o").drop("o")


@query(f"SELECT img, collected FROM images WHERE collected >= {10 * domain.DAY_MS} AND collected <= {40 * domain.DAY_MS} AND lon0 + 0.16384 >= -100 AND lon0 <= 120 AND lat0 >= -50 AND lat0 - 0.16384 <= 50")
def s8_catalog_search(spark, d):
    images = domain.images(spark, d).withColumns({"min_lon": F.col("lon0"), "max_lon": F.col("lon0") + 0.16384, "max_lat": F.col("lat0"), "min_lat": F.col("lat0") - 0.16384})
    return warehouse.catalog_search(images, 10 * domain.DAY_MS, 40 * domain.DAY_MS, "-100,-50,120,50", limit=None).select("img", "collected")


_TILES = "tiles AS (SELECT img, rset, x, y, lon0, lat0, width, height FROM images, range(0, 5) AS r(rset), range(0, 16) AS a(x), range(0, 16) AS b(y) WHERE x < ceil(floor(width / 2 ** rset) / 512) AND y < ceil(floor(height / 2 ** rset) / 512))"


@query(f"SELECT * FROM (WITH {_TILES} SELECT img, rset::INT AS rset, x, y FROM tiles)")
def f10_all_tiles(spark, d):
    return priority.all_tiles(domain.images(spark, d))


_SCORE = f"""{_TILES}, b AS (SELECT *, lon0 + x * 512 * (2 ** rset) * 0.00002 AS w, lat0 - least((y + 1) * 512 * (2 ** rset), height) * 0.00002 AS s, lon0 + least((x + 1) * 512 * (2 ** rset), width) * 0.00002 AS e FROM tiles),
k AS (SELECT *, {domain.haversine_sql("s", "w", "s", "e")} AS km FROM b), pp AS (SELECT *, {domain.precision_sql("km")} AS p FROM k), g AS (SELECT *, {domain.geohash_sql("s", "w", "p")} AS location FROM pp),
m AS (SELECT location, sum(n)::BIGINT AS score FROM summaries WHERE usr = 'global' GROUP BY location)"""


@query(f"SELECT * FROM (WITH {_SCORE} SELECT img, rset::INT AS rset, x, y, score FROM g JOIN m USING (location) WHERE score >= 1)")
def j2_tile_scores(spark, d):
    return priority.tile_scores(domain.images(spark, d), _summaries(spark, d))


@query(f"SELECT * FROM (WITH {_SCORE} SELECT img, count(*) AS tiles, sum(score)::BIGINT AS score FROM g JOIN m USING (location) GROUP BY img)")
def a4_scores_by_image(spark, d):
    return priority.tile_scores(domain.images(spark, d), _summaries(spark, d)).groupBy("img").agg(F.count("*").alias("tiles"), F.sum("score").alias("score"))


def _pairs(spark, d):
    return priority.spatial_join(priority.areas(_summaries(spark, d)), priority.footprints(domain.images(spark, d)))


_AREAS = """ar AS (SELECT usr, location, n, length(location) AS p, any_value(gx) AS gx, any_value(gy) AS gy FROM (SELECT s.usr, s.location, s.n, floor((c.min_lon + 180) / 360 * pow(2, ceil(c.p * 2.5))) AS gx, floor((c.min_lat + 90) / 180 * pow(2, floor(c.p * 2.5))) AS gy FROM summaries s JOIN cells c USING (location) WHERE s.usr <> 'global') GROUP BY usr, location, n),
bx AS (SELECT usr, location, n, gx / pow(2, ceil(p * 2.5)) * 360 - 180 AS w, (gx + 1) / pow(2, ceil(p * 2.5)) * 360 - 180 AS e, gy / pow(2, floor(p * 2.5)) * 180 - 90 AS s, (gy + 1) / pow(2, floor(p * 2.5)) * 180 - 90 AS nn FROM ar)"""


@query(f"SELECT * FROM (WITH {_AREAS} SELECT usr AS \"user\", location, round(w, 9) AS min_lon, round(s, 9) AS min_lat, round(e, 9) AS max_lon, round(nn, 9) AS max_lat FROM bx)")
def f4_areas_of_interest(spark, d):
    a = priority.areas(_summaries(spark, d))
    return a.select("user", "location", *(F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


@query(f"SELECT * FROM (WITH {_AREAS} SELECT usr AS \"user\", location, img FROM bx JOIN images ON w < lon0 + 0.16384 AND e > lon0 AND s < lat0 AND nn > lat0 - 0.16384)")
def j3_areas_on_images(spark, d):
    return _pairs(spark, d).select("user", "location", "img")


@query(f"SELECT * FROM (WITH {_AREAS} SELECT DISTINCT img FROM bx JOIN images ON w < lon0 + 0.16384 AND e > lon0 AND s < lat0 AND nn > lat0 - 0.16384)")
def j4_images_wanted(spark, d):
    return priority.touched(priority.footprints(domain.images(spark, d)), priority.areas(_summaries(spark, d))).select("img")


@query()
def g22_prefetch_lists(spark, d):
    return priority.prefetch(_pairs(spark, d))


@query(f"SELECT id, {domain.geohash_sql('lat', 'lon', '6')} AS cell, round({domain.haversine_sql('lat', 'lon', '0.0::DOUBLE', '0.0::DOUBLE')}, 6) AS km FROM points")
def f1_geohash_and_distance(spark, d):
    p = domain.points(spark, d)
    return p.select("id", geo.geohash(F.col("lat"), F.col("lon"), 6).alias("cell"), F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0)), 6).alias("km"))


@query("SELECT id, round(lon / 360 + 0.5, 9) AS mx, round(greatest(0.0, least(1.0, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi())), 9) AS my, greatest(0, least(1023, floor((lon + 180) / 360 * 1024)))::BIGINT AS tx, greatest(0, least(1023, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)))::BIGINT AS ty FROM points")
def f18_map_tiles(spark, d):
    p = domain.points(spark, d)
    x, y = geo.slippy(F.col("lon"), F.col("lat"), 10)
    return p.select("id", F.round(geo.mercator_x(F.col("lon")), 9).alias("mx"), F.round(geo.mercator_y(F.col("lat")), 9).alias("my"), x.cast("long").alias("tx"), y.cast("long").alias("ty"))


@query("SELECT id, round(40075016.686 / 256 * cos(radians(lat)) / pow(2, id % 20), 6) AS gsd, round((CASE WHEN ((lon * 3 + 180) % 360) < 0 THEN ((lon * 3 + 180) % 360) + 360 ELSE (lon * 3 + 180) % 360 END) - 180, 6) AS wrapped FROM points")
def f16_scale_and_wrap(spark, d):
    p = domain.points(spark, d)
    return p.select("id", F.round(geo.map_gsd(F.col("lat"), F.col("id") % 20), 6).alias("gsd"), F.round(geo.wrap_lon(F.col("lon") * 3), 6).alias("wrapped"))


@query("SELECT id, round((6378137.0 / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) + 100) * cos(radians(lat)) * cos(radians(lon)), 3) AS gx, round((6378137.0 / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) + 100) * cos(radians(lat)) * sin(radians(lon)), 3) + 0.0 AS gy, round((6378137.0 / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) * (1 - e2) + 100) * sin(radians(lat)), 3) AS gz FROM points, (SELECT (1 / 298.257222101::DOUBLE) * (2 - 1 / 298.257222101::DOUBLE) AS e2)")
def g9_geocentric(spark, d):
    x, y, z = geo.geocentric(F.col("lon"), F.col("lat"), F.lit(100.0))
    return domain.points(spark, d).select("id", F.round(x, 3).alias("gx"), (F.round(y, 3) + 0.0).alias("gy"), F.round(z, 3).alias("gz"))


@query("SELECT p_partkey AS k, ceil((p_partkey * 31 + 700) / (512.0 * (p_size % 5 + 1)))::BIGINT AS c, greatest(ceil(log2((p_partkey * 31 + 700) / 512.0)), 0)::BIGINT AS top, (p_partkey // 2)::BIGINT AS px FROM part")
def f5_pyramid_numbers(spark, d):
    w = F.col("p_partkey") * 31 + 700
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.ceil(w / (512.0 * (F.col("p_size") % 5 + 1))).alias("c"), tiles.max_rset(w, F.lit(1)).alias("top"), tiles.parent(F.lit(0), F.col("p_partkey"), F.lit(0))["x"].alias("px"))


@query("SELECT DISTINCT img, (rset + 1)::INT AS rset, x // 2 AS x, y // 2 AS y FROM access_log WHERE rset < 4")
def f9_parent_tiles(spark, d):
    log = domain.access_log(spark, d).filter("rset < 4")
    return log.select("img", tiles.parent(F.col("rset"), F.col("x"), F.col("y")).alias("t")).select("img", "t.*").distinct()


@query("SELECT DISTINCT img, (rset - 1)::INT AS rset, x * 2 + i AS x, y * 2 + j AS y FROM access_log, range(0, 2) AS a(i), range(0, 2) AS b(j) WHERE rset > 0")
def f9_child_tiles(spark, d):
    log = domain.access_log(spark, d)
    return log.select("img", F.explode(tiles.children(F.col("rset"), F.col("x"), F.col("y"))).alias("t")).select("img", "t.*").distinct()


@query("SELECT img, rset, x, y FROM (SELECT img, r.rset::INT AS rset, x, y FROM images, range(0, 5) AS r(rset), range(0, 16) AS a(x), range(0, 16) AS b(y) WHERE x < 2 ** (4 - r.rset) AND y < 2 ** (4 - r.rset)) EXCEPT SELECT img, rset, x, y FROM access_log")
def r15_missing_tiles(spark, d):
    return priority.all_tiles(domain.images(spark, d)).join(domain.access_log(spark, d).select("img", "rset", "x", "y"), ["img", "rset", "x", "y"], "left_anti")


@query("SELECT floor((lon / 360 + 0.5) / (40 / 2048.0::DOUBLE))::BIGINT AS cx, floor(greatest(0.0, least(1.0, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi())) / (40 / 2048.0::DOUBLE))::BIGINT AS cy, count(*) AS n FROM points GROUP BY 1, 2")
def c1_grid_clusters(spark, d):
    return cluster.grid_clusters(domain.points(spark, d), 2).select("cx", "cy", "n")


@query()
def a14_greedy_clusters(spark, d):
    return cluster.greedy_clusters(domain.points(spark, d).withColumn("layer", F.lit(0)), "layer")


@query("SELECT a.id, b.id AS other, round(sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2), 6) AS distance FROM points a JOIN points b ON (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2 <= 25")
def j9_points_within(spark, d):
    p = domain.points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return cluster.within(p, p, 5.0, digits=6)


@query("SELECT id, other FROM (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2, b.id) AS r FROM points a JOIN points b ON a.id <> b.id AND (a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2 <= 400) WHERE r = 1")
def j16_nearest_point(spark, d):
    p = domain.points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return cluster.nearest(p, p, 20.0).select("id", "other")


@query("SELECT doc_id, 'en' = lang OR 'src1' = source AS visible FROM documents")
def q2_visible_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", visibility.visible("en|src1", F.array("lang", "source")).alias("visible"))


@query("SELECT lang, list_sort(list(DISTINCT source)) [1] AS first_source, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def a15_sensitivity_union(spark, d):
    labels = read(spark, d, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return labels.select("lang", F.try_element_at("s", F.lit(1)).alias("first_source"), F.size("s").cast("long").alias("n"))


@query("SELECT date_trunc('day', ts) AS day, location, count(*) AS n FROM cells GROUP BY 1, 2")
def x2_daily_windows(spark, d):
    cells = heatmap.located(heatmap.tile_boxes(domain.access_log(spark, d), domain.images(spark, d)))
    return cells.groupBy(F.window("ts", "24 hours").alias("w"), "location").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day") if dict(cells.dtypes)["ts"] == "timestamp_ntz" else F.col("w.start").alias("day"), "location", "n")


@query("SELECT rset, usr AS \"user\", count(*) AS n, grouping(rset)::INT AS all_rsets, grouping(usr)::INT AS all_users FROM access_log GROUP BY CUBE (rset, usr)")
def e1_cube(spark, d):
    log = domain.access_log(spark, d)
    return log.cube("rset", "user").agg(F.count("*").alias("n"), F.grouping("rset").cast("int").alias("all_rsets"), F.grouping("user").cast("int").alias("all_users"))


@query("SELECT img, usr AS \"user\", n, rank() OVER (PARTITION BY img ORDER BY n DESC)::INT AS r, dense_rank() OVER (PARTITION BY img ORDER BY n DESC)::INT AS dr, lag(n) OVER (PARTITION BY img ORDER BY n DESC, usr) AS before FROM (SELECT img, usr, count(*) AS n FROM access_log WHERE usr IS NOT NULL GROUP BY img, usr)")
def e2_ranks(spark, d):
    n = domain.access_log(spark, d).filter("user is not null").groupBy("img", "user").agg(F.count("*").alias("n"))
    w = Window.partitionBy("img").orderBy(F.desc("n"))
    return n.withColumns({"r": F.rank().over(w), "dr": F.dense_rank().over(w), "before": F.lag("n").over(Window.partitionBy("img").orderBy(F.desc("n"), "user"))})


@query("SELECT i.img, count(l.event_id) AS n FROM (SELECT img FROM images UNION ALL SELECT -1) i FULL JOIN access_log l USING (img) GROUP BY i.img")
def e3_outer_join(spark, d):
    images = domain.images(spark, d).select("img").unionAll(spark.sql("SELECT CAST(-1 AS BIGINT) AS img"))
    log = domain.access_log(spark, d).select(F.col("img").alias("i"), "event_id")
    return images.join(log, F.col("img") == F.col("i"), "full").groupBy("img").agg(F.count("event_id").alias("n"))
