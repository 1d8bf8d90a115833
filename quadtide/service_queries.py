"""Queries over keys, requests, documents, control sets and map views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geo, keys, layout, tiles
from .operators import cluster, controls
from .plans import domain
from .plans.domain import read
from .registry import query
from .sinks import documents

_URL = "'http://h/t/c' || (p_partkey % 7) || '/' || (20200101000000 + p_partkey) || CASE WHEN p_partkey % 5 = 0 THEN '/meta.json' ELSE '/metadata.json' END"


@query(f"SELECT k, nullif(regexp_extract(u, '^(.*)/([^/]*)/([^/]*)/metadata.json$', 1), '') AS base, nullif(regexp_extract(u, '^(.*)/([^/]*)/([^/]*)/metadata.json$', 2), '') AS collection, nullif(regexp_extract(u, '^(.*)/([^/]*)/([^/]*)/metadata.json$', 3), '') AS ts FROM (SELECT p_partkey AS k, {_URL} AS u FROM part)")
def f26_metadata_urls(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 5 == 0, "/meta.json").otherwise("/metadata.json")
    url = F.concat(F.lit("http://h/t/c"), (k % 7).cast("string"), F.lit("/"), (k + 20200101000000).cast("string"), tail)
    return read(spark, d, "part").select(k.alias("k"), keys.metadata_url(url).alias("m")).select("k", "m.base", "m.collection", F.col("m.timestamp").alias("ts"))


@query("SELECT event_id AS id, event_id % 3 = 0 AS prime, CASE WHEN event_id % 3 = 1 THEN 'u' || user_id END AS usr, 'i' || (event_id % 20) AS image, '2020' AS ts, (event_id % 5)::INT AS rset, (event_id % 9)::INT AS col, (event_id % 8)::INT AS row, CASE WHEN event_id % 4 = 0 THEN -1 ELSE 0 END AS band FROM events")
def p3_tile_urls(spark, d):
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    head = F.when(e % 3 == 0, F.lit("/cache/")).when(e % 3 == 1, F.concat(F.lit("u"), text(F.col("user_id")), F.lit("/"))).otherwise(F.lit("/"))
    band = F.when(e % 4 == 0, "-1").otherwise("0")
    path = F.concat(head, F.lit("i"), text(e % 20), F.lit("/2020/"), F.when(e % 2 == 0, "tile/").otherwise(""), text(e % 5), F.lit("/"), text(e % 9), F.lit("/"), text(e % 8), F.lit("/"), band, F.lit(".png"))
    return read(spark, d, "events").select(e.alias("id"), keys.tile_url(path).alias("t")).select("id", "t.prime", F.col("t.user").alias("usr"), "t.image", F.col("t.timestamp").alias("ts"), "t.rset", "t.col", "t.row", "t.band")


@query("SELECT event_id AS id, 2 AS layers, 'EPSG:4326' AS crs, (event_id % 170)::DOUBLE AS w, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 256 END AS width, 512 AS height, event_id % 2 = 0 AS transparent, '2020-01-01 00:00:00' AS t0 FROM events")
def s25_map_requests(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit("SERVICE=WMS&Layers=a,b&SRS=EPSG%3A4326&bbox="), (e % 170).cast("string"), F.lit(",0,179,10&HEIGHT=512"), F.when(e % 3 == 0, "").otherwise("&width=256"), F.when(e % 2 == 0, "&TRANSPARENT=TRUE").otherwise(""), F.lit("&time=2020-01-01T00:00:00.000"))
    m = read(spark, d, "events").select(e.alias("id"), keys.get_map(text).alias("m"))
    return m.select("id", F.size("m.layers").alias("layers"), "m.crs", F.col("m.bbox")[0].alias("w"), "m.width", "m.height", "m.transparent", F.date_format("m.start", "yyyy-MM-dd HH:mm:ss").alias("t0"))


@query("SELECT p_partkey AS k, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT p_partkey, md5('part' || p_partkey) AS h FROM part)")
def f27_name_uuids(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), keys.name_uuid(F.concat(F.lit("part"), F.col("p_partkey").cast("string"))).alias("id"))


@query("SELECT id, split_part(key, '#', 1) AS location, CASE WHEN usr IS NULL OR usr = 'admin' THEN 'global' ELSE lower(usr) END AS usr FROM (SELECT *, 'c' || (id % 9) || CASE WHEN usr IS NULL THEN '' ELSE '#' || usr END AS key FROM (SELECT event_id AS id, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'admin' ELSE 'U' || user_id END AS usr FROM events))")
def p14_summary_keys(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    tail = F.when(u % 4 == 0, "").when(u % 4 == 1, "#admin").otherwise(F.concat(F.lit("#U"), u.cast("string")))
    return read(spark, d, "events").select(e.alias("id"), keys.summary_key(F.concat(F.lit("c"), (e % 9).cast("string"), tail)).alias("k")).select("id", "k.location", F.col("k.user").alias("usr"))


@query("SELECT p_partkey AS k, round(greatest(0.01, least(50, 0.041253::DOUBLE / (p_size / 100.0::DOUBLE))), 9) AS importance, printf('%.6f,%.6f', p_size / 7.0::DOUBLE, p_partkey / 3.0::DOUBLE) AS box FROM part")
def f23_importance_and_text(spark, d):
    size, k = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(keys.importance(size / 100), 9).alias("importance"), keys.bbox_text(size / 7, k / 3).alias("box"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN 'size' WHEN abs(p_partkey % 400 - 200) > 180 THEN 'longitude' WHEN abs(p_size * 4 - 100) > 90 THEN 'latitude' WHEN p_partkey % 400 - 200 NOT BETWEEN -50 AND 90 OR p_size * 4 - 100 NOT BETWEEN -40 AND 60 THEN 'outside' END AS problem FROM part")
def p16_chip_requests(spark, d):
    lon, lat = F.col("p_partkey") % 400 - 200, F.col("p_size") * 4 - 100
    image = tuple(map(F.lit, (-50, -40, 90, 60)))
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), keys.chip_problem(lon, lat, F.col("p_size") % 10, F.lit(5), image).alias("problem"))


@query("SELECT p_partkey AS k, round(r, 6) AS rset, l::INT AS level, floor(x / (512 * 2 ** l))::BIGINT AS col0, floor(y / (512 * 2 ** l))::BIGINT AS row0, floor((least(x + w, 8192) - 1) / (512 * 2 ** l))::BIGINT AS col1, floor((least(y + 1000, 8192) - 1) / (512 * 2 ** l))::BIGINT AS row1 FROM (SELECT *, greatest(0, least(floor(round(r, 9)), 4)) AS l FROM (SELECT *, -log2(least(256.0::DOUBLE / w, 256.0::DOUBLE / 1000)) AS r FROM (SELECT p_partkey, (p_partkey * 37) % 8000 AS x, (p_partkey * 91) % 8000 AS y, 100 + p_size * 50 AS w FROM part)))")
def g21_chip_windows(spark, d):
    k = F.col("p_partkey")
    eight, out = F.lit(8192), F.lit(256.0)
    w = layout.chip_window((k * 37) % 8000, (k * 91) % 8000, 100 + F.col("p_size") * 50, F.lit(1000), out, out, eight, eight, F.lit(4))
    rows = read(spark, d, "part").select(k.alias("k"), w.alias("w"))
    return rows.select("k", F.round("w.rset", 6).alias("rset"), "w.level", *(F.col(f"w.{c}").cast("long").alias(c) for c in ("col0", "row0", "col1", "row1")))


@query("SELECT img, round(greatest(0, least(lon0 + 0.16384, 30) - greatest(lon0, -100)) * greatest(0, least(lat0, 40) - greatest(lat0 - 0.16384, -30)) / (130 * 70), 12) AS share FROM images")
def g19_view_coverage(spark, d):
    image = (F.col("lon0"), F.col("lat0") - 0.16384, F.col("lon0") + 0.16384, F.col("lat0"))
    return domain.images(spark, d).select("img", F.round(layout.covered(image, tuple(map(F.lit, (-100, -30, 30, 40)))), 12).alias("share"))


@query("SELECT p_partkey AS k, i::INT AS level, (1 << i)::BIGINT AS scale, (((600 + p_partkey * 13) // (1 << i)) + 511) // 512 AS cols, (((900 + p_size * 100) // (1 << i)) + 511) // 512 AS rows FROM part, range(0, 4) AS t(i)")
def f14_matrix_sizes(spark, d):
    k = F.col("p_partkey")
    m = layout.matrix_sizes(600 + k * 13, 900 + F.col("p_size") * 100, F.lit(3))
    return read(spark, d, "part").select(k.alias("k"), F.explode(m).alias("m")).select("k", "m.*")


@query("SELECT p_partkey AS k, CASE m WHEN 1 THEN pix * sample * bands ELSE CASE WHEN bits = 1 THEN (pix + 7) // 8 ELSE pix * sample END END AS block_bytes FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 AND bits <> 1 THEN 1 ELSE 0 END AS m, bits, bands, 4096 AS pix, (bits + 7) // 8 AS sample FROM (SELECT p_partkey, [1, 8, 11, 16][(p_partkey // 4 % 4 + 1)::INT] AS bits, 1 + p_size % 4 AS bands FROM part))")
def s13_block_sizes(spark, d):
    k = F.col("p_partkey")
    mode = F.element_at(F.array(*map(F.lit, "SPBR")), (k % 4 + 1).cast("int"))
    bits = F.element_at(F.array(*map(F.lit, (1, 8, 11, 16))), (F.floor(k / 4) % 4 + 1).cast("int"))
    return read(spark, d, "part").select(k.alias("k"), layout.block_layout(mode, bits, F.lit(4096), 1 + F.col("p_size") % 4, F.lit(9))["block_bytes"].alias("block_bytes"))


@query("SELECT 'c' || p_partkey || ':' || (20200101000000 + p_partkey) AS name, substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2) || 'T' || substr(t, 9, 2) || ':' || substr(t, 11, 2) || ':' || substr(t, 13, 2) || '.000Z' AS date, 'http://s/c' || p_partkey || '/' || t AS \"imageLink\", 'http://s/c' || p_partkey || '/' || t || '/' || (p_size % 6) || '/0/0/0.png' AS \"thumbnailLink\", 2 AS fields FROM (SELECT *, (20200101000000 + p_partkey)::VARCHAR AS t FROM part)")
def k10_catalog_documents(spark, d):
    t = (F.col("p_partkey") + 20200101000000).cast("string")
    meta = F.create_map(F.lit("IDATIM"), t, F.lit("RPC00B"), F.lit("1,2"), F.lit("NBANDS"), F.lit("3"))
    images = read(spark, d, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string"), F.lit(":"), t).alias("name"), (F.col("p_size") % 6).alias("maxRLevel"), meta.alias("metadata"))
    return documents.catalog_documents(images, "http://s").withColumn("fields", F.size("metadata")).drop("metadata")


@query("SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 500 AS batch, left(to_base64(encode(text)), 7900) AS data FROM documents")
def k11_telemetry_batches(spark, d):
    return documents.telemetry_batches(read(spark, d, "documents"), "lang", "doc_id", "text")


@query("SELECT grp, img, (100 + 10 * (row_number() OVER (PARTITION BY grp ORDER BY round(w * h, 9), img) - 1))::BIGINT AS altitude FROM (SELECT img, img % 3 AS grp, 1.0::DOUBLE + (img * 7) % 5 AS w, 2.0::DOUBLE + (img * 3) % 4 AS h FROM images)")
def k8_placemarks(spark, d):
    i = F.col("img")
    boxes = domain.images(spark, d).select("img", (i % 3).alias("grp"), F.col("lon0").alias("west"), F.col("lat0").alias("south"), (F.col("lon0") + 1.0 + (i * 7) % 5).alias("east"), (F.col("lat0") + 2.0 + (i * 3) % 4).alias("north"))
    return documents.placemarks(boxes, "grp", "img").select("grp", "img", F.col("altitude").cast("long").alias("altitude"))


_TOKENS = "tokens AS (SELECT o_orderkey AS k, o_custkey % 40 AS grp, CASE WHEN o_orderkey % 3 = 0 THEN 'CLS:R' ELSE 'CLS:U' END AS c, 'LBL:l' || (o_custkey % 3) AS l, 'ENTITY:e' || (o_custkey % 2) AS e1, 'ENTITY:x' || (o_orderkey % 5) AS e2 FROM orders)"


def _controls(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda p, v: F.concat(F.lit(p), v.cast("string"))
    row = F.array(text("ENTITY:x", o % 5), F.when(o % 3 == 0, "CLS:R").otherwise("CLS:U"), text("LBL:l", c % 3), text("ENTITY:e", c % 2))
    return read(spark, d, "orders").select(o.alias("k"), (c % 40).alias("grp"), row.alias("controls"))


@query(f"SELECT * FROM (WITH {_TOKENS} SELECT k, c || '&' || l || '&(' || e1 || '|' || e2 || ')' AS expr, c = 'CLS:U' AND l = 'LBL:l1' AND (e1 = 'ENTITY:e0' OR e2 = 'ENTITY:x2') AS seen, CASE WHEN c = 'CLS:U' THEN 'open with tags' END AS error FROM tokens)")
def q5_control_expressions(spark, d):
    c = F.col("controls")
    auths = F.array(*map(F.lit, ("CLS:U", "LBL:l1", "ENTITY:e0", "ENTITY:x2")))
    return _controls(spark, d).select("k", controls.expression(c).alias("expr"), controls.accessible(c, auths).alias("seen"), F.try_element_at(controls.errors(c), F.lit(1)).alias("error"))


@query(f"SELECT * FROM (WITH {_TOKENS}, m AS (SELECT grp, count(*) AS n, max(c) FILTER (WHERE c = 'CLS:R') AS r FROM tokens GROUP BY grp), t AS (SELECT grp, l AS t FROM tokens UNION SELECT grp, coalesce(r, 'CLS:U') FROM m UNION SELECT grp, t FROM (SELECT grp, t, count(*) AS c FROM (SELECT grp, unnest([e1, e2]) AS t FROM tokens) GROUP BY grp, t) JOIN m USING (grp) WHERE c = n) SELECT grp, string_agg(t, ',' ORDER BY t) AS controls, false AS conflict FROM t GROUP BY grp)")
def a15_control_roll_up(spark, d):
    return controls.roll_up(_controls(spark, d), ["grp"]).select("grp", F.array_join("controls", ",").alias("controls"), "conflict")


@query("SELECT id FROM points WHERE (lon >= 100 OR lon <= -120) AND lat BETWEEN -30 AND 40")
def u1_across_antimeridian(spark, d):
    p = cluster.projected(domain.points(spark, d)).select("id", F.lit(3).alias("zoom"), F.col("mx").alias("x"), F.col("my").alias("y"))
    return cluster.clusters_in(p, (100, -30.0000001, 240, 40.0000001), 3).select("id")


@query("SELECT id, tx, ty FROM (SELECT id, floor(512 * (mx * 4 - 0) + 0.5)::BIGINT AS tx, floor(512 * (my * 4 - 1) + 0.5)::BIGINT AS ty, mx, my FROM (SELECT id, lon / 360 + 0.5 AS mx, greatest(0.0, least(1.0, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi())) AS my FROM points) WHERE mx BETWEEN -0.078125 / 4 AND 1.078125 / 4 AND my BETWEEN 0.921875 / 4 AND 2.078125 / 4 UNION ALL SELECT id, floor(512 * (mx * 4 - 4) + 0.5)::BIGINT, floor(512 * (my * 4 - 1) + 0.5)::BIGINT, mx, my FROM (SELECT id, lon / 360 + 0.5 AS mx, greatest(0.0, least(1.0, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi())) AS my FROM points) WHERE mx BETWEEN 1 - 0.078125 / 4 AND 1 AND my BETWEEN 0.921875 / 4 AND 2.078125 / 4)")
def c3_map_tile(spark, d):
    p = cluster.projected(domain.points(spark, d)).select("id", F.lit(2).alias("zoom"), F.col("mx").alias("x"), F.col("my").alias("y"))
    return cluster.map_tile(p, 2, 0, 1).select("id", "tx", "ty")


@query("SELECT img, event_id FROM (SELECT img, event_id, row_number() OVER (PARTITION BY img ORDER BY ts, event_id) AS r FROM access_log) WHERE r BETWEEN 4 AND 8")
def w6_pages(spark, d):
    return cluster.page(domain.access_log(spark, d), ["img"], ["ts", "event_id"], 5, 3).select("img", "event_id")


@query("SELECT img, event_id, (row_number() OVER (PARTITION BY img ORDER BY ts, event_id) - 1) / count(*) OVER (PARTITION BY img)::DOUBLE AS z, lag(ts, 2) OVER (PARTITION BY img ORDER BY ts, event_id) AS before FROM access_log")
def w9_layer_order(spark, d):
    w = Window.partitionBy("img").orderBy("ts", "event_id")
    z = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("img"))
    return domain.access_log(spark, d).select("img", "event_id", z.alias("z"), F.lag("ts", 2).over(w).alias("before"))


@query("SELECT c_custkey AS k, coalesce(a.v, b.v, 'miss') AS v FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS c_custkey, 'near' AS v FROM orders WHERE o_orderstatus = 'P') a USING (c_custkey) LEFT JOIN (SELECT DISTINCT o_custkey AS c_custkey, 'far' AS v FROM orders WHERE o_orderstatus = 'F') b USING (c_custkey)")
def x8_tiered_lookup(spark, d):
    tier = lambda status, name: read(spark, d, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k")).distinct().withColumn(name, F.lit(name))
    asked = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return asked.join(tier("P", "near"), "k", "left").join(tier("F", "far"), "k", "left").select("k", F.coalesce("near", "far", F.lit("miss")).alias("v"))


_SLIPPY = "least(greatest(floor((lon + 180) / 360 * 1024), 0), 1023)::BIGINT AS x, least(greatest(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024), 0), 1023)::BIGINT AS y"


@query(f"""SELECT id, x, y, round(x / 1024 * 360 - 180, 9) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * y / 1024)))), 9) AS north,
    (CASE WHEN x IN (0, 1023) THEN 2 ELSE 3 END) * (CASE WHEN y IN (0, 1023) THEN 2 ELSE 3 END) - 1 AS neighbours, 4 * (x + y) * 2 + 4 AS child_sum FROM (SELECT id, {_SLIPPY} FROM points)""")
def f18_tile_corners(spark, d):
    x, y = geo.slippy(F.col("lon"), F.col("lat"), 10)
    at = domain.points(spark, d).select("id", x.cast("long").alias("x"), y.cast("long").alias("y"))
    west, north = geo.slippy_corner(F.col("x"), F.col("y"), 10)
    child_sum = F.aggregate(geo.slippy_children(F.col("x"), F.col("y")), F.lit(0).cast("long"), lambda acc, t: acc + t["x"] + t["y"])
    around = F.size(geo.slippy_neighbours(F.col("x"), F.col("y"), 10))
    return at.select("id", "x", "y", F.round(west, 9).alias("west"), F.round(north, 9).alias("north"), around.alias("neighbours"), child_sum.alias("child_sum"))


def _mercator_y_sql(lat: str) -> str:
    return f"least(1, greatest(0, 0.5 - 0.25 * ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / pi()))"


@query(f"""SELECT id, x, y FROM (SELECT id, greatest(0, (lon - 3.3 + 180) / 360) AS w, least(1, (lon + 3.3 + 180) / 360) AS e, {_mercator_y_sql('(lat + 2.2)')} AS n, {_mercator_y_sql('(lat - 2.2)')} AS s FROM points) b, range(0, 64) AS c(x), range(0, 64) AS r(y) WHERE x <= e * 64 AND x + 1 >= w * 64 AND y <= s * 64 AND y + 1 >= n * 64""")
def u6_viewport_tiles(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    met = geo.viewport_tiles(lon - 3.3, lat - 2.2, lon + 3.3, lat + 2.2, 6)
    return domain.points(spark, d).select("id", F.explode(met).alias("t")).select("id", "t.*")


@query("SELECT event_id, rset, x + 1 AS x, y - 1 AS y FROM access_log WHERE x + 1 < 2 ** (4 - rset) AND y > 0")
def f9_border_tiles(spark, d):
    beside = tiles.border(F.lit(8192), F.lit(8192), F.col("rset"), F.col("x"), F.col("y"), 1, -1)
    return domain.access_log(spark, d).select("event_id", beside.alias("t")).filter("t is not null").select("event_id", "t.*")


@query("SELECT p_partkey AS k, (p_size % 5)::INT AS rset, (p_partkey % 40 * 33) // (2 ** (p_size % 5))::BIGINT AS first_row FROM part")
def r16_part_offsets(spark, d):
    k, rset = F.col("p_partkey"), (F.col("p_size") % 5).cast("int")
    return read(spark, d, "part").select(k.alias("k"), rset.alias("rset"), tiles.part_offset(k % 40, F.lit(33), rset).cast("long").alias("first_row"))


@query("SELECT img, round(atan2(-(img % 7 - 3), -(img % 11 + 1)), 9) AS angle FROM images")
def g15_angle_off_north(spark, d):
    img, lon, lat = F.col("img"), F.col("lon0"), F.col("lat0")
    return domain.images(spark, d).select("img", F.round(geo.angle_off_north(lon, lat, lon + img % 7 - 3, lat - img % 11 - 1), 9).alias("angle"))
