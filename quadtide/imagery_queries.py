"""Queries over tiles as rasters, and warps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import camera, frame, polygon
from .operators import raster, warp
from .plans import domain
from .plans.domain import read
from .registry import query
from .sinks import documents


def _placed(spark, d):
    """Tiles of pixels on a 16-wide grid of their image."""
    t = F.col("tile")
    return domain.tile_pixels(spark, d).select("img", (t % 16).alias("col"), F.floor(t / 16).alias("row"), "px", "py", "v")


@query("SELECT img, tile, px, py, sum(v) OVER (PARTITION BY img, tile, px ORDER BY py ROWS UNBOUNDED PRECEDING)::BIGINT AS area FROM (SELECT img, tile, px, py, sum(v) OVER (PARTITION BY img, tile, py ORDER BY px ROWS UNBOUNDED PRECEDING) AS v FROM pixels)")
def a11_summed_area(spark, d):
    return raster.summed_area(domain.tile_pixels(spark, d)).select("img", "tile", "px", "py", "area")


@query("SELECT img, (col // 2)::BIGINT AS col, (row // 2)::BIGINT AS row, ((col % 2 * 8 + px) // 2)::BIGINT AS px, ((row % 2 * 8 + py) // 2)::BIGINT AS py, round(avg(v), 6) AS v FROM (SELECT img, tile % 16 AS col, tile // 16 AS row, px, py, v FROM pixels) GROUP BY 1, 2, 3, 4, 5")
def r14_parent_tiles(spark, d):
    return raster.reduce_tiles(_placed(spark, d), 8).withColumn("v", F.round("v", 6))


@query("SELECT img, (x // 6)::BIGINT AS col, (y // 6)::BIGINT AS row, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT img, tile % 16 * 8 + px AS x, tile // 16 * 8 + py AS y, v FROM pixels) GROUP BY 1, 2, 3")
def r12_cut_tiles(spark, d):
    whole = _placed(spark, d).select("img", (F.col("col") * 8 + F.col("px")).alias("x"), (F.col("row") * 8 + F.col("py")).alias("y"), "v")
    return raster.cut(whole, 6).groupBy("img", "col", "row").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT img, tile, px, py, CASE WHEN tile % 2 = 0 THEN v + 2 ELSE v END AS r, CASE WHEN tile % 2 = 0 THEN v + 1 ELSE v END AS g, v AS b, 255 AS a FROM pixels")
def r2_merge_bands(spark, d):
    many = F.when(F.col("tile") % 2 == 0, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    bands = domain.tile_pixels(spark, d).withColumn("band", F.explode(many)).withColumn("v", F.col("v") + F.col("band"))
    return raster.merge_bands(bands)


@query("SELECT img, tile, px * 8 + py AS id, round(coalesce(0.75::DOUBLE * v + 0.25::DOUBLE * w, v), 6) AS value FROM (SELECT *, lead(v) OVER (PARTITION BY img, tile, py ORDER BY px) AS w FROM pixels)")
def r3_bilinear(spark, d):
    pixels = domain.tile_pixels(spark, d)
    points = pixels.select("img", "tile", (F.col("px") * 8 + F.col("py")).alias("id"), (F.col("px") + 0.25).alias("u"), F.col("py").cast("double").alias("v"))
    return raster.sample(points, pixels).withColumn("value", F.round("value", 6))


@query("SELECT l.img, l.rset, l.x, l.y, min(s.rset)::INT AS served FROM (SELECT DISTINCT img, rset, x, y FROM access_log) l LEFT JOIN (SELECT DISTINCT img, rset, x, y FROM access_log WHERE usr IS NULL) s ON s.img = l.img AND s.rset >= l.rset AND s.x = l.x >> (s.rset - l.rset) AND s.y = l.y >> (s.rset - l.rset) GROUP BY 1, 2, 3, 4")
def r1_finest_stored(spark, d):
    log = domain.access_log(spark, d)
    return raster.finest(log.select("img", "rset", "x", "y"), log.filter("user IS NULL"), 4)


@query("SELECT img, block, CASE WHEN size % 7 <> 0 THEN 1000 + coalesce(sum(CASE WHEN size % 7 = 0 THEN 0 ELSE size END) OVER (PARTITION BY img ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS \"offset\" FROM (SELECT img, x * 10 + y AS block, max(size) AS size FROM objects GROUP BY 1, 2)")
def s14_masked_blocks(spark, d):
    blocks = domain.tile_objects(spark, d).groupBy("img", (F.col("x") * 10 + F.col("y")).alias("block")).agg(F.max("size").alias("size")).withColumn("masked", F.col("size") % 7 == 0)
    return raster.block_offsets(blocks, 1000).select("img", "block", "offset")


@query("SELECT grp, n, round(mu - b * mx - c * my, 6) + 0.0 AS c0, round(b, 6) AS c1, round(c, 6) AS c2 FROM (SELECT *, (sxu * syy - syu * sxy) / (sxx * syy - sxy * sxy) AS b, (syu * sxx - sxu * sxy) / (sxx * syy - sxy * sxy) AS c FROM (SELECT id % 3 AS grp, count(*) AS n, avg(lon) AS mx, avg(lat) AS my, avg(u) AS mu, covar_pop(lon, u) AS sxu, covar_pop(lat, u) AS syu, var_pop(lon) AS sxx, var_pop(lat) AS syy, covar_pop(lon, lat) AS sxy FROM (SELECT *, 3 + 2 * lon - 0.5::DOUBLE * lat + id % 7 AS u FROM points) GROUP BY 1))")
def a18_warp_fit(spark, d):
    x, y = F.col("lon"), F.col("lat")
    ties = domain.points(spark, d).select((F.col("id") % 3).alias("grp"), x.alias("x"), y.alias("y"), (3 + 2 * x - 0.5 * y + F.col("id") % 7).alias("u"), (x - y).alias("v"))
    fit = warp.fit_warp(ties, "grp", 1)
    return fit.select("grp", "n", *((F.round(F.col("cu")[i], 6) + 0.0).alias(f"c{i}") for i in range(3)))


def _resampled_sql(kernel: str) -> str:
    taps = "(SELECT *, a - 0.25::DOUBLE AS f, b - 0.75::DOUBLE AS g FROM (SELECT x.x AS a, y.y AS b FROM range(-1, 3) AS x(x), range(-1, 3) AS y(y)))"
    weight = f"({kernel.format('f')}) * ({kernel.format('g')})"
    return f"SELECT img, tile, id, round(sum(w * v) / sum(w), 6) + 0.0 AS value FROM (SELECT p.img, p.tile, p.px * 8 + p.py AS id, q.v, {weight} AS w FROM pixels p, {taps} t JOIN pixels q ON q.img = p.img AND q.tile = p.tile AND q.px = p.px + t.a AND q.py = p.py + t.b) GROUP BY 1, 2, 3"


def _resampled(spark, d, mode):
    pixels = domain.tile_pixels(spark, d)
    points = pixels.select("img", "tile", (F.col("px") * 8 + F.col("py")).alias("id"), (F.col("px") + 0.25).alias("u"), (F.col("py") + 0.75).alias("v"))
    return raster.resample(points, pixels, mode).withColumn("value", F.round("value", 6) + 0.0)


@query(_resampled_sql("1 - abs({0}) / 2"))
def r3_bicubic(spark, d):
    return _resampled(spark, d, "bicubic")


@query(_resampled_sql("CASE WHEN abs({0}) < 1 THEN 1.5::DOUBLE * abs({0}) ** 3 - 2.5::DOUBLE * {0} ** 2 + 1 ELSE -0.5::DOUBLE * abs({0}) ** 3 + 2.5::DOUBLE * {0} ** 2 - 4 * abs({0}) + 2 END"))
def r3_catmull(spark, d):
    return _resampled(spark, d, "catmull")


@query("SELECT p.id AS view, i::INT AS i, j::INT AS j, min(g.img)::BIGINT AS img FROM points p, range(0, 8) AS a(i), range(0, 8) AS b(j) JOIN images g ON lon - 10 + (i + 0.5::DOUBLE) * 2.5::DOUBLE >= lon0 - 15 AND lon - 10 + (i + 0.5::DOUBLE) * 2.5::DOUBLE < lon0 + 15 AND lat - 10 + (j + 0.5::DOUBLE) * 2.5::DOUBLE >= lat0 - 15 AND lat - 10 + (j + 0.5::DOUBLE) * 2.5::DOUBLE < lat0 + 15 GROUP BY 1, 2, 3")
def j12_mosaic(spark, d):
    box = lambda x, y, r, prefix: [(F.col(c) + s * r).alias(prefix + n) for c, s, n in ((x, -1, "min_lon"), (y, -1, "min_lat"), (x, 1, "max_lon"), (y, 1, "max_lat"))]
    views = domain.points(spark, d).select(F.col("id").alias("view"), *box("lon", "lat", 10, ""))
    layers = domain.images(spark, d).select("img", F.col("img").alias("z"), *box("lon0", "lat0", 15, "img_"))
    return raster.mosaic(views, layers, 8, 8)


_AREA = ((-120.0, -50.5), (130.0, -40.5), (10.0, 0.5), (140.0, 60.5), (-100.0, 50.5))


@query(f"SELECT id FROM points JOIN (VALUES {', '.join(str((*a, *b)) for a, b in zip(_AREA, _AREA[1:] + _AREA[:1], strict=True))}) AS e(ax, ay, bx, byy) ON (ay > lat) <> (byy > lat) AND lon < ax::DOUBLE + (bx - ax)::DOUBLE * (lat - ay)::DOUBLE / (byy - ay)::DOUBLE GROUP BY id HAVING count(*) % 2 = 1")
def p7_points_in_area(spark, d):
    wkt = f"POLYGON (({', '.join(f'{x} {y}' for x, y in _AREA)}))"
    points = domain.points(spark, d)
    return points.filter(polygon.contains(polygon.ring_of_wkt(F.lit(wkt)), F.col("lon"), F.col("lat"))).select("id")


@query("SELECT id, round(greatest(0, least(lon + 9, 60) - greatest(lon - 7, -80)) * greatest(0, least(lat + 8, 50) - greatest(lat - 4, -30)), 6) AS area FROM points")
def j11_clipped_areas(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    window = polygon.ring_of_box(*map(F.lit, (-80, -30, 60, 50)))
    part = polygon.clip(polygon.ring_of_box(lon - 7, lat - 4, lon + 9, lat + 8), window)
    return domain.points(spark, d).select("id", F.round(polygon.signed_area(part), 6).alias("area"))


_N = "6378137.0::DOUBLE / sqrt(1 - 0.006694380022900788::DOUBLE * sin(radians(lat)) ** 2)"


@query(f"SELECT id, round(radians(1) * n * cos(radians(lat)), 1) AS east, round(radians(1) * n * (1 - 0.006694380022900788::DOUBLE) / (1 - 0.006694380022900788::DOUBLE * sin(radians(lat)) ** 2), 1) AS north FROM (SELECT *, {_N} AS n FROM points)")
def g10_local_frame(spark, d):
    lon, lat, none = F.col("lon"), F.col("lat"), F.lit(0.0)
    x, _, _ = frame.to_local((lon, lat, none), lon + 1, lat, none)
    _, y, _ = frame.to_local((lon, lat, none), lon, lat + 1, none)
    return domain.points(spark, d).select("id", F.round(x, 1).alias("east"), F.round(y, 1).alias("north"))


@query(f"SELECT id, round(degrees(2 * 500 / (n * cos(radians(lat)))), 7) AS width, round(degrees(2 * 1000 * (1 - 0.006694380022900788::DOUBLE * sin(radians(lat)) ** 2) / (n * (1 - 0.006694380022900788::DOUBLE))), 7) AS height FROM (SELECT *, {_N} AS n FROM points)")
def g20_chips_around_points(spark, d):
    e = frame.chip_envelope(F.col("lon"), F.col("lat"), F.lit(500.0), F.lit(256), F.lit(512))
    rows = domain.points(spark, d).select("id", e.alias("e"))
    return rows.select("id", F.round(F.col("e.east") - F.col("e.west"), 7).alias("width"), F.round(F.col("e.north") - F.col("e.south"), 7).alias("height"))


@query("SELECT id, floor(320 + ln(tan(radians(lat) / 2 + pi() / 4)) * 100 + 1e-9::DOUBLE)::BIGINT AS sx, floor(240 + radians(lon) * 100 + 1e-9::DOUBLE)::BIGINT AS sy FROM points")
def g18_screen_points(spark, d):
    none = F.lit(0.0)
    view = frame.View(none, none, F.lit(frame.MERCATOR_RADIUS / 100), F.lit(640), F.lit(480), F.lit(1.5707963267948966))
    sx, sy = view.geodetic_to_screen(F.col("lon"), F.col("lat"))
    return domain.points(spark, d).select("id", sx.alias("sx"), sy.alias("sy"))


@query("SELECT p_partkey AS k, count(*) AS matrices, sum((((900 + p_size * 100) // (1 << i)) + 511) // 512)::BIGINT AS cols FROM part, range(0, 4) AS t(i) GROUP BY 1")
def k12_tile_capabilities(spark, d):
    k = F.col("p_partkey")
    box = tuple(map(F.lit, (1.5, 2.5, 3.5, 4.5)))
    xml = documents.tile_capabilities(F.concat(F.lit("c&"), k.cast("string")), F.lit("20200101"), box, 600 + k * 13, 900 + F.col("p_size") * 100, F.lit(3))
    found = F.regexp_extract_all(xml, F.lit(r"<MatrixWidth>(\d+)</MatrixWidth>"), F.lit(1))
    return read(spark, d, "part").select(k.alias("k"), F.size(found).cast("long").alias("matrices"), F.aggregate(found, F.lit(0).cast("long"), lambda s, v: s + v.cast("long")).alias("cols"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * (1000 - p_partkey % 50))::DOUBLE END AS line_off, CASE WHEN p_partkey % 3 <> 0 THEN (p_size * 800)::DOUBLE END AS line_scale, CASE WHEN p_partkey % 3 <> 0 THEN 7.0::DOUBLE END AS eighth FROM part")
def g3_cameras_of_metadata(spark, d):
    k = F.col("p_partkey")
    names = {"LINE_OFF": 1000, "LINE_SCALE": 800, "SAMP_OFF": 900, "SAMP_SCALE": 700, "LONG_OFF": 5, "LONG_SCALE": 1, "LAT_OFF": 6, "LAT_SCALE": 1, "HEIGHT_OFF": 0, "HEIGHT_SCALE": 100}
    fixed = {n: str(v) for n, v in names.items()} | {f"{n}_COEFF_{i + 1}": str(i) for n in ("LINE_NUM", "LINE_DEN", "SAMP_NUM", "SAMP_DEN") for i in range(20)}
    tags = F.create_map(*(F.lit(v) for pair in fixed.items() for v in pair))
    chip = F.create_map(F.lit("SCALE_FACTOR"), F.col("p_size").cast("string"), F.lit("FI_ROW_11"), (k % 50).cast("string"), F.lit("FI_COL_11"), F.lit("0"))
    metadata = F.create_map(F.when(k % 3 == 0, "OTHER").otherwise("RPC00B"), tags, F.lit("ICHIPB"), chip)
    rows = read(spark, d, "part").select(k.alias("k"), camera.from_metadata(metadata).alias("m"))
    return rows.select("k", F.col("m.LINE_OFF").alias("line_off"), F.col("m.LINE_SCALE").alias("line_scale"), F.col("m.SAMP_NUM")[7].alias("eighth"))
