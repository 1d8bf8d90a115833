"""Functions, operators, readers and services that have no SQL: goldens, round trips and brute force."""

import json
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadtide import service
from quadtide.functions import camera, frame, keys, layout, polygon
from quadtide.operators import cluster, controls, raster, warehouse, warp
from quadtide.sinks import documents
from quadtide.sources import files
from quadtide.sources import tiff as tiff_files
from quadtide.streaming import heatmap as streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def model():
    rng = np.random.default_rng(3)
    m = {f"{n}_{k}": v for n, o, s in (("LONG", 56.36, 0.07), ("LAT", 27.2, 0.07), ("HEIGHT", 10, 500), ("SAMP", 6000, 6000), ("LINE", 7000, 7000)) for k, v in (("OFF", o), ("SCALE", s))}
    for n, main, sign in (("SAMP", 1, 1), ("LINE", 2, -1)):
        m[f"{n}_NUM"] = (rng.normal(0, 1e-4, 20) + sign * np.eye(20)[main]).tolist()
        m[f"{n}_DEN"] = (rng.normal(0, 1e-5, 20) * (np.arange(20) > 0) + np.eye(20)[0]).tolist()
    return m


def test_tile_urls(spark):
    parse = lambda p: one(spark, keys.tile_url(F.lit(p)))[0]
    assert parse("a/1/tile/0/1/2/3.png") == parse("a/1/0/1/2/3.png") == (False, None, "a", "1", 0, 1, 2, 3)
    assert parse("/u/a/1/tile/0/1/2/-1.png") == (False, "u", "a", "1", 0, 1, 2, -1)
    assert parse("/cache/a/1/0/1/2/3.png") == (True, None, "a", "1", 0, 1, 2, 3)
    assert parse("a/1/metadata.json") is None and one(spark, keys.tile_url(F.lit(None).cast("string")))[0] is None


def test_keys(spark):
    row = one(spark, keys.paired_token(F.lit("a:b:c")), keys.paired_token(F.lit(":b")), keys.paired_token(F.lit("a:")), keys.has_extension(F.lit("x.NTF"), ["ntf"]), keys.has_extension(F.lit("ntf"), ["ntf"]), keys.iso_stamp(F.lit(20200102030405)))
    assert row[0] == ("a", "b:c") and row[1] is None and row[2] is None and row[3] and not row[4] and row[5] == "2020-01-02T03:04:05.000Z"
    data = F.lit(bytearray([0, 255, 255, 254]))
    assert tuple(one(spark, keys.big_endian(data, 0, 2), keys.big_endian(data, 2, 2, True), keys.big_endian(data, 3, 2))) == (255, -2, None)


def test_layout(spark):
    size = lambda mode, bits: one(spark, layout.block_layout(F.lit(mode), F.lit(bits), F.lit(64), F.lit(3), F.lit(10)))[0]
    assert size("S", 8) == (64, 640, 64, 3) and size("P", 16) == (384, 0, 192, 1) and size("B", 11) == (128, 128, 64, 3) and size("R", 8) == (64, 0, 192, 1) and size("S", 1)[0] == 8
    assert one(spark, layout.smoothed(F.lit(5.0), F.lit(5.0), 2.0), layout.smoothed(F.lit(5.0), F.lit(50.0), 2.0)) == (5.0, 7.0)
    assert one(spark, layout.cluster_id(F.lit(7), F.lit(3)), *layout.cluster_origin(F.lit(7 * 32 + 4))) == (228, 7, 4)


def test_controls(spark):
    wrong = lambda *t: one(spark, controls.errors(F.array(*map(F.lit, t)) if t else F.array().cast("array<string>")))[0]
    assert wrong("CLS:R", "ENTITY:a") == [] and wrong("CLS:U") == [] and wrong() == ["no class"] and wrong("CLS:U", "CLS:R") == ["many classes"]
    assert wrong("CLS:X") == ["bad class"] and wrong("CLS:U", "LBL:a") == ["open with tags"] and wrong("CLS") == ["bad token"] and wrong("CLS:R", "Q:a") == ["unknown namespace"]
    rows = spark.createDataFrame([(1, ["CLS:U"]), (1, ["CLS:R", "ENTITY:a", "ENTITY:b"]), (1, ["ENTITY:b", "LBL:z"]), (2, ["ENTITY:a", "CLS:U"]), (2, ["ENTITY:b"])], "k int, controls array<string>")
    got = {r.k: (r.controls, r.conflict) for r in controls.roll_up(rows, ["k"]).collect()}
    assert got == {1: (["CLS:R", "ENTITY:b", "LBL:z"], False), 2: (["CLS:U"], True)}
    granted = lambda p: one(spark, controls.permitted(F.lit(p).cast("array<string>") if p is None else F.array(*map(F.lit, p)), {"a": F.lit(True), "b": F.lit(False)}))[0]
    assert granted(["a"]) and not granted(["a", "b"]) and not granted(["c"]) and not granted(None)


def test_warps(spark):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-5, 5, (2, 60))
    for degree in (warp.QUASILINEAR, 1, 2, 3):
        t = warp.warp_terms(x, y, degree)
        cu, cv = rng.normal(size=(2, len(t)))
        ties = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y, "u": sum(a * b for a, b in zip(cu, t, strict=True)), "v": sum(a * b for a, b in zip(cv, t, strict=True))}))
        fit = warp.fit_warp(ties, "k", degree).first()
        assert np.allclose(fit.cu, cu, atol=1e-7) and np.allclose(fit.cv, cv, atol=1e-7) and fit.chi2 < 1e-6
    with pytest.raises(Exception, match="too few"):
        warp.fit_warp(ties.limit(5), "k", 3).collect()
    m = warp.quad_transform([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (3, 3), (0, 1)])
    assert np.allclose(warp.perspective(m, np.array([1.0, 0]), np.array([1.0, 1])), [[3, 0], [3, 1]])
    assert np.allclose(one(spark, *warp.perspective(m, F.lit(1.0), F.lit(1.0))), (3, 3))


def test_camera_fit_and_measures(spark):
    m = model()
    ties = warp.tie_grid(m, 12000, 14000, (-200.0, 0.0, 200.0))
    fit = warp.fit_cameras(spark.createDataFrame(ties.assign(img=1)), "img").first().asDict()
    assert fit["rmse"] < 0.05 and fit["worst"] < 0.2
    s, n = camera.project(fit, *(np.array([v]) for v in (56.35, 27.21, 50.0)))
    assert np.allclose([s, n], camera.project(m, *(np.array([v]) for v in (56.35, 27.21, 50.0))), atol=0.2)
    got = warp.measures(m, 12000, 14000, 0.0)
    assert 0.9 < got["gsd_sample"] < 1.4 and 0.9 < got["gsd_line"] < 1.4
    assert got["area_km2"] == pytest.approx(got["gsd_sample"] * got["gsd_line"] * 12000 * 14000 / 1e6, rel=0.01)
    up, north = warp.orientation(m, 56.36, 27.2, 0.0)
    assert 0 <= up <= 360 and min(north, 360 - north) < 2


def test_blocks(spark):
    v = np.arange(3 * 16, dtype=">u2").reshape(3, 4, 4)
    rows = [(1, i, mode, 3, bytearray(a.tobytes())) for i, (mode, a) in enumerate((("S", v), ("B", v), ("P", v.transpose(1, 2, 0)), ("R", v.transpose(1, 0, 2))))]
    rows += [(1, 4, "S", 3, bytearray(b"x")), (1, 5, "S", 3, None)]
    got = files.read_blocks(spark.createDataFrame(rows, "img int, block int, mode string, bands int, data binary"), 4, 2).toPandas()
    assert sorted(got["block"].unique()) == [0, 1, 2, 3]
    for _, part in got.groupby("block"):
        assert (part["v"].to_numpy() == v[part["band"], part["py"], part["px"]]).all()


def test_reduce_tiles_and_valid(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 255, (16, 16))
    rows = spark.createDataFrame([(1, x, y, int(whole[y, x])) for y in range(16) for x in range(16)], "img int, x int, y int, v int")
    got = raster.reduce_tiles(raster.cut(rows, 8), 8).toPandas()
    assert len(got) == 64 and set(got["col"]) == {0} and set(got["row"]) == {0}
    assert np.allclose(got["v"], whole.reshape(8, 2, 8, 2).mean((1, 3))[got["py"], got["px"]])
    assert one(spark, raster.valid_tile(F.lit(bytearray(b"ab")), 2), raster.valid_tile(F.lit(None).cast("binary"), 2)) == (b"ab", b"\0\0")


def test_readers(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]
    shapes = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"n": "a"}} for k, c in (("Point", [1.5, 2.5]), ("Polygon", square))]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}, indent=1))
    p = files.read_points(spark, str(tmp_path / "g")).collect()
    assert [(r.lon, r.lat, r.properties["n"]) for r in p] == [(1.5, 2.5, "a")]
    a = files.read_areas(spark, str(tmp_path / "g")).first()
    assert (a.west, a.south, a.east, a.north) == (0, 0, 2, 1)
    (tmp_path / "d.xml").write_text("<isd><TIL><TILE><FILENAME>x_R1C2-y.TIF</FILENAME><ULCOLOFFSET>5</ULCOLOFFSET><ULROWOFFSET>6</ULROWOFFSET></TILE><TILE><FILENAME>x_R2_C3.TIF</FILENAME></TILE></TIL></isd>")
    assert sorted((r.part_row, r.part_col, r.x) for r in files.tile_parts(spark, str(tmp_path / "d.xml")).collect()) == [(1, 2, 5), (2, 3, None)]
    assert files.listing(spark, str(tmp_path / "g")).count() == 1
    images = spark.createDataFrame([(1, 8192, 8192, 4), (2, 600, 600, 1)], "img int, width int, height int, max_rset int")
    log = files.access_lines(spark, 50, images)
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, files.access_lines(spark, 50, images).collect()))
    assert log.filter("rset = 0").select("id").distinct().count() == 50 and log.filter("x < 0 OR y < 0").count() == 0


def test_documents(spark):
    boxes = spark.createDataFrame([(1, "big&", 0.0, 0.0, 5.0, 5.0), (1, "small", 0.0, 0.0, 1.0, 1.0)], "g int, name string, west double, south double, east double, north double")
    rows = {r.name: r for r in documents.placemarks(boxes, "g", "name").withColumn("xml", documents.placemark_xml(F.col("name"), F.col("coordinates"))).collect()}
    assert rows["small"].altitude == 100 and rows["big&"].altitude == 110 and "big&amp;" in rows["big&"].xml and rows["small"].coordinates.startswith("0.000000,0.000000,100 1.0")
    entry = documents.index_entries(spark.createDataFrame([(1, 258, 3)], "img int, offset long, size long")).first().entry
    assert bytes(entry) == (258).to_bytes(8, "big") + (3).to_bytes(8, "big")


def test_cluster_tree(spark):
    pts = spark.range(150).select("id", (F.rand(1) * 20).alias("lon"), (F.rand(2) * 20).alias("lat"), F.lit(1).alias("layer"))
    c = cluster.greedy_clusters(pts, "layer", 0, 6).cache()
    size = {(r.zoom, r["index"]): r.n for r in c.collect()}
    kids: dict = {}
    for r in cluster.children(c, "layer").collect():
        kids.setdefault((r.zoom, r["index"]), []).append(r.child_n)
    assert all(sum(kids[k]) == n for k, n in size.items() if k[0] <= 6)
    held = cluster.leaves(c, "layer", 2, 6).collect()
    assert sorted(r.id for r in held) == list(range(150))
    counts = pd.Series([r["index"] for r in held]).value_counts().to_dict()
    assert counts == {k[1]: n for k, n in size.items() if k[0] == 2}
    for r in cluster.expansion_zoom(c, "layer", 6).collect():
        z, i = r.zoom, r["index"]
        assert z < r.expands <= 7 and (len(kids[z, i]) == 1 or r.expands == z + 1)
    c.unpersist()


def test_service(spark, tmp_path):
    w = service.Warehouse(spark, str(tmp_path))
    assert w.users().count() == 0
    put = lambda rows, stamp: w.put_summaries(spark.createDataFrame(rows, "location string, user string, start bigint, requestCount bigint"), stamp)
    assert put([("u4pr", "Ann", 1, 5), ("u4pr", "global", 1, 5), (None, "x", 1, 1)], 1) == (2, 1, "summaries")
    assert put([("u4pr", "ann", 1, 7), ("s000", "bob", 2, 1)], 2) == (2, 0, "summaries")
    assert put([("u4pr", "ann", 1, 7), ("s000", "bob", 2, 1)], 2) == (2, 0, "summaries")
    assert sorted(r.user for r in w.users().collect()) == ["ann", "bob", "x"]
    assert [r.requestCount for r in w.search_summaries("ann").collect()] == [7] and w.search_summaries().count() == 1
    assert w.search_summaries("bob", start=3, end=4).count() == 1 and w.search_summaries("bob", start=3, end=4, apply_time_range=True).count() == 0
    before = sorted(map(str, w.table("summaries").collect()))
    w.compact("summaries", 9)
    assert sorted(map(str, w.table("summaries").collect())) == before
    lists = spark.createDataFrame([("ann", 1, 100, [(0, 1, 2)])], service.TABLES["cache_lists"][1])
    w.put("cache_lists", lists, 1)
    assert w.cache_lists("ann", 50).count() == 1 and sorted(r.user for r in w.users_to_update(120, 30).collect()) == ["bob", "x"]
    w.put("images", spark.createDataFrame([(1, "c:1", 10, 0.0, 0.0, 1.0, 1.0)], service.TABLES["images"][1]), 1)
    assert w.catalog_get("c:1").count() == w.catalog_search(start=5).count() == w.catalog_all().count() == 1 and w.catalog_search(bbox="2,2,3,3").count() == 0


def test_visits_and_expiry(spark):
    rows = spark.createDataFrame([("2020-01-01 01:00:00", "a"), ("2020-01-01 01:10:00", "a"), ("2020-01-01 05:00:00", "a")], "t string, user string").select(F.to_timestamp("t").alias("ts"), "user")
    assert sorted(r.n for r in streams.visits(rows).collect()) == [1, 2]
    entries = spark.createDataFrame([(1, 0, 90), (2, 95, None), (3, 0, 10)], "k int, created int, used int")
    assert [r.k for r in streams.unexpired(entries, 100, tti=20).orderBy("k").collect()] == [1, 2] and streams.unexpired(entries, 100, ttl=50).count() == 1


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_rings(spark):
    notch = ring((0, 0), (10, 0), (10, 10), (5, 2), (0, 10))
    box = lambda *s: polygon.ring_of_box(*map(F.lit, s))
    meets = [polygon.intersects(notch, box(*b)) for b in ((4, 8, 6, 9), (4, 1, 6, 3), (10, 10, 11, 11), (1, 1, 2, 2), (-5, -5, 20, 20), (11, 0, 12, 1))]
    assert list(one(spark, *meets)) == [False, True, True, True, True, False]
    assert list(one(spark, *(polygon.contains(notch, F.lit(x), F.lit(y)) for x, y in ((5, 1), (5, 5), (1, 5), (-1, 5))))) == [True, False, True, False]
    assert one(spark, polygon.ring_of_wkt(F.lit("POLYGON ((1 2, 3 4, 5 6, 1 2), (9 9, 8 8, 7 7))")))[0][:2] == [(1.0, 2.0), (3.0, 4.0)]
    assert list(one(spark, *(polygon.ring_of_wkt(F.lit(t).cast("string")) for t in ("POINT (1 2)", "POLYGON ((a b))", "", None)))) == [None] * 4


def test_clip_against_counting(spark):
    """The clipped area is the share of a fine grid of points inside both rings."""
    rng = np.random.default_rng(5)
    turns = np.sort(rng.uniform(0, 2 * np.pi, 7))
    outer = ring(*zip(10 * np.cos(turns), 7 * np.sin(turns)))
    for window, reach in ((ring((-4, -5), (6, -3), (1, 6)), 12), (ring((1, 6), (6, -3), (-4, -5), (1, 6)), 12)):
        area, empty = one(spark, polygon.signed_area(polygon.clip(outer, window)), polygon.clip(outer, ring((50, 50), (60, 50), (55, 60))))
        grid = spark.range(240 * 240).select(((F.col("id") % 240 + 0.5) / 10 - reach).alias("x"), ((F.floor(F.col("id") / 240) + 0.5) / 10 - reach).alias("y"))
        inside = grid.filter(polygon.contains(outer, F.col("x"), F.col("y")) & polygon.contains(window, F.col("x"), F.col("y"))).count()
        assert abs(area - inside / 100) < 0.5 and empty == []


def test_catalogue_by_polygon(spark):
    images = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0), (2, 0, 4.0, 7.0, 6.0, 9.0), (3, 0, 40.0, 0.0, 41.0, 1.0)], "img long, collected long, min_lon double, min_lat double, max_lon double, max_lat double")
    found = warehouse.catalog_search(images, wkt="POLYGON ((0 0, 10 0, 10 10, 5 2, 0 10, 0 0))")
    assert [r.img for r in found.collect()] == [1]
    for bad in ("POINT (1 2)", "POLYGON ((0 0, 1 1))"):
        with pytest.raises(ValueError):
            warehouse.catalog_search(images, wkt=bad)


def test_local_frame_round_trip(spark):
    at = tuple(map(F.lit, (12.0, 50.0, 100.0)))
    there = frame.to_local(at, F.lit(12.01), F.lit(49.99), F.lit(130.0))
    row = one(spark, *there, *frame.from_local(at, *there))
    assert 700 < row[0] < 730 and -1120 < row[1] < -1105 and row[2] == 30
    assert list(row)[3:] == pytest.approx([12.01, 49.99, 130.0], abs=1e-9)


def test_view_round_trip(spark):
    view = frame.View(F.lit(1000.0), F.lit(2000.0), F.lit(3.0), F.lit(640), F.lit(480), F.lit(0.3))
    spots = [(0, 0), (320, 240), (639, 479), (17, 333)]
    back = [v for x, y in spots for v in view.geodetic_to_screen(*view.screen_to_geodetic(F.lit(x), F.lit(y)))]
    centre = view.clip_to_projected(*view.screen_to_clip(F.lit(320), F.lit(240)))
    row = list(one(spark, *back, *centre))
    assert row[:8] == [v for s in spots for v in s] and row[8:] == [1000.0, 2000.0]


def test_cameras_from_metadata(spark):
    scalars = {f"{n}_{k}": float(i + 1) for i, (n, k) in enumerate((n, k) for n in ("LONG", "LAT", "HEIGHT", "SAMP", "LINE") for k in ("OFF", "SCALE"))}
    tags = {k: str(v) for k, v in scalars.items()} | {f"{n}_COEFF_{i + 1}": str(i) for n in ("LINE_NUM", "LINE_DEN", "SAMP_NUM", "SAMP_DEN") for i in range(20)}
    cases = [
        (1, {"RPC00B": tags}), (2, {"RPC00A": tags, "RPC00B": {}}), (3, {"RPC00B": tags, "ICHIPB": {"SCALE_FACTOR": "2", "FI_ROW_11": "4", "FI_COL_11": "3"}}),
        (4, {"RPC00B": tags, "STDIDC": {"START_ROW": "2", "START_COLUMN": "3"}, "": {"IMAGE_TILE_WIDTH": "100", "IMAGE_TILE_HEIGHT": "50"}}),
        (5, {"RPC00B": {k: v for k, v in tags.items() if k != "LINE_DEN_COEFF_20"}}), (6, {}), (7, None),
    ]
    rows = spark.createDataFrame(cases, "k int, m map<string, map<string, string>>").select("k", camera.from_metadata(F.col("m")).alias("c")).orderBy("k").collect()
    got = [r.c for r in rows]
    assert {k: got[0][k] for k in scalars} == scalars and got[0].LINE_NUM == list(range(20))
    assert got[1].SAMP_DEN == list(camera.RPC00A_PLACES) and sorted(camera.RPC00A_PLACES) == list(range(20))
    assert (got[2].LINE_OFF, got[2].LINE_SCALE, got[2].SAMP_OFF, got[2].SAMP_SCALE) == (10.0, 20.0, 8.0, 16.0)
    assert (got[3].LINE_OFF, got[3].LINE_SCALE, got[3].SAMP_OFF) == (9.0 - 50, 10.0, 7.0 - 200)
    assert got[4:] == [None] * 3


def test_resampling_modes(spark):
    """A plane is kept by the cubic inside the tile; nearest takes the pixel; far points give no row."""
    pixels = spark.range(64).select(F.lit(1).alias("img"), F.lit(1).alias("tile"), (F.col("id") % 8).cast("int").alias("px"), F.floor(F.col("id") / 8).cast("int").alias("py"))
    pixels = pixels.withColumn("v", 3 * F.col("px") + 5 * F.col("py"))
    points = spark.createDataFrame([(1, 1, 0, 3.25, 4.75), (1, 1, 1, 2.5, 2.0), (1, 1, 2, 90.0, 90.0)], "img int, tile int, id int, u double, v double")
    got = lambda mode: {r.id: r.value for r in raster.resample(points, pixels, mode).collect()}
    assert got("catmull") == pytest.approx({0: 33.5, 1: 17.5}) and got("linear") == pytest.approx({0: 33.5, 1: 17.5})
    assert got("nearest") == {0: 34.0, 1: 19.0}
    assert set(got("bicubic")) == {0, 1}


def test_mosaic_takes_the_lowest(spark):
    views = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 50.0, 50.0, 54.0, 54.0)], "view int, min_lon double, min_lat double, max_lon double, max_lat double")
    layers = spark.createDataFrame([(7, 1, -1.0, -1.0, 2.0, 9.0), (8, 0, 1.0, 0.0, 3.0, 2.0), (9, 2, 0.0, 0.0, 0.4, 0.4)], "img int, z int, img_min_lon double, img_min_lat double, img_max_lon double, img_max_lat double")
    got = {(r.view, r.i, r.j): r.img for r in raster.mosaic(views, layers, 4, 4).collect()}
    assert got == {(1, i, j): 8 if i in (1, 2) and j < 2 else 7 for i in range(4) for j in range(4) if i < 2 or i == 2 and j < 2}


def test_mosaic_decides_a_box_once(spark):
    """Views with one box share its cells; of a view with several boxes each cell shows the lowest layer."""
    boxes = [(0.0, 0.0, 4.0, 4.0), (2.0, 0.0, 6.0, 4.0)]
    rows = [*((v, *boxes[v % 2]) for v in range(1, 41)), (50, *boxes[0]), (50, *boxes[1]), (51, *boxes[0]), (51, *boxes[0]), (52, None, 0.0, 4.0, 4.0)]
    views = spark.createDataFrame(rows, "view int, min_lon double, min_lat double, max_lon double, max_lat double")
    held = [(7, 1, -1.0, -1.0, 3.0, 9.0), (8, 0, 4.0, 0.0, 6.0, 2.0), (9, 2, 0.0, 0.0, 9.0, 9.0)]
    layers = spark.createDataFrame(held, "img int, z int, img_min_lon double, img_min_lat double, img_max_lon double, img_max_lat double")
    want = {}
    for v, w, s, e, n in rows:
        for i in range(4 * (w is not None)):
            for j in range(4):
                x, y = w + (i + 0.5) * (e - w) / 4, s + (j + 0.5) * (n - s) / 4
                if tops := [(z, img) for img, z, a, b, c, d in held if a <= x < c and b <= y < d]:
                    want[v, i, j] = min(want.get((v, i, j), (9, 9)), *tops)
    mosaic = raster.mosaic(views, layers, 4, 4)
    got = mosaic.collect()
    assert len(got) == len(want) and {(r.view, r.i, r.j): r.img for r in got} == {k: img for k, (_, img) in want.items()}
    assert re.search(r"Aggregate \[min_lon#\d+, min_lat#\d+, max_lon#\d+, max_lat#\d+, i#\d+, j#\d+\]", mosaic._jdf.queryExecution().optimizedPlan().toString())


def test_capabilities_are_xml(spark):
    import xml.etree.ElementTree as ET

    xml = one(spark, documents.tile_capabilities(F.lit('a&b<"'), F.lit("t"), tuple(map(F.lit, (1, 2, 3, 4))), F.lit(1000), F.lit(3000), F.lit(2)))[0]
    root = ET.fromstring(xml)
    ns = {"w": "http://www.opengis.net/wmts/1.0", "o": "http://www.opengis.net/ows/1.1"}
    assert root.find("w:Contents/w:Layer/o:Identifier", ns).text == 'a&b<"'
    assert [(m.find("w:MatrixWidth", ns).text, m.find("w:MatrixHeight", ns).text) for m in root.findall("w:Contents/w:TileMatrixSet/w:TileMatrix", ns)] == [("6", "2"), ("3", "1"), ("2", "1")]


def test_tile_store(spark, tmp_path):
    file = tmp_path / "c" / "20200101" / "0" / "1" / "2" / "0.png"
    file.parent.mkdir(parents=True)
    file.write_bytes(b"tile")
    (tmp_path / "c" / "metadata.json").write_text("{}")
    assert files.read_tile(spark, str(tmp_path), "c", "20200101", 0, 1, 2) == b"tile" and files.read_tile(spark, str(tmp_path), "c", "20200101", 0, 1, 3) is None
    assert [tuple(r) for r in files.read_tiles(spark, str(tmp_path)).collect()] == [("c", "20200101", 0, 1, 2, 0, 4, b"tile")]


def tiff(order, image, planar=1, rows_per_strip=2):
    """A strip image (rows, columns, bands) of 16 bits as a classic file."""
    import struct

    height, width, bands = image.shape
    planes = [image[:, :, b : b + 1] for b in range(bands)] if planar == 2 else [image]
    strips = [p[r : r + rows_per_strip].astype(order + "u2").tobytes() for p in planes for r in range(0, height, rows_per_strip)]
    at = 8 + np.cumsum([0, *map(len, strips)])
    extra, fields, tail = b"", [], int(at[-1])
    for tag, kind, values in ((256, 3, [width]), (257, 3, [height]), (258, 3, [16] * bands), (259, 3, [1]), (273, 4, at[:-1].tolist()), (277, 3, [bands]), (278, 3, [rows_per_strip]), (282, 5, [3, 2]), (284, 3, [planar]), (305, 2, b"made\0")):
        raw = values if kind == 2 else struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        count = len(values) // (2 if kind == 5 else 1)
        if len(raw) > 4:
            raw, extra = struct.pack(order + "I", tail + len(extra)), extra + raw
        fields.append(struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0"))
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", tail + len(extra))
    return head + b"".join(strips) + extra + struct.pack(order + "H", len(fields)) + b"".join(fields) + struct.pack(order + "I", 0)


def test_tiff(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 65536, (5, 4, 3))
    (tmp_path / "a.tif").write_bytes(tiff("<", image))
    (tmp_path / "b.tif").write_bytes(tiff(">", image, planar=2, rows_per_strip=3))
    (tmp_path / "c.tif").write_bytes(b"II*\0\xff\xff\0\0")
    (tmp_path / "d.tif").write_bytes(b"")
    tags = {r.path[-5:]: r.tags for r in tiff_files.read_tags(spark, str(tmp_path)).collect()}
    assert set(tags) == {"a.tif", "b.tif"} and tags["a.tif"][305] == ["made"] and tags["b.tif"][282] == ["1.5"] and tags["b.tif"][256] == ["4"]
    rows = tiff_files.read_rows(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * 5 * 3 and all(r["values"] == image[r.row, :, r.band].tolist() for r in rows)


def test_map_capabilities(spark):
    import xml.etree.ElementTree as ET

    layers = spark.createDataFrame([("a:1", -1.5, 2.0, 3.0, 4.0), ('b&"c', 0.0, 0.0, 1.0, 1.0)], "name string, west double, south double, east double, north double")
    rows = documents.map_capabilities(layers, "http://h/").orderBy("name").collect()
    ns = {"m": "http://www.opengis.net/wms"}
    found = ET.fromstring(documents.map_document([r.layer for r in rows], "a<b")).findall("m:Capability/m:Layer/m:Layer", ns)
    assert [f.find("m:Name", ns).text for f in found] == ["a:1", 'b&"c']
    assert [v.text for v in found[0].find("m:EX_GeographicBoundingBox", ns)] == ["-1.5", "3.0", "2.0", "4.0"]
    assert found[0].find("m:DataURL/m:OnlineResource", ns).get("{http://www.w3.org/1999/xlink}href") == "http://h/a/1"
