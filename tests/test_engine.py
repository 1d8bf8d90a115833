"""Every query of the engine against its SQL, goldens of the functions, sources and streams."""

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quadtide import queries
from quadtide.functions import camera, geo, tiles, visibility
from quadtide.operators import cluster, priority, warehouse
from quadtide.sources import files, logs
from quadtide.streaming import heatmap as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shape(df):
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    rows = [tuple(float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else None if v is None else str(pd.Timestamp(v)) if hasattr(v, "year") else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert shape(got) == shape(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_geohash_goldens(spark):
    cell, box = spark.range(1).select(geo.geohash(F.lit(57.64911), F.lit(10.40744), 9), geo.geohash_box(F.lit("u4pru"))).first()
    assert cell == "u4pruydqq" and box.min_lon <= 10.40744 <= box.max_lon and box.min_lat <= 57.64911 <= box.max_lat
    assert spark.range(1).select(geo.geohash_precision(F.lit(0.2))).first()[0] == 7


@pytest.mark.parametrize("text", ["a|b", "(a|b)&(x|y)", "_&-&:", '"a b"&c', ""])
def test_visibility_accepts(text):
    visibility.parse(text)


@pytest.mark.parametrize("text", ["a|b&c", "(", "a|", "one(five)", '""', "a*b", "a b"])
def test_visibility_rejects(text):
    with pytest.raises(visibility.VisibilityError):
        visibility.parse(text)


def test_visibility_normal_form(spark):
    assert visibility.normalise("(b|(a|c))&x") == "x&(a|b|c)" and visibility.normalise("a&(b&c)") == "a&b&c" and visibility.normalise("a|a") == "a"
    see = lambda e, a: spark.range(1).select(visibility.visible(e, F.array(*map(F.lit, a)))).first()[0]
    assert see("a&(b|c)", ["a", "c"]) and not see("a&(b|c)", ["a"]) and see("", ["a"])


def test_camera_inverse(spark):
    rng = np.random.default_rng(1)
    model = {f"{n}_{k}": v for n, o, s in (("LONG", 56.36, 0.07), ("LAT", 27.2, 0.07), ("HEIGHT", 10, 500), ("SAMP", 6000, 6000), ("LINE", 7000, 7000)) for k, v in (("OFF", o), ("SCALE", s))}
    for n, main in (("SAMP", 1), ("LINE", 2)):
        model[f"{n}_NUM"] = (rng.normal(0, 1e-3, 20) + np.eye(20)[main]).tolist()
        model[f"{n}_DEN"] = (rng.normal(0, 1e-4, 20) * (np.arange(20) > 0) + np.eye(20)[0]).tolist()
    s, n, h = np.array([0.0, 0, 12000, 3000]), np.array([0.0, 13854, 100, 9000]), np.full(4, -9.0)
    lon, lat = camera.unproject(model, s, n, h)
    again = camera.project(model, lon, lat, h)
    assert np.allclose(again[0], s, atol=1e-6) and np.allclose(again[1], n, atol=1e-6)
    row = spark.createDataFrame(pd.DataFrame({"a": lon, "b": lat})).select(*camera.project(model, F.col("a"), F.col("b"), F.lit(-9.0))).toPandas().to_numpy()
    assert np.allclose(row, np.stack([s, n], axis=1), atol=1e-6)


def test_log_sources(spark, tmp_path):
    good = {"imageID": "c:20200101000000", "rSet": "1", "x": "2", "y": "3", "userID": "u"}
    (tmp_path / "logs-2020-10-28-18-15-51-a").write_text(json.dumps(good) + "\nnot json\n" + json.dumps({"imageID": "c:1", "rSet": "x"}) + "\n")
    rows = logs.read_logs(spark, str(tmp_path)).collect()
    assert [r.rset for r in rows] == [1, None, None] and rows[1].corrupt == "not json" and rows[0].corrupt is None
    assert str(logs.log_window(spark, str(tmp_path)).first().start) == "2020-10-28 18:15:51"
    key, bad = spark.createDataFrame([("c/t/1/2/3/-1.png",), ("x/y.png",)], "k string").select(logs.parse_tile_key(F.col("k")).alias("t")).collect()
    assert key.t.rset == 1 and key.t.band == -1 and bad.t is None
    (tmp_path / "img").write_bytes(b"NITF02.10")
    assert {r.format for r in logs.read_images(spark, str(tmp_path)).collect()} == {"nitf", "unknown"}
    assert spark.range(1).select(logs.byte_ranges(F.lit("bytes=0-99,200-"))).first()[0] == [(0, 99), (200, None)]


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "in"
    log.mkdir()
    for i in range(3):
        (log / f"l-2020-10-28-18-15-5{i}-a").write_text("\n".join(json.dumps({"imageID": f"c:{i}", "rSet": "0", "x": str(k), "y": "1"}) for k in range(5)))
    path = lambda n: str(tmp_path / f"t{n}")
    seen = []
    write = streams.upsert_batch(path, ["collection", "timestamp", "x"], "rset")

    def batch(df, n):
        write(df, n)
        seen.append(n)

    q = streams.log_stream(spark, str(log)).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(path(max(seen))).count() == 15


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2020-01-01 01:00:00", "a"), ("2020-01-01 23:00:00", "a"), ("2020-01-02 00:00:00", "b")], "t string, location string").select(F.to_timestamp("t").alias("ts"), "location")
    assert sorted(r.n for r in streams.windowed_counts(rows).collect()) == [1, 2]


def test_upsert_and_searches(spark):
    old, new = (spark.createDataFrame(r, "k int, at int, v string") for r in ([(1, 5, "old"), (2, 9, "late")], [(1, 5, "new"), (2, 1, "early"), (3, 1, "x")]))
    assert {(r.k, r.v) for r in warehouse.upsert(old, new, ["k"], "at").collect()} == {(1, "new"), (2, "late"), (3, "x")}
    with pytest.raises(ValueError, match="four"):
        warehouse.parse_bbox("1,2,3")
    with pytest.raises(ValueError, match="start"):
        warehouse.catalog_search(old)


def test_spatial_join_is_exact(spark):
    rng = np.random.default_rng(2)
    a = [(i, *xy, xy[0] + w, xy[1] + w) for i, (xy, w) in enumerate(zip(rng.uniform(-20, 20, (60, 2)).tolist(), rng.uniform(0.1, 9, 60).tolist(), strict=True))]
    b = [(i, *xy, xy[0] + w, xy[1] + w) for i, (xy, w) in enumerate(zip(rng.uniform(-20, 20, (50, 2)).tolist(), rng.uniform(0.1, 9, 50).tolist(), strict=True))]
    left = spark.createDataFrame(a, "i int, min_lon double, min_lat double, max_lon double, max_lat double")
    right = spark.createDataFrame(b, "j int, img_min_lon double, img_min_lat double, img_max_lon double, img_max_lat double")
    got = [(r.i, r.j) for r in priority.spatial_join(left, right).collect()]
    want = [(x[0], y[0]) for x in a for y in b if x[1] < y[3] and x[3] > y[1] and x[2] < y[4] and x[4] > y[2]]
    assert sorted(got) == sorted(want)


def scattered():
    """Points with shared places, ids at several places, and nulls."""
    rng = np.random.default_rng(6)
    rows = [(int(i) % 90, float(x), float(y)) for i, x, y in zip(range(120), rng.integers(0, 30, 120), rng.integers(0, 30, 120), strict=True)]
    return [*rows, *((200 + i, 3.0, 4.0) for i in range(40)), (300, 90.0, 90.0), (300, 90.0, 90.0), (301, None, 1.0), (None, 1.0, 1.0)]


def test_nearest_lists_no_copies(spark):
    rows = scattered()
    near = cluster.nearest(p := spark.createDataFrame(rows, "id bigint, x double, y double"), p, 6.0)
    want = {}
    for i, x, y in rows:
        for j, u, v in rows:
            if None not in (i, j, x, u) and i != j and (d := (x - u) ** 2 + (y - v) ** 2) <= 36:
                want[i] = min(want.get(i, (d, j)), (d, j))
    assert {r.id: (r.distance, r.other) for r in near.collect()} == {i: (math.sqrt(d), j) for i, (d, j) in want.items()}
    many = cluster.nearest(q := spark.range(20_000).selectExpr("id", "1D AS x", "1D AS y"), q, 1.0)  # 400 million pairs
    assert many.filter("other = IF(id = 0, 1, 0) AND distance = 0").count() == 20_000
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_within_compares_places(spark):
    rows = scattered()
    near = cluster.within(p := spark.createDataFrame(rows, "id bigint, x double, y double"), p, 5.0, digits=6)
    want = sorted((i if i is not None else -1, j if j is not None else -1, round(math.sqrt((x - u) ** 2 + (y - v) ** 2), 6)) for i, x, y in rows for j, u, v in rows if None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 25)
    assert sorted((-1 if r.id is None else r.id, -1 if r.other is None else r.other, r.distance) for r in near.collect()) == want
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_greedy_clusters_keep_all_points(spark):
    pts = spark.range(200).select("id", (F.rand(1) * 360 - 180).alias("lon"), (F.rand(2) * 160 - 80).alias("lat"), F.lit(1).alias("layer"))
    rows = cluster.greedy_clusters(pts, "layer", 0, 5).collect()
    for z in range(6):
        assert sum(r.n for r in rows if r.zoom == z) == 200
    counts = [sum(1 for r in rows if r.zoom == z) for z in range(6)]
    assert counts == sorted(counts) and not any(math.isnan(r.x) for r in rows)


def test_areas_in_every_form(spark, tmp_path):
    ring, other = [[0, 0], [2, 0], [2, 1], [0, 0]], [[5, 5], [6, 5], [6, 7], [5, 5]]
    texts = [
        {"type": "Polygon", "coordinates": [ring]},
        {"type": "MultiPolygon", "coordinates": [[ring], [other]]},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [other]}, "properties": {"a": "1"}},
        {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"a": "2"}}, {"type": "Feature", "geometry": None}]},
        [1],
    ]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(json.dumps(text))
    (tmp_path / "broken.json").write_text("{")
    got = sorted((r.west, r.south, r.east, r.north, (r.properties or {}).get("a", "")) for r in files.read_areas(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 2, 1, ""), (0, 0, 2, 1, ""), (0, 0, 2, 1, "2"), (5, 5, 6, 7, ""), (5, 5, 6, 7, "1")]


def test_scored_and_named(spark):
    rows = spark.createDataFrame([("a", 1), ("Anonymous", 2), (None, 3)], "user string, x int")
    assert [tuple(r) for r in priority.scored(priority.named(rows)).collect()] == [("a", 1, 1)]


def test_tiles_beside_and_of_parts(spark):
    rows = spark.createDataFrame([(0, 0), (15, 15)], "x long, y long")
    size, rset = F.lit(8192), F.lit(0)
    beside = lambda dx, dy: tiles.border(size, size, rset, F.col("x"), F.col("y"), dx, dy)["x"]
    got = rows.orderBy("x").select(beside(1, 0), beside(-1, 0), beside(0, -1), tiles.part_offset(F.lit(3), F.lit(5), F.lit(2))).collect()
    assert [tuple(r) for r in got] == [(1, None, None, 3), (None, 14, 15, 3)]
