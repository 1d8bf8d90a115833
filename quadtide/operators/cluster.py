"""Point clustering over zoom levels, and radius joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def projected(points: DataFrame) -> DataFrame:
    return points.withColumns({"mx": geo.mercator_x(F.col("lon")), "my": geo.mercator_y(F.col("lat"))})


def _near(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Rows of a (x, y) and b (ox, oy) at most ``radius`` apart, with ``d2``: an equi-join on the nine cells around each of a."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.explode(F.array(*(F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    right = b.withColumn("cell", F.struct(cell("ox").alias("cx"), cell("oy").alias("cy")))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return a.withColumn("cell", near).join(right.hint("merge"), "cell").drop("cell").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def within(a: DataFrame, b: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """Pairs (id of a, id of b) at most ``radius`` apart in x, y, with their distance, rounded to ``digits`` if given.

    Places are compared, not points: those that share one get their pairs by joins with the place. No side is broadcast,
    since what a file's size says of its points falls far short of what they take in memory.
    """
    other = b.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = _near(a.select("x", "y").distinct(), other.select("ox", "oy").distinct(), radius)
    distance = F.sqrt("d2") if digits is None else F.round(F.sqrt("d2"), digits)
    pairs = pairs.select("x", "y", "ox", "oy", distance.alias("distance"))
    left = a.select("id", "x", "y").join(pairs.hint("merge"), ["x", "y"])
    return left.join(other.hint("merge"), ["ox", "oy"]).select("id", "other", "distance")


def nearest(a: DataFrame, b: DataFrame, radius: float, rings: int = 3) -> DataFrame:
    """(id of a, id of the nearest b with another id, distance) at most ``radius`` apart; ties go to the least id.

    Of the points of b at one place only the two least ids can be an answer, and the points of a at one place share the two
    nearest other ids, of which each takes the first that is not its own; so copies of a place list no pairs. Rings grow by
    four up to ``radius``: a place that has two ids within one is not looked for in the wider ones.
    """
    a, b = (p.select("id", "x", "y").filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL") for p in (a, b))
    least = b.groupBy("x", "y").agg(F.min("id").alias("first"))
    second = b.join(least.hint("merge"), ["x", "y"]).filter("id <> first").groupBy("x", "y").agg(F.min("id").alias("second"))
    two = F.explode(F.array_compact(F.array("first", "second")))
    held = least.join(second.hint("merge"), ["x", "y"], "left").select(F.col("x").alias("ox"), F.col("y").alias("oy"), two.alias("other"))
    order, rest, out = Window.partitionBy("x", "y").orderBy("d2", "other"), a.select("x", "y").distinct(), None
    for k in range(rings - 1, -1, -1):
        near = _near(rest, held, radius / 4**k).groupBy("x", "y", "other").agg(F.min("d2").alias("d2"))
        near = near.withColumn("at", F.row_number().over(order)).filter("at <= 2")
        found = near.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("d2", "other"))).alias("best"))
        if k:
            found = found.filter(F.size("best") == 2)
            rest = rest.join(found.select("x", "y").hint("merge"), ["x", "y"], "left_anti")
        out = found if out is None else out.unionAll(found)
    own = F.get(F.filter("best", lambda n: n["other"] != F.col("id")), F.lit(0))
    each = a.join(out.hint("merge"), ["x", "y"]).select("id", own.alias("n")).filter("n IS NOT NULL")
    return each.groupBy("id").agg(F.min("n").alias("n")).select("id", "n.other", F.sqrt("n.d2").alias("distance"))


def grid_clusters(points: DataFrame, zoom: int, cell_pixels: int = 40, extent: int = 512) -> DataFrame:
    """Clusters by cell of the unit square at a zoom: one aggregation with partial sums, for any number of points."""
    size = cell_pixels / (extent * 2**zoom)
    cell = [F.floor(F.col(c) / size).alias(n) for c, n in (("mx", "cx"), ("my", "cy"))]
    return projected(points).groupBy(*cell).agg(F.count("*").alias("n"), F.avg("mx").alias("x"), F.avg("my").alias("y"))


def greedy_level(rows: pd.DataFrame, radius: float) -> pd.DataFrame:
    """One level of the order-dependent clustering: each point not yet taken gathers its neighbours, weighted."""
    from collections import defaultdict

    x, y, n = rows["x"].tolist(), rows["y"].tolist(), rows["n"].tolist()
    cells = defaultdict(list)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        cells[int(a // radius), int(b // radius)].append(i)
    taken, out, parent = [False] * len(x), [], [0] * len(x)
    for i in range(len(x)):
        if taken[i]:
            continue
        taken[i] = True
        cx, cy = int(x[i] // radius), int(y[i] // radius)
        found = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx + a, cy + b), ()) if not taken[j] and (x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2 <= radius * radius]
        wx, wy, total = x[i] * n[i], y[i] * n[i], n[i]
        parent[i] = len(out)
        for j in sorted(found):
            taken[j] = True
            wx, wy, total, parent[j] = wx + x[j] * n[j], wy + y[j] * n[j], total + n[j], len(out)
        out.append((wx / total, wy / total, total))
    level = pd.DataFrame(out, columns=["x", "y", "n"])
    level.attrs["parent"] = parent
    return level


def greedy_clusters(points: DataFrame, group: str, min_zoom: int = 0, max_zoom: int = 16, radius: float = 40, extent: int = 512) -> DataFrame:
    """The hierarchical greedy clustering of each group of points, in the order of ``id``.

    Rows carry the index of their parent one zoom out (-1 at the last) and the number of their first point; the points
    stand one zoom beyond ``max_zoom`` with their id. The result depends on the order, so a group is one task; :func:`grid_clusters` serves groups of any size.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        level = pd.DataFrame({"x": rows["mx"].to_numpy(), "y": rows["my"].to_numpy(), "n": 1})
        out = [level.assign(zoom=max_zoom + 1, index=range(len(level)), parent=-1, id=rows["id"].to_numpy(), first=range(len(level)))]
        for zoom in range(max_zoom, min_zoom - 1, -1):
            level = greedy_level(level, radius / (extent * 2**zoom))
            out[-1]["parent"] = level.attrs.pop("parent")
            first = out[-1].groupby("parent")["first"].min().to_numpy()
            out.append(level.assign(zoom=zoom, index=range(len(level)), parent=-1, id=None, first=first))
        result = pd.concat([part.astype({"id": "Int64"}) for part in out])
        result[group] = rows[group].iloc[0]
        return result[[group, "zoom", "index", "x", "y", "n", "parent", "id", "first"]]

    kind = points.schema[group].dataType.simpleString()
    return projected(points).groupBy(group).applyInPandas(run, f"{group} {kind}, zoom int, index int, x double, y double, n bigint, parent int, id bigint, first int")


def clusters_in(clusters: DataFrame, bbox: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """Clusters (zoom, x, y in the unit square) inside (west, south, east, north); a box may cross the antimeridian."""
    west, south, east, north = bbox
    lo, hi = max(-90.0, min(90.0, south)), max(-90.0, min(90.0, north))
    a, b = (west + 180) % 360 - 180, 180.0 if east == 180 else (east + 180) % 360 - 180
    if east - west >= 360:
        a, b = -180.0, 180.0
    spans = [(a, b)] if a <= b else [(a, 180.0), (-180.0, b)]
    x, y = F.col("x"), F.col("y")
    across = F.lit(False)
    for left, right in spans:
        across = across | x.between(left / 360 + 0.5, right / 360 + 0.5)
    return clusters.filter((F.col("zoom") == zoom) & across & y.between(geo.mercator_y(F.lit(hi)), geo.mercator_y(F.lit(lo))))


def map_tile(clusters: DataFrame, zoom: int, x: int, y: int, radius: float = 40, extent: int = 512) -> DataFrame:
    """Clusters of a map tile and its margin in whole tile coordinates (tx, ty); margins wrap around the world."""
    n, p = 2**zoom, radius / extent
    level = clusters.filter((F.col("zoom") == zoom) & F.col("y").between((y - p) / n, (y + 1 + p) / n))
    parts = [(level.filter(F.col("x").between((x - p) / n, (x + 1 + p) / n)), x)]
    if x == 0:
        parts.append((level.filter(F.col("x").between(1 - p / n, 1)), n))
    if x == n - 1:
        parts.append((level.filter(F.col("x").between(0, p / n)), -1))
    out = None
    for rows, at in parts:
        part = rows.withColumns({"tx": F.floor(extent * (F.col("x") * n - at) + 0.5), "ty": F.floor(extent * (F.col("y") * n - y) + 0.5)})
        out = part if out is None else out.unionByName(part)
    return out


def page(rows: DataFrame, keys: list[str], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", at).filter(F.col("_at").between(offset + 1, offset + limit)).drop("_at")


def children(clusters: DataFrame, group: str) -> DataFrame:
    """(group, zoom, index) of every cluster with the index of each child one zoom in."""
    below = clusters.filter("parent >= 0").select(group, (F.col("zoom") - 1).alias("zoom"), F.col("parent").alias("index"), F.col("index").alias("child"), F.col("n").alias("child_n"))
    return clusters.select(group, "zoom", "index").join(below, [group, "zoom", "index"])


def leaves(clusters: DataFrame, group: str, zoom: int, max_zoom: int) -> DataFrame:
    """(group, index, id): every point with the cluster of the given zoom that holds it; one join a zoom."""
    at = clusters.filter(F.col("zoom") == max_zoom + 1).select(group, "id", F.col("parent").alias("index"))
    for z in range(max_zoom, zoom, -1):
        up = clusters.filter(F.col("zoom") == z).select(group, "index", "parent")
        at = at.join(up, [group, "index"]).select(group, "id", F.col("parent").alias("index"))
    return at


def expansion_zoom(clusters: DataFrame, group: str, max_zoom: int) -> DataFrame:
    """(group, zoom, index, expands): the first zoom at which a cluster is more than one, ``max_zoom`` + 1 at most.

    Clusters are nested, so those with the same first point and as many points hold the same ones.
    """
    same = Window.partitionBy(group, "first", "n")
    return clusters.filter(F.col("zoom") <= max_zoom).select(group, "zoom", "index", (F.max("zoom").over(same) + 1).alias("expands"))
