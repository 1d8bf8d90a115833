"""The analytics warehouse: keyed upsert and filtered reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygon


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; of equally late ones that of ``new``. Write it to another path than ``old``'s."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_rank", latest).filter("_rank = 1").drop("_rank", "_new")


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``left,bottom,right,top``."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a bounding box has four numbers: left,bottom,right,top")
    return tuple(parts)


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    left, bottom, right, top = bbox
    return lon.between(left, right) & lat.between(bottom, top)


def search_summaries(summaries: DataFrame, user: str | None = None, precision: int | None = None, bbox: str | None = None, limit: int | None = 10_000) -> DataFrame:
    """Conjunction of the given filters; without user the rows of ``global``. The cap is part of the interface."""
    from ..functions.geo import geohash_box

    out = summaries.filter(F.col("user") == (user or "global"))
    if precision is not None:
        out = out.filter(F.length("location") == precision)
    if bbox is not None:
        # decoded in a generator: a plain filter would move below the aggregate and decode each cell's long expression per use
        out = out.withColumn("_box", F.explode(F.array(geohash_box(F.col("location")))))
        out = out.filter(in_bbox(F.col("_box.min_lon"), F.col("_box.min_lat"), parse_bbox(bbox))).drop("_box")
    return out if limit is None else out.orderBy("location", "user").limit(limit)


def unseen_users(summaries: DataFrame, users: DataFrame) -> DataFrame:
    """Users of the summaries that are not registered yet; ``global`` is no user."""
    return summaries.filter("user <> 'global'").select(F.lower("user").alias("user")).distinct().join(users, "user", "left_anti")


def without_recent(users: DataFrame, lists: DataFrame, since: int) -> DataFrame:
    return users.join(lists.filter(F.col("date") >= since), "user", "left_anti")


def catalog_search(images: DataFrame, start: int | None = None, end: int | None = None, bbox: str | None = None, limit: int | None = 1000, wkt: str | None = None) -> DataFrame:
    """Images by collection time, box and polygon (the footprint shares a point with it); at least one parameter must be given."""
    if start is None and end is None and bbox is None and wkt is None:
        raise ValueError("give a start, an end, a box or a polygon")
    out = images
    if start is not None:
        out = out.filter(F.col("collected") >= start)
    if end is not None:
        out = out.filter(F.col("collected") <= end)
    if bbox is not None:
        left, bottom, right, top = parse_bbox(bbox)
        out = out.filter((F.col("max_lon") >= left) & (F.col("min_lon") <= right) & (F.col("max_lat") >= bottom) & (F.col("min_lat") <= top))
    if wkt is not None:
        points = [tuple(map(float, p.split()[:2])) for p in wkt[wkt.rindex("(") + 1 : wkt.index(")")].split(",")] if wkt.strip().upper().startswith("POLYGON") else []
        if len(points) < 3:
            raise ValueError("the area is a polygon: POLYGON ((x y, x y, x y))")
        for low, high, values in (("min_lon", "max_lon", [p[0] for p in points]), ("min_lat", "max_lat", [p[1] for p in points])):
            out = out.filter((F.col(high) >= min(values)) & (F.col(low) <= max(values)))
        out = out.filter(polygon.intersects(polygon.ring_of_wkt(F.lit(wkt)), polygon.ring_of_box(*map(F.col, ("min_lon", "min_lat", "max_lon", "max_lat")))))
    return out if limit is None else out.orderBy("img").limit(limit)
