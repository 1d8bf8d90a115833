"""Scores for the tiles of an image, and prefetch lists from areas of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tiles
from . import heatmap


def all_tiles(images: DataFrame, virtual: bool = True) -> DataFrame:
    """One row per tile of every resolution set."""
    by_set = images.withColumn("rset", F.explode(F.sequence(F.lit(0), F.col("max_rset"))))
    cols, rows = (tiles.dims_virtual if virtual else tiles.dims)(F.col("width"), F.col("height"), F.col("rset"))
    grid = by_set.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), cols - 1))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)))
    return grid.select("img", "rset", "x", "y")


def tile_scores(images: DataFrame, summaries: DataFrame, least: int = 1) -> DataFrame:
    """Tiles scored by the requests to their cell. Tiles are listed only of images that touch a cell that was asked for."""
    wanted = summaries.filter("user = 'global'").groupBy("location").agg(F.sum("requestCount").alias("score"))
    images = touching(images, wanted)
    cells = heatmap.located(heatmap.tile_boxes(all_tiles(images), images)).select("img", "rset", "x", "y", "location")
    return cells.join(wanted, "location").filter(F.col("score") >= least).select("img", "rset", "x", "y", "score")


def touching(images: DataFrame, cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Images that share a square of a fixed grid with a cell: all that the cells can hold a tile of, and few others."""
    boxes = cells.select("location").distinct().select(F.explode(F.array(geo.geohash_box(F.col("location")))).alias("b")).select("b.*")
    squares = boxes.select(grid_cells("min_lon", "min_lat", "max_lon", "max_lat", size).alias("cell")).distinct()
    near = footprints(images).select("img", grid_cells("img_min_lon", "img_min_lat", "img_max_lon", "img_max_lat", size).alias("cell"))
    return images.join(near.join(squares, "cell", "left_semi").select("img").distinct(), "img", "left_semi")


def areas(summaries: DataFrame) -> DataFrame:
    """Cells that users asked for, as boxes with the count as importance."""
    box = F.explode(F.array(geo.geohash_box(F.col("location"))))  # a generator, so that joins do not repeat the decoding
    return summaries.filter("user <> 'global'").select("user", "location", box.alias("b"), F.col("requestCount").cast("float").alias("importance")).select("user", "location", "b.*", "importance")


def footprints(images: DataFrame, deg: float = heatmap.DEG_PER_PIXEL) -> DataFrame:
    lon, lat = F.col("lon0"), F.col("lat0")
    return images.select("*", lon.alias("img_min_lon"), (lat - F.col("height") * deg).alias("img_min_lat"), (lon + F.col("width") * deg).alias("img_max_lon"), lat.alias("img_max_lat"))


def grid_cells(min_lon: str, min_lat: str, max_lon: str, max_lat: str, size: float):
    """Every cell of a fixed grid that a box touches."""
    x = F.sequence(F.floor(F.col(min_lon) / size), F.floor(F.col(max_lon) / size))
    y = F.sequence(F.floor(F.col(min_lat) / size), F.floor(F.col(max_lat) / size))
    return F.explode(F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(a.alias("cx"), b.alias("cy"))))))


def spatial_join(a: DataFrame, b: DataFrame, size: float = 5.0) -> DataFrame:
    """Pairs of boxes that overlap: an equi-join on grid cells, then the exact test.

    A pair counts in the one cell that holds the south-west corner of its overlap, so nothing is emitted twice.
    """
    left = a.withColumn("cell", grid_cells("min_lon", "min_lat", "max_lon", "max_lat", size))
    right = b.withColumn("cell", grid_cells("img_min_lon", "img_min_lat", "img_max_lon", "img_max_lat", size))
    w, s = F.greatest("min_lon", "img_min_lon"), F.greatest("min_lat", "img_min_lat")
    overlap = (F.col("min_lon") < F.col("img_max_lon")) & (F.col("max_lon") > F.col("img_min_lon")) & (F.col("min_lat") < F.col("img_max_lat")) & (F.col("max_lat") > F.col("img_min_lat"))
    once = (F.floor(w / size) == F.col("cell.cx")) & (F.floor(s / size) == F.col("cell.cy"))
    return left.join(right, "cell").filter(overlap & once).drop("cell")


def touched(images: DataFrame, boxes: DataFrame, size: float = 5.0) -> DataFrame:
    """The ``images`` (img, img_min_lon, ...) that overlap any of ``boxes``, once each: a semi join, which lists no pairs."""
    left = images.withColumn("cell", grid_cells("img_min_lon", "img_min_lat", "img_max_lon", "img_max_lat", size))
    sides = ["min_lon", "min_lat", "max_lon", "max_lat"]
    right = boxes.select(*sides).distinct().withColumn("at", grid_cells(*sides, size))
    overlap = (F.col("min_lon") < F.col("img_max_lon")) & (F.col("max_lon") > F.col("img_min_lon")) & (F.col("min_lat") < F.col("img_max_lat")) & (F.col("max_lat") > F.col("img_min_lat"))
    return left.join(right, (F.col("cell") == F.col("at")) & overlap, "left_semi").drop("cell").distinct()


def closest_rset(pairs: DataFrame) -> DataFrame:
    """The set whose tile area in degrees is closest to the overlap's; of equally close ones the finest."""
    w = F.least("max_lon", "img_max_lon") - F.greatest("min_lon", "img_min_lon")
    h = F.least("max_lat", "img_max_lat") - F.greatest("min_lat", "img_min_lat")
    side = F.pow(F.lit(2.0), F.col("rset")) * 512 * heatmap.DEG_PER_PIXEL
    by_set = pairs.withColumn("area", w * h).withColumn("rset", F.explode(F.sequence(F.lit(0), F.col("max_rset"))))
    best = F.row_number().over(Window.partitionBy("user", "location", "img").orderBy(F.round(F.abs(side * side - F.col("area")), 9), "rset"))
    return by_set.withColumn("k", best).filter("k = 1").drop("k")


def prefetch(pairs: DataFrame) -> DataFrame:
    """Tiles to fetch ahead by user and image; areas of importance over 20 take every finer set too."""
    rows = closest_rset(pairs).withColumn("rset", F.explode(F.when(F.col("importance") > 20, F.sequence(F.col("rset"), F.lit(0))).otherwise(F.array("rset"))))
    size = F.pow(F.lit(2.0), F.col("rset")) * 512 * heatmap.DEG_PER_PIXEL
    west, east = F.greatest("min_lon", "img_min_lon") - F.col("lon0"), F.least("max_lon", "img_max_lon") - F.col("lon0")
    north, south = F.col("lat0") - F.least("max_lat", "img_max_lat"), F.col("lat0") - F.greatest("min_lat", "img_min_lat")
    cols, rws = tiles.dims(F.col("width"), F.col("height"), F.col("rset"))
    lo = lambda v: F.floor(F.round(v / size, 9))
    x = F.explode(F.sequence(lo(west), F.least(lo(east), cols - 1)))
    y = F.explode(F.sequence(lo(north), F.least(lo(south), rws - 1)))
    return rows.withColumn("x", x).withColumn("y", y).select("user", "img", "rset", "x", "y").distinct()


def scored(tile_refs: DataFrame) -> DataFrame:
    """Tiles of a prefetch list as scored tiles; each counts 1."""
    return tile_refs.withColumn("score", F.lit(1))


def named(rows: DataFrame, user: str = "user") -> DataFrame:
    """Rows of users who are known: anonymous ones, in any case of letters, and null get no list."""
    return rows.filter(F.lower(user) != "anonymous")
