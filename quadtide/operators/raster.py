"""Raster statistics over tiles in long form: (img, tile, px, py, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(pixels: DataFrame, max_pixel: int = 256) -> DataFrame:
    """Counts by image and value; samples darker than a fifth of a step of 256 are no data."""
    return pixels.filter(F.col("v") / max_pixel >= 0.2 / 256).groupBy("img", "v").agg(F.count("*").alias("n"))


def cumulative(hist: DataFrame) -> DataFrame:
    """Running sums by image: at most one row a value in each window."""
    return hist.withColumn("cum", F.sum("n").over(Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))


def look_back(hist: DataFrame, width: int = 16) -> DataFrame:
    return hist.withColumn("sum16", F.sum("n").over(Window.partitionBy("img").orderBy("v").rowsBetween(1 - width, 0)))


def dra_parameters(cum: DataFrame, p_min: float = 0.02, p_max: float = 0.98, max_pixel: int = 256) -> DataFrame:
    """First and last value with data, and those where the share of all data passes p_min and p_max."""
    total = cum.withColumn("total", F.max("cum").over(Window.partitionBy("img")))
    first = total.withColumns({"e_first": F.min("v").over(Window.partitionBy("img")), "at_first": F.min("cum").over(Window.partitionBy("img"))})
    low, high = F.when(F.col("cum") / F.col("at_first") > 1 + p_min, F.col("v")), F.when(F.col("cum") / F.col("total") < p_max, F.col("v"))
    last = F.max(F.when(F.col("cum") < F.col("total"), F.col("v")))
    return first.groupBy("img").agg(F.min("e_first").alias("e_first"), F.coalesce(last, F.lit(0)).alias("e_last"), F.coalesce(F.min(low), F.lit(max_pixel)).alias("e_min"), F.coalesce(F.max(high), F.lit(0)).alias("e_max"))


def equalise(pixels: DataFrame, params: DataFrame, a: float = 0.1, b: float = 0.1, max_pixel: int = 255) -> DataFrame:
    """Stretch between the adjusted limits, from the unadjusted lower one."""
    span = F.col("e_max") - F.col("e_min")
    low = F.greatest(F.col("e_first").cast("double"), F.col("e_min") - a * span)
    high = F.least(F.col("e_last").cast("double"), F.col("e_max") + b * span)
    return pixels.join(params, "img").withColumn("eq", F.when(high > low, max_pixel / (high - low) * (F.col("v") - F.col("e_min"))).otherwise(F.lit(0.0)))


def tone_curve(pixels: DataFrame, sub: float = 0.0, mul: float = 1 / 255, gamma: float = 0.8) -> DataFrame:
    """Black passes; the rest is clamped to 0..1 and raised to gamma."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("eq") + sub) * mul))
    return pixels.withColumn("tone", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.pow(x, F.lit(gamma))))


def reduce_by_two(pixels: DataFrame) -> DataFrame:
    """Box average of 2 x 2 pixels."""
    return pixels.groupBy("img", "tile", F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py")).agg(F.avg("v").alias("v"))


def ordered(objects: DataFrame) -> DataFrame:
    """Every tile with its place, from 1, in the index order of its image."""
    order = Window.partitionBy("img").orderBy("rset", "y", "x", "size")
    return objects.withColumn("position", F.row_number().over(order).cast("long"))


def offsets(objects: DataFrame) -> DataFrame:
    """Byte offset of every tile in its image's index file, tiles in index order."""
    order = Window.partitionBy("img").orderBy("rset", "y", "x", "size").rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")))


def summed_area(pixels: DataFrame) -> DataFrame:
    """Sums over all pixels above and left, inclusive, within each tile."""
    rows = Window.partitionBy("img", "tile", "py").orderBy("px").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy("img", "tile", "px").orderBy("py").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("_row", F.sum("v").over(rows)).withColumn("area", F.sum("_row").over(cols)).drop("_row")


def cut(pixels: DataFrame, size: int) -> DataFrame:
    """Image pixels (img, x, y, v) to tile pixels; the last tiles are padded by whoever draws them."""
    tile = lambda c: F.floor(F.col(c) / size)
    return pixels.select("img", tile("x").alias("col"), tile("y").alias("row"), (F.col("x") % size).alias("px"), (F.col("y") % size).alias("py"), "v")


def reduce_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Four tiles (img, col, row, px, py, v) to their parent of the same size, by the mean of 2 x 2 pixels.

    A child that is missing leaves its quarter without rows.
    """
    half = lambda c, p: F.floor((F.col(c) % 2 * size + F.col(p)) / 2)
    keys = [F.floor(F.col("col") / 2).alias("col"), F.floor(F.col("row") / 2).alias("row"), half("col", "px").alias("px"), half("row", "py").alias("py")]
    return pixels.groupBy("img", *keys).agg(F.avg("v").alias("v"))


def merge_bands(pixels: DataFrame) -> DataFrame:
    """Rows (img, tile, px, py, band, v) to r, g, b, a: three bands stand in reverse order, of fewer the first serves for all."""
    by = pixels.groupBy("img", "tile", "px", "py").agg(*(F.max(F.when(F.col("band") == i, F.col("v"))).alias(f"b{i}") for i in range(3)))
    full = F.col("b2").isNotNull()
    pick = lambda i: F.when(full, F.col(f"b{i}")).otherwise(F.col("b0"))
    return by.select("img", "tile", "px", "py", pick(2).alias("r"), pick(1).alias("g"), pick(0).alias("b"), F.lit(255).alias("a"))


def sample(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Bilinear values at (img, tile, id, u, v): four corners by one equi-join, weights renormalised at the border."""
    corners = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    p = points.withColumn("c", F.explode(corners)).withColumns({"px": (F.floor("u") + F.col("c.i")).cast("int"), "py": (F.floor("v") + F.col("c.j")).cast("int")})
    share = lambda at, k: F.when(F.col(k) == 1, F.col(at) - F.floor(at)).otherwise(1 - (F.col(at) - F.floor(at)))
    weighted = p.withColumn("w", share("u", "c.i") * share("v", "c.j")).join(pixels.withColumnRenamed("v", "value"), ["img", "tile", "px", "py"])
    return weighted.groupBy("img", "tile", "id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def _triangle(f: Column) -> Column:
    return 1 - F.abs(f) / 2


def _catmull(f: Column) -> Column:
    f = F.abs(f)
    near, far = ((1.5 * f - 2.5) * f) * f + 1, ((-0.5 * f + 2.5) * f - 4) * f + 2
    return F.when(f < 1, near).when(f < 2, far).otherwise(F.lit(0.0))


KERNELS = {"bicubic": _triangle, "catmull": _catmull}


def resample(points: DataFrame, pixels: DataFrame, mode: str) -> DataFrame:
    """Values at (img, tile, id, u, v) by mode: nearest, linear, bicubic (triangle weights over 4 x 4 pixels) or catmull.

    Weights are renormalised over the pixels that exist; a point none of whose pixels exists gives no row.
    """
    if mode == "linear":
        return sample(points, pixels)
    if mode == "nearest":
        at = points.withColumns({"px": F.floor(F.col("u") + 0.5).cast("int"), "py": F.floor(F.col("v") + 0.5).cast("int")}).drop("u", "v")
        return at.join(pixels.withColumnRenamed("v", "value"), ["img", "tile", "px", "py"]).select("img", "tile", "id", F.col("value").cast("double").alias("value"))
    kernel = KERNELS[mode]
    taps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-1, 3) for j in range(-1, 3)))
    p = points.withColumn("c", F.explode(taps)).withColumns({"px": (F.floor("u") + F.col("c.i")).cast("int"), "py": (F.floor("v") + F.col("c.j")).cast("int")})
    share = lambda at, k: kernel(F.col(k) - (F.col(at) - F.floor(at)))
    weighted = p.withColumn("w", share("u", "c.i") * share("v", "c.j")).join(pixels.withColumnRenamed("v", "value"), ["img", "tile", "px", "py"])
    total = F.nullif(F.sum("w"), F.lit(0.0))
    return weighted.groupBy("img", "tile", "id").agg((F.sum(F.col("w") * F.col("value")) / total).alias("value"))


def mosaic(views: DataFrame, layers: DataFrame, cols: int, rows: int, size: float = 4.0) -> DataFrame:
    """Which layer each cell of a view shows: (view, i, j, img), the lowest z whose box holds the cell's middle.

    Views are (view, min_lon, min_lat, max_lon, max_lat), layers (img, z, img_min_lon, ...). Of equal boxes the lowest
    counts. In each square of a grid the lowest layer that covers it whole hides all that are above it; what is left there
    meets the middles in that square, so the work follows the cells asked for and not the depth of the stack. Views with one
    box share its cells, which are decided once; of a view with several boxes each cell shows the lowest of all. ``size``
    is a power of two, by which the squares are exact. Cells that no layer covers give no row; rows run from the south.
    """
    from .priority import grid_cells

    if math.frexp(size)[0] != 0.5:
        raise ValueError("the grid's size is a power of two")
    box = ["img_min_lon", "img_min_lat", "img_max_lon", "img_max_lat"]
    west, south, east, north = map(F.col, box)
    one = layers.groupBy(*box).agg(F.min(F.struct("z", "img")).alias("top"))
    held = one.withColumn("square", grid_cells(*box, size))
    x, y = F.col("square.cx") * size, F.col("square.cy") * size
    whole = (west <= x) & (east >= x + size) & (south <= y) & (north >= y + size)
    held = held.withColumn("whole", whole)
    lowest = held.filter("whole").groupBy("square").agg(F.min("top").alias("floor"))
    part = held.join(lowest, "square", "left").filter(F.col("floor").isNull() | (F.col("top") <= F.col("floor"))).select("square", "top", *box)
    at = lambda low, high, k, n: F.col(low) + (F.col(k) + 0.5) * ((F.col(high) - F.col(low)) / n)
    seen = ["min_lon", "min_lat", "max_lon", "max_lat"]
    cells = views.select(*seen).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    middles = cells.select(*seen, "i", "j", at("min_lon", "max_lon", "i", cols).alias("x"), at("min_lat", "max_lat", "j", rows).alias("y"))
    middles = middles.withColumn("square", F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")))
    inside = (F.col("x") >= west) & (F.col("x") < east) & (F.col("y") >= south) & (F.col("y") < north)
    shown = middles.join(part, "square").filter(inside).groupBy(*seen, "i", "j").agg(F.min("top").alias("top"))
    of_view = views.select("view", *seen).distinct().withColumn("boxes", F.count("*").over(Window.partitionBy("view")))
    out = of_view.join(shown.hint("merge"), seen).select("view", "i", "j", "top", "boxes")
    several = out.filter("boxes > 1").groupBy("view", "i", "j").agg(F.min("top").alias("top"))
    return out.filter("boxes = 1").select("view", "i", "j", "top").unionAll(several).select("view", "i", "j", F.col("top.img").alias("img"))


def finest(requests: DataFrame, stored: DataFrame, max_rset: int) -> DataFrame:
    """For each tile (img, rset, x, y) the finest stored tile that covers it: itself or an ancestor; null if none is stored."""
    up = F.explode(F.transform(F.sequence(F.col("rset"), F.lit(max_rset)), lambda r: F.struct(r.alias("r"), F.floor(F.col("x") / F.pow(F.lit(2), r - F.col("rset"))).alias("sx"), F.floor(F.col("y") / F.pow(F.lit(2), r - F.col("rset"))).alias("sy"))))
    chain = requests.select("img", "rset", "x", "y").distinct().withColumn("s", up).select("img", "rset", "x", "y", "s.*")
    have = stored.select("img", F.col("rset").alias("r"), F.col("x").cast("long").alias("sx"), F.col("y").cast("long").alias("sy")).distinct().withColumn("_have", F.lit(True))
    best = F.min(F.when(F.col("_have"), F.col("r"))).alias("served")
    return chain.join(have, ["img", "r", "sx", "sy"], "left").groupBy("img", "rset", "x", "y").agg(best)


def block_offsets(blocks: DataFrame, start: int = 0) -> DataFrame:
    """Where each block of (img, block, size, masked) is stored; masked ones take no room and have no offset."""
    before = Window.partitionBy("img").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    room = F.when(F.col("masked"), 0).otherwise(F.col("size"))
    at = F.coalesce(F.sum(room).over(before), F.lit(0)) + start
    return blocks.withColumn("offset", F.when(~F.col("masked"), at))


def valid_tile(data, size: int):
    """The bytes of a tile, or as many noughts if it is missing or has another length."""
    return F.when(F.length(data) == size, data).otherwise(F.lit(bytes(size)))
