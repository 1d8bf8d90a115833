"""Block layouts, tile matrices, scales and chip windows as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An offset of all ones marks a block that is not stored.
MASKED = 0xFFFFFFFF


def block_layout(mode: Column, bits: Column, pixels: Column, bands: Column, blocks: Column) -> Column:
    """struct(block_bytes, read_offset, elements, reads) of an uncompressed block.

    Modes are S (bands one after another), P (by pixel), B (by block) and R (by row). Blocks of one bit a pixel are packed.
    """
    sample = F.floor((bits + 7) / 8)
    packed, plain = F.floor((pixels + 7) / 8), pixels * sample
    size = F.when(bits == 1, packed).when(mode == "P", plain * bands).otherwise(plain)
    per_block = F.floor(size / sample)
    return F.struct(
        size.cast("long").alias("block_bytes"),
        F.when(mode == "S", size * blocks).when(mode == "B", size).otherwise(0).cast("long").alias("read_offset"),
        F.when(mode == "S", pixels).when(mode.isin("P", "B"), per_block).otherwise(per_block * bands).cast("long").alias("elements"),
        F.when(mode.isin("S", "B"), bands).otherwise(1).cast("long").alias("reads"),
    )


def matrix_sizes(width: Column, height: Column, levels: Column, tile: int = 512, swapped: bool = False) -> Column:
    """Array of struct(level, scale, cols, rows); pixels are halved in whole numbers. ``swapped`` exchanges the axes."""
    cols, rows = (height, width) if swapped else (width, height)

    def level(i: Column) -> Column:
        step = F.pow(F.lit(2), i)
        count = lambda n: F.ceil(F.floor(n / step) / tile).cast("long")
        return F.struct(i.alias("level"), step.cast("long").alias("scale"), count(cols).alias("cols"), count(rows).alias("rows"))

    return F.transform(F.sequence(F.lit(0), levels.cast("int")), level)


def texture_share(width: Column, height: Column, rset: Column, x: Column, y: Column, tile: int = 512) -> tuple[Column, Column]:
    """Shares of a tile's columns and rows that hold image."""
    size = F.pow(F.lit(2), rset) * tile
    return tuple(F.greatest(F.lit(0.0), F.least((i + 1) * size, n) - i * size) / size for i, n in ((x, width), (y, height)))


def chip_window(x: Column, y: Column, w: Column, h: Column, out_w: Column, out_h: Column, width: Column, height: Column, max_rset: Column, tile: int = 512) -> Column:
    """struct(rset, level, col0, row0, col1, row1): the set that serves a chip and the tiles it touches; null beside the image.

    ``rset`` is the exact set of the coarser scale, ``level`` the stored set below it.
    """
    scale = F.least(out_w / w, out_h / h)
    rset = F.log(scale) / F.lit(-0.6931471805599453)
    level = F.greatest(F.lit(0), F.least(F.floor(F.round(rset, 9)), max_rset)).cast("int")
    size = F.pow(F.lit(2), level) * tile
    first = lambda v: F.floor(F.greatest(v, F.lit(0)) / size)
    last = lambda v, n: F.floor((F.least(v, n) - 1) / size)
    inside = (x < width) & (y < height) & (x + w > 0) & (y + h > 0)
    return F.when(inside, F.struct(rset.alias("rset"), level.alias("level"), first(x).alias("col0"), first(y).alias("row0"), last(x + w, width).alias("col1"), last(y + h, height).alias("row1")))


def view_rset(map_gsd: Column, image_gsd: Column) -> Column:
    return F.bround(F.log2(map_gsd / image_gsd), 5)


def covered(image: tuple[Column, Column, Column, Column], view: tuple[Column, Column, Column, Column]) -> Column:
    """Share of a view that an image covers; boxes are (west, south, east, north)."""
    w = F.least(image[2], view[2]) - F.greatest(image[0], view[0])
    h = F.least(image[3], view[3]) - F.greatest(image[1], view[1])
    return F.when((w > 0) & (h > 0), w * h / ((view[2] - view[0]) * (view[3] - view[1]))).otherwise(F.lit(0.0))


def cluster_id(index: Column, zoom: Column) -> Column:
    return F.shiftleft(index, 5) + zoom + 1


def cluster_origin(cluster: Column) -> tuple[Column, Column]:
    """(index, zoom + 1) of a cluster's id."""
    return F.shiftright(cluster, 5), cluster % 32


def in_tile(mx: Column, my: Column, zoom: Column, x: Column, y: Column, extent: int = 512) -> tuple[Column, Column]:
    """Whole coordinates inside a map tile; halves go up."""
    n = F.pow(F.lit(2.0), zoom)
    return F.floor(extent * (mx * n - x) + 0.5), F.floor(extent * (my * n - y) + 0.5)


def smoothed(old: Column, new: Column, most: float) -> Column:
    """One frame's move from an old value towards a new one, at most ``most`` long."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (new - old + most) / (2 * most)))
    return old + most * (t * t * (3 - 2 * t) * 2 - 1)
