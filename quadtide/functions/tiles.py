"""Quadtree algebra of tile pyramids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dims(width: Column, height: Column, rset: Column, tile: int = 512) -> tuple[Column, Column]:
    """(columns, rows) of a resolution set."""
    size = F.pow(F.lit(2), rset) * tile
    return F.ceil(width / size), F.ceil(height / size)


def dims_virtual(width: Column, height: Column, rset: Column, tile: int = 512) -> tuple[Column, Column]:
    """Like :func:`dims`, with the image halved in whole pixels first; scoring counts tiles so."""
    scale = F.pow(F.lit(2), rset)
    return F.ceil(F.floor(width / scale) / tile), F.ceil(F.floor(height / scale) / tile)


def max_rset(width: Column, height: Column, tile: int = 512) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(width, height) / tile)), F.lit(0))


def max_rset_parts(width: Column, height: Column, tile: int = 512) -> Column:
    """Of a multi-part image: whole tiles are counted before the logarithm."""
    return F.ceil(F.log2(F.greatest(F.floor(width / tile), F.floor(height / tile))))


def parent(rset: Column, x: Column, y: Column) -> Column:
    return F.struct((rset + 1).alias("rset"), F.floor(x / 2).alias("x"), F.floor(y / 2).alias("y"))


def children(rset: Column, x: Column, y: Column) -> Column:
    """Array of the four tiles one set finer; empty at full resolution."""
    four = F.array(*(F.struct((rset - 1).alias("rset"), (x * 2 + i).alias("x"), (y * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)))
    return F.when(rset > 0, four).otherwise(F.filter(four, lambda t: F.lit(False)))


def border(width: Column, height: Column, rset: Column, x: Column, y: Column, dx: int, dy: int, tile: int = 512) -> Column:
    """The tile dx columns and dy rows away in the same set; null outside the grid."""
    columns, rows = dims(width, height, rset, tile)
    inside = (x + dx >= 0) & (x + dx < columns) & (y + dy >= 0) & (y + dy < rows)
    return F.when(inside, F.struct(rset.alias("rset"), (x + dx).alias("x"), (y + dy).alias("y")))


def part_offset(part: Column, tiles_per_part: Column, rset: Column) -> Column:
    """First tile row (or column) in a resolution set of the part at a row (or column) of a multi-part image, from 0."""
    return F.floor(part * tiles_per_part / F.pow(F.lit(2), rset))


def rect(width: Column, height: Column, rset: Column, x: Column, y: Column, tile: int = 512) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) in full-resolution pixels, clipped to the image."""
    size = F.pow(F.lit(2), rset) * tile
    return x * size, y * size, F.least((x + 1) * size, width), F.least((y + 1) * size, height)


def scale_of(rset: Column) -> Column:
    return F.pow(F.lit(0.5), rset)


def rset_of(scale: Column) -> Column:
    return F.log(scale) / F.lit(-0.6931471805599453)


def abbreviated(n: Column) -> Column:
    """1500 is ``1k``."""
    return F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).otherwise(n.cast("string"))
