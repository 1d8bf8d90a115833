"""Readers of map features, product descriptions and uncompressed imagery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def features(documents: DataFrame, column: str = "value") -> DataFrame:
    """GeoJSON texts, one a row, to rows (kind, coordinates as a variant, properties). Texts that do not parse give none.

    A text is a collection of features, one feature, or a bare geometry, which has no properties.
    """
    parsed = documents.select(F.try_parse_json(F.col(column)).alias("doc"))
    kind = F.try_variant_get("doc", "$.type", "string")
    items = F.when(kind == "FeatureCollection", F.try_variant_get("doc", "$.features", "array<variant>")).when(kind.isNotNull(), F.array("doc"))
    part = lambda path, kind: F.try_variant_get("f", path, kind)
    own = part("$.type", "string") == "Feature"
    rows = parsed.select(F.explode(items).alias("f")).select("f", own.alias("own"))
    return rows.select(
        F.when(F.col("own"), part("$.geometry.type", "string")).otherwise(part("$.type", "string")).alias("kind"),
        F.when(F.col("own"), part("$.geometry.coordinates", "variant")).otherwise(part("$.coordinates", "variant")).alias("coordinates"),
        F.when(F.col("own"), part("$.properties", "map<string,string>")).alias("properties"),
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features of GeoJSON files: (lon, lat, properties); other kinds are left out."""
    rows = features(spark.read.text(path, wholetext=True, recursiveFileLookup=True)).filter("kind = 'Point'")
    at = F.try_variant_get("coordinates", "$", "array<double>")
    return rows.select(at[0].alias("lon"), at[1].alias("lat"), "properties")


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of GeoJSON files, those of a multipolygon one by one, with the box of their outer ring: (ring, west, south, east, north, properties)."""
    rows = features(spark.read.text(path, wholetext=True, recursiveFileLookup=True)).filter("kind IN ('Polygon', 'MultiPolygon')")
    one = F.array(F.try_variant_get("coordinates", "$", "array<array<array<double>>>"))
    many = F.try_variant_get("coordinates", "$", "array<array<array<array<double>>>>")
    rows = rows.select(F.explode(F.when(F.col("kind") == "Polygon", one).otherwise(many)).alias("rings"), "properties")
    ring = F.get("rings", F.lit(0))
    axis = lambda i: F.transform("ring", lambda p: p[i])
    sides = (f(axis(i)).alias(n) for n, f, i in (("west", F.array_min, 0), ("south", F.array_min, 1), ("east", F.array_max, 0), ("north", F.array_max, 1)))
    return rows.select(ring.alias("ring"), "properties").select("ring", *sides, "properties")


def tile_parts(spark: SparkSession, path: str) -> DataFrame:
    """Tile entries of XML product descriptions (elements TILE with FILENAME and the upper left offset)."""
    rows = spark.read.format("xml").option("rowTag", "TILE").schema("FILENAME string, ULCOLOFFSET long, ULROWOFFSET long").load(path)
    part = lambda letter: F.regexp_extract("FILENAME", rf"[_\d]{letter}(\d+)", 1).try_cast("int")
    return rows.select(F.col("FILENAME").alias("file"), F.col("ULCOLOFFSET").alias("x"), F.col("ULROWOFFSET").alias("y"), part("R").alias("part_row"), part("C").alias("part_col"))


def listing(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, length) of all files under a prefix; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(prefix).select("path", "length")


def tile_path(root: str, image: str, stamp: str, rset: int, x: int, y: int, band: int = 0) -> str:
    return f"{root.rstrip('/')}/{image}/{stamp}/{rset}/{x}/{y}/{band}.png"


def read_tile(spark: SparkSession, root: str, *address) -> bytes | None:
    """The bytes of one stored tile by its address (as in :func:`tile_path`); None if it is not stored."""
    file = spark._jvm.org.apache.hadoop.fs.Path(tile_path(root, *address))
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return None
    return bytes(spark.read.format("binaryFile").load(str(file)).first().content)


def read_tiles(spark: SparkSession, root: str) -> DataFrame:
    """All tiles under a root: (image, stamp, rset, x, y, band, length, content); columns not asked for are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = lambda i: F.regexp_extract("path", r"/([^/]+)/([^/]+)/(\d+)/(\d+)/(\d+)/(-?\d+)\.png$", i)
    numbers = (part(i).try_cast("int").alias(n) for i, n in enumerate(("rset", "x", "y", "band"), 3))
    return rows.filter(part(1) != "").select(part(1).alias("image"), part(2).alias("stamp"), *numbers, "length", "content")


def access_lines(spark: SparkSession, n: int, images: DataFrame, seed: int = 1) -> DataFrame:
    """Synthetic log rows: n requests to tiles of (img, width, height, max_rset), each with its eight neighbours and all ancestors."""
    count = images.count()
    numbered = images.select("img", "width", "height", "max_rset").withColumn("k", F.row_number().over(_by_img()) - 1)
    h = lambda s: F.abs(F.xxhash64("id", F.lit(seed), F.lit(s)) % 1_000_003) / 1_000_003.0
    side = lambda c, r: F.ceil(F.col(c) / (F.pow(F.lit(2), r) * 512)).cast("long")
    asks = spark.range(n).withColumn("k", F.floor(h("image") * max(count, 1)).cast("int")).join(F.broadcast(numbered) if count < 100_000 else numbered, "k")
    base = asks.withColumns({"x": F.floor(h("x") * side("width", F.lit(0))), "y": F.floor(h("y") * side("height", F.lit(0)))})
    near = [F.struct(F.lit(0).alias("rset"), (F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    above = F.transform(F.filter(F.sequence(F.lit(0), F.col("max_rset")), lambda r: r > 0), lambda r: F.struct(r.alias("rset"), F.floor(F.col("x") / F.pow(F.lit(2), r)).alias("x"), F.floor(F.col("y") / F.pow(F.lit(2), r)).alias("y")))
    rows = base.select("id", "img", "width", "height", F.explode(F.concat(F.array(*near), above)).alias("t")).select("id", "img", "t.*", "width", "height")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < side("width", F.col("rset"))) & (F.col("y") < side("height", F.col("rset")))
    return rows.filter(inside).select("id", "img", "rset", "x", "y")


def _by_img():
    from pyspark.sql import Window

    return Window.orderBy("img")  # image metadata, a row an image


def samples(content: Column, at: Column, elements: Column, bytes_each: int) -> Column:
    """Unsigned big-endian samples from binary data; used for headers and small blocks."""
    from ..functions.keys import big_endian

    return F.transform(F.sequence(F.lit(0), elements - 1), lambda i: big_endian(content, at + i * bytes_each, bytes_each))


def read_blocks(blocks: DataFrame, tile: int, bytes_each: int = 1) -> DataFrame:
    """Uncompressed blocks (img, block, mode, bands, data) to pixels (img, block, band, px, py, v).

    The data of a block are its own bytes: band after band (S, B), by pixel (P) or by row (R). Blocks that are missing or
    too short give no pixels.
    """
    kind = {1: ">u1", 2: ">u2", 4: ">u4"}[bytes_each]
    img = blocks.schema["img"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                bands, need = int(r.bands), int(r.bands) * tile * tile * bytes_each
                if r.data is None or len(r.data) < need:
                    continue
                flat = np.frombuffer(r.data, kind, count=need // bytes_each)
                shape, axes = {"P": ((tile, tile, bands), (2, 0, 1)), "R": ((tile, bands, tile), (1, 0, 2))}.get(r.mode, ((bands, tile, tile), (0, 1, 2)))
                v = flat.reshape(shape).transpose(axes)
                band, py, px = (a.ravel() for a in np.indices(v.shape))
                yield pd.DataFrame({"img": r.img, "block": r.block, "band": band, "px": px, "py": py, "v": v.ravel().astype(np.int64)})

    return blocks.select("img", "block", "mode", "bands", "data").mapInPandas(run, f"img {img}, block bigint, band int, px int, py int, v bigint")
