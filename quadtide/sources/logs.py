"""Readers: tile access logs, tile keys, URLs and image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "imageID string, rSet string, x string, y string, userID string"


def parse_log(lines: DataFrame) -> DataFrame:
    """Rows of ``value`` (one JSON object a line) to typed log rows; lines that do not parse keep null fields and the line."""
    r = F.from_json("value", LOG_SCHEMA)
    parts = F.split(r["imageID"], ":")
    typed = lines.select("value", r.alias("r"), parts.alias("p"))
    return typed.select(
        F.try_element_at("p", F.lit(1)).alias("collection"), F.try_element_at("p", F.lit(2)).alias("timestamp"), *(F.expr(f"try_cast(r.{c} AS INT)").alias(c.lower()) for c in ("rSet", "x", "y")), F.col("r.userID").alias("user"),
        F.when(F.coalesce(F.size("p"), F.lit(0)) != 2, F.col("value")).alias("corrupt"),
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.option("recursiveFileLookup", True).text(path))


def log_window(spark: SparkSession, path: str) -> DataFrame:
    """First and last collection time in the names of the log files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    stamp = F.to_timestamp(F.regexp_extract("path", r"(20\d\d-\d\d-\d\d-\d\d-\d\d-\d\d)", 1), "yyyy-MM-dd-HH-mm-ss")
    return files.agg(F.min(stamp).alias("start"), F.max(stamp).alias("end"))


def parse_tile_key(key: Column) -> Column:
    """``collection/timestamp/rset/x/y/band.png``; null if the key is none."""
    pattern = r"^([^/]+)/([^/]+)/(\d+)/(\d+)/(\d+)/(-?\d+)\.png$"
    part = lambda i: F.regexp_extract(key, pattern, i)
    fields = [part(1).alias("collection"), part(2).alias("timestamp")]
    numbers = [part(i).try_cast("int").alias(n) for i, n in ((3, "rset"), (4, "x"), (5, "y"), (6, "band"))]
    return F.when(key.rlike(pattern), F.struct(*fields, *numbers))


def image_format(head: Column) -> Column:
    """Kind of image file by its first bytes."""
    h = F.hex(F.substring(head, 1, 5))
    return F.when(h == "4E49544630", "nitf").when(h.startswith("49492A00"), "tiff").when(h.startswith("4D4D002A"), "tiff").otherwise("unknown")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", image_format(F.col("content")).alias("format"))


def byte_ranges(header: Column) -> Column:
    """(start, end) pairs of an HTTP range header; null ends are open."""
    found = F.arrays_zip(F.regexp_extract_all(header, F.lit(r"(\d*)-(\d*)"), F.lit(1)).alias("a"), F.regexp_extract_all(header, F.lit(r"(\d*)-(\d*)"), F.lit(2)).alias("b"))
    return F.transform(found, lambda r: F.struct(r["a"].try_cast("long").alias("start"), r["b"].try_cast("long").alias("end")))
