"""Streams of tile requests: windows, late data, and micro-batch upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heatmap
from ..operators.warehouse import upsert
from ..sources.logs import parse_log


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Log files as they arrive in a folder."""
    return parse_log(spark.readStream.option("recursiveFileLookup", True).text(path))


def windowed_counts(cells: DataFrame, length: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Requests by window and cell; rows later than ``late`` behind the latest are dropped in a stream."""
    return cells.withWatermark("ts", late).groupBy(F.window("ts", length), "location").agg(F.count("*").alias("n"))


def scored_images(images: DataFrame, summaries: DataFrame) -> DataFrame:
    """A stream of new images joined with the static summaries of their cells."""
    boxes = images.withColumns({"rset": F.lit(0), "x": F.lit(0), "y": F.lit(0)})
    located = heatmap.located(heatmap.tile_boxes(boxes.select("img", "rset", "x", "y"), images))
    return located.join(summaries, "location")


def upsert_batch(path_of, keys: list[str], order: str):
    """A foreachBatch function: batch n merges with the table that batch n - 1 wrote, into a path of its own.

    Writing the same batch again gives the same table, so at-least-once delivery is safe.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(path_of(n - 1)) if n else batch.limit(0)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(path_of(n))

    return write


def once(requests: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Requests without repeats of their keys within the watermark; state is dropped as the watermark passes."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def visits(requests: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: requests no further apart than the gap."""
    by = requests.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user")
    return by.agg(F.count("*").alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unexpired(entries: DataFrame, now: int, ttl: int | None = None, tti: int | None = None) -> DataFrame:
    """Cache entries (created, used in seconds) younger than ttl and used within tti."""
    out = entries
    if ttl is not None:
        out = out.filter(F.col("created") > now - ttl)
    return out if tti is None else out.filter(F.coalesce("used", "created") > now - tti)
