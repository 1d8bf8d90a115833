"""Access logs to geohash heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, tiles
from ..plans.domain import DEG_PER_PIXEL


def tile_boxes(log: DataFrame, images: DataFrame, deg: float = DEG_PER_PIXEL) -> DataFrame:
    """Log rows with the box of their tile. Images are metadata, a row a picture; Spark broadcasts them while small."""
    j = log.join(images, "img")
    x0, y0, x1, y1 = tiles.rect(F.col("width"), F.col("height"), F.col("rset"), F.col("x"), F.col("y"))
    return j.withColumns({"min_lon": F.col("lon0") + x0 * deg, "max_lon": F.col("lon0") + x1 * deg, "min_lat": F.col("lat0") - y1 * deg, "max_lat": F.col("lat0") - y0 * deg})


def located(boxes: DataFrame) -> DataFrame:
    """Precision by the width of the box, and the cell of its south-west corner."""
    width = geo.haversine_km(F.col("min_lat"), F.col("min_lon"), F.col("min_lat"), F.col("max_lon"))
    return boxes.withColumn("p", geo.geohash_precision(width)).withColumn("location", geo.geohash(F.col("min_lat"), F.col("min_lon"), F.col("p")))


def request_counts(cells: DataFrame) -> DataFrame:
    """Counts by cell for everyone (user ``global``) and by cell and user, in one aggregation.

    Rows without user count for everyone only; ``admin`` has no rows of its own.
    """
    base = cells.groupBy("location", "user").agg(F.count("*").alias("n"))
    own = F.when(F.col("user").isNotNull() & (F.col("user") != "admin"), F.array(F.lit("global"), F.col("user"))).otherwise(F.array(F.lit("global")))
    return base.select("location", F.explode(own).alias("user"), "n").groupBy("location", "user").agg(F.sum("n").alias("requestCount"))


def summaries(log: DataFrame, images: DataFrame) -> DataFrame:
    return request_counts(located(tile_boxes(log, images)))
