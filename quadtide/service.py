"""The services of the engine over stored tables: summaries, users, areas, prefetch lists, tile scores and the catalogue.

A put writes one batch folder, so writing it again with the same stamp replaces it; a read keeps the latest row of each key.
:meth:`Warehouse.compact` folds the batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import warehouse

#: Key and columns of each table. A prefetch list is keyed by user too, so that users do not replace each other's.
TABLES = {
    "summaries": (["location", "user", "start"], "location string, user string, start bigint, requestCount bigint"),
    "users": (["user"], "user string"),
    "areas": (["user", "start"], "user string, start bigint, min_lon double, min_lat double, max_lon double, max_lat double, importance float"),
    "cache_lists": (["user", "img", "date"], "user string, img bigint, date bigint, tiles array<struct<rset: int, x: bigint, y: bigint>>"),
    "tile_scores": (["img", "rset", "x", "y"], "img bigint, rset int, x bigint, y bigint, score bigint"),
    "images": (["img"], "img bigint, name string, collected bigint, min_lon double, min_lat double, max_lon double, max_lat double"),
}
CAPS = {"summaries": 10_000, "areas": 1_000, "cache_lists": 10_000}


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, table: str, rows: DataFrame, stamp: int) -> tuple[int, int, str]:
        """Store rows under a stamp; (stored, refused, table). Rows with a null in their key are refused."""
        keys, schema = TABLES[table]
        typed = self.spark.createDataFrame([], schema).unionByName(rows.select(*self._columns(table)))
        bad = F.lit(False)
        for k in keys:
            bad = bad | F.col(k).isNull()
        target = f"{self.path}/{table}/stamp={int(stamp)}"
        typed.filter(~bad).write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target).count(), typed.filter(bad).count(), table

    def table(self, table: str, before: int | None = None) -> DataFrame:
        """The latest row of each key, of batches before a stamp if one is given; empty if nothing is stored."""
        keys, schema = TABLES[table]
        if not self._exists(table):
            return self.spark.createDataFrame([], schema)
        rest = [c for c in self._columns(table) if c not in keys]
        stored = self.spark.read.schema(f"{schema}, stamp bigint").option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        if before is not None:
            stored = stored.filter(F.col("stamp") < before)
        if not rest:
            return stored.select(*keys).distinct()
        latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("stamp", *(c for c in rest if c != "tiles"))).alias("_v"))
        return latest.select(*keys, "_v.*")

    def compact(self, table: str, stamp: int) -> None:
        """Fold all batches before a stamp, which must be new, into one of that stamp; the old ones go once it is written."""
        self.put(table, self.table(table, stamp), stamp)
        folder = self._hadoop(f"{self.path}/{table}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("stamp=") and int(name.removeprefix("stamp=")) < stamp:
                fs.delete(status.getPath(), True)

    # endpoints

    def put_summaries(self, rows: DataFrame, stamp: int) -> tuple[int, int, str]:
        """Store summaries with lower-case users, and register users that are new."""
        lower = rows.withColumn("user", F.lower("user"))
        done = self.put("summaries", lower, stamp)
        self.put("users", warehouse.unseen_users(lower, self.table("users", stamp)), stamp)
        return done

    def search_summaries(self, user: str | None = None, precision: int | None = None, bbox: str | None = None, start: int | None = None, end: int | None = None, apply_time_range: bool = False) -> DataFrame:
        """Times are taken but not applied unless asked for, as callers expect."""
        rows = self.table("summaries")
        if apply_time_range:
            rows = rows.filter(F.col("start").between(start if start is not None else 0, end if end is not None else 2**62))
        return warehouse.search_summaries(rows, user, precision, bbox, CAPS["summaries"])

    def users(self) -> DataFrame:
        return self.table("users")

    def areas(self, user: str, since: int = 0) -> DataFrame:
        return self.table("areas").filter((F.col("user") == user) & (F.col("start") >= since)).orderBy("start").limit(CAPS["areas"])

    def cache_lists(self, user: str, since: int = 0) -> DataFrame:
        return self.table("cache_lists").filter((F.col("user") == user) & (F.col("date") >= since)).orderBy("img", "date").limit(CAPS["cache_lists"])

    def users_to_update(self, now: int, period: int) -> DataFrame:
        """Users without a prefetch list of the last period."""
        return warehouse.without_recent(self.users(), self.table("cache_lists"), now - period)

    def catalog_search(self, start: int | None = None, end: int | None = None, bbox: str | None = None, wkt: str | None = None) -> DataFrame:
        return warehouse.catalog_search(self.table("images"), start, end, bbox, wkt=wkt)

    def catalog_get(self, name: str) -> DataFrame:
        return self.table("images").filter(F.col("name") == name)

    def catalog_all(self) -> DataFrame:
        return self.table("images")

    def _columns(self, table: str) -> list[str]:
        return self.spark.createDataFrame([], TABLES[table][1]).columns

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, table: str) -> bool:
        folder = self._hadoop(f"{self.path}/{table}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
