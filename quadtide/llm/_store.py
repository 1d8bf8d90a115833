"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast if its rows have at most so many bytes.
BROADCAST_BYTES = 32 * 2**20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or, where that is unset, a folder in its warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quadtide"


class Store:
    """The tables of one call, in a folder of their own.

    Operators take a store as an argument; who gives one may :meth:`delete` it as soon as every result that reads it is
    stored, and touches nobody else's tables by that. Where none is given, the operator's own store lasts as long as the
    application: its folder is deleted when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and read it again: lineage ends there, and a lost executor loses none of it."""
        path = f"{self.path}/{tag}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        folder, system = self._folder()
        system.deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        folder, system = self._folder()
        system.delete(folder, True)


def small(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows add up to at most ``limit`` bytes; else ``df`` itself."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", most: int = 10_000, least: int = 1_000) -> DataFrame:
    """Join (``inner`` or ``left``) of ``rows`` with ``side``, which has one row a key and in ``count`` how many of the ``total`` rows have it.

    Keys with more than ``least`` and ``total / most`` rows are at most ``most``; they are joined where the rows are, by
    broadcast. The others are shuffled, and none of them makes a large task.
    """
    hot = F.col(count) > max(least, total // most)
    many = F.broadcast(side.filter(hot))
    here = rows.join(many, keys)
    there = rows.join(F.broadcast(side.filter(hot).select(*keys)), keys, "left_anti").join(side.filter(~hot), keys, how)
    return here.unionByName(there)
