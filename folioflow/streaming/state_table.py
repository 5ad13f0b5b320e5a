"""A keyed table on shared storage that a stream updates batch by batch.

The table is bucketed by key. A batch is first combined by key, then only the buckets it touches are read, merged and
replaced. Merging is a minimum or maximum per column, so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.session import cut, file_system


class StateTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], merged: Callable[[], list[Column]], buckets: int = 32):
        """``merged`` gives the aggregates that combine rows of one key, named like the columns they combine."""
        self.spark, self.path, self.keys, self.merged, self.buckets = spark, path, keys, merged, buckets

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame | None:
        """The table, or null before its first batch."""
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return None
        return self.spark.read.parquet(self.path)

    def upsert(self, batch: DataFrame) -> None:
        """Merge a batch in; an empty one leaves the table as it is (and a first empty one makes no table)."""
        rows = cut(self._bucketed(batch).groupBy("bucket", *self.keys).agg(*self.merged()))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        old = self.read()
        if old is not None:
            rows = cut(rows.unionByName(old.filter(F.col("bucket").isin(touched)).select(rows.columns)).groupBy("bucket", *self.keys).agg(*self.merged()))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
