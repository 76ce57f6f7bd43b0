"""Structured Streaming over sources: each micro-batch is extracted and merged by key.

A batch writes new versions of the tables and then one line that names the
current ones; a batch that runs again finds its number taken and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import NODES
from ..operators.assembly import merge_nodes


def upsert_nodes(current: DataFrame, arrived: DataFrame) -> DataFrame:
    """Nodes merged with later ones: types united, attributes by their last value."""
    first = current.select("id", "types", "attributes", F.lit(0).alias("step"), F.lit(0).cast("long").alias("seq"))
    return merge_nodes(first.unionByName(arrived.select("id", "types", "attributes", F.lit(1).alias("step"), F.col("seq").cast("long").alias("seq"))))


class KeyedMerge:
    """A ``foreachBatch`` sink that keeps nodes in ``path``."""

    def __init__(self, path: str, extract: Callable[[DataFrame], DataFrame]) -> None:
        self.path, self.extract = path.rstrip("/"), extract

    def _versions(self, spark: SparkSession) -> list[int]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        names = [s.getPath() for s in files.listStatus(at)]
        return sorted(int(p.getName().split("=")[1]) for p in names if "=" in p.getName() and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def current(self, spark: SparkSession) -> DataFrame:
        """The nodes after the last whole batch."""
        versions = self._versions(spark)
        return spark.read.schema(NODES).parquet(f"{self.path}/batch={versions[-1]}") if versions else spark.createDataFrame([], NODES)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in self._versions(spark):
            return
        merged = upsert_nodes(self.current(spark), self.extract(batch))
        merged.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
