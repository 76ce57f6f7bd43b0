"""The shared folder, and order numbers that hold at any scale."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master may do without and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return _own[0]


#: Paths of the shared folder that were made and not deleted yet, in order.
_made: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, noted for ``release``."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends there.

    The table stays until ``release`` or the end of the driver, as a lazy result may read it.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, in any store that Spark can write."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def release(spark: SparkSession, but: frozenset[str] = frozenset()) -> None:
    """Delete what was made, once the results that read it are written."""
    for path in [p for p in _made if p not in but]:
        dropped(spark, path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is made inside."""
    before = frozenset(_made)
    try:
        yield
    finally:
        release(spark, before)


@atexit.register
def _leave() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _made:
        with suppress(Exception):  # the session may be gone, and its files are the cluster's to clear then
            release(spark)


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them to one task.

    Ranges are sorted on their own; the driver adds up one count for each range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    if not before:
        return placed.withColumn(name, F.col("_at")).drop("_at")
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))  # one row a range
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, place + F.col("_before")).drop("_at", "_part", "_before")
