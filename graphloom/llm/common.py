"""What the operators share: table access, the shared folder, row numbering, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import _made, dropped, release, released, scratch  # noqa: F401  (one rule for what lies in the shared folder)

#: A row's number holds the partition above these bits and the place in it below.
PLACE_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Keys that hold over one part in so many of all rows are hot; there are at most as many of them.
HOT = 1_000


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage, so a lost executor costs a re-read and not a
    recomputation, and fixes row numbers that depend on the input's split.
    """
    return kept(df, tag)[0]


def kept(df: DataFrame, tag: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that are dropped before the end."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    written(df, path, codec)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, path: str, codec: str | None = None) -> None:
    """Write Parquet; the query's shuffle files go when it ends, as nothing reads them again.

    The session's codec is used unless another is named: closer ones take memory outside the heap.
    Python workers get batches of at most ``BATCH`` bytes; a lower setting of the session holds.
    """
    conf = df.sparkSession.conf
    low = {name: str(bound) for name, bound in BATCH.items() if not 0 < (_number(conf.get(name, None)) or 0) <= bound}
    names = {CLEANUP: "true", **low}
    before = {name: conf.get(name, None) for name in names}
    for name, value in names.items():
        conf.set(name, value)
    try:
        (df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", "1") if codec else df.write).parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


#: Spark's own setting to delete the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch: a task holds it several times over, on both sides and as Python objects.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def _number(text: str | None) -> int | None:
    """A setting that is a plain number, of rows or bytes; None for others."""
    return int(text) if text and text.lstrip("-").isdigit() else None


def store(folder: str):
    """The store of a folder's URI, and the path there, for tasks that read and write files of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def with_rows(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``df`` with numbered rows, written, so that the numbers hold however it is read later; and their column."""
    name = fresh(df, name)
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


#: Rows that share the bits of their numbers above these are a block, whose marks are one file of 128 KB.
BLOCK_BITS = 20


def only(df: DataFrame, row: str, stays: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Rows of ``df`` whose number in column ``row`` is in the one column of ``stays``.

    A semi join that moves row numbers alone: they are dealt by blocks, each
    block's are written as bits to the shared folder, and whoever reads a row
    looks up its bit. The driver holds one path a block.
    """
    spark = df.sparkSession
    folder = scratch(spark, "marks")
    numbers = stays.toDF("row")
    dealt = numbers.repartition(F.shiftright("row", bits)).sortWithinPartitions("row")
    made = stored(dealt.mapInArrow(tidied(_marked(folder, bits)), "block long, path string"), "blocks")
    paths = spark.sparkContext.broadcast({r["block"]: r["path"] for r in made.collect()})  # one row a block
    return df.where(_staying(folder, paths, bits)(F.col(row)))


def _marked(folder: str, bits: int) -> Callable:
    """Bits of each block of sorted row numbers, written to the shared folder; gives block and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, marks = None, np.zeros(1 << bits, bool)

        def put() -> pa.RecordBatch:
            filesystem, path = store(folder)
            filesystem.create_dir(path, recursive=True)
            path = f"{path}/{uuid.uuid4().hex}"
            with filesystem.open_output_stream(path, compression=None) as file:
                file.write(np.packbits(marks).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([path])], ["block", "path"])

        for batch in batches:
            rows = np.asarray(batch.column(0))
            for k in np.unique(rows >> bits).tolist():
                if k != block:
                    if block is not None:
                        yield put()
                    block = k
                    marks[:] = False
                marks[rows[rows >> bits == k] & ((1 << bits) - 1)] = True
        if block is not None:
            yield put()

    return run


@functools.lru_cache(4)
def _marks(folder: str, path: str) -> np.ndarray:
    """A block's bits from the shared folder; a worker holds a few, as a task reads neighbouring rows."""
    with store(folder)[0].open_input_stream(path, compression=None) as file:
        return np.unpackbits(np.frombuffer(file.read(), np.uint8)).view(bool)


def _staying(folder: str, paths, bits: int) -> Callable:
    @F.arrow_udf("boolean")
    def stays(rows: pa.Array) -> pa.Array:
        own = np.asarray(rows)
        out = np.zeros(len(own), bool)
        for k in np.unique(own >> bits).tolist():
            if k in paths.value:  # of other blocks no row stays
                here = own >> bits == k
                out[here] = _marks(folder, paths.value[k])[own[here] & ((1 << bits) - 1)]
        return pa.array(out)

    return stays


def hot_join(left: DataFrame, right: DataFrame, key: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique and whose ``weight`` says how many rows of ``left`` have it.

    Keys with over one in ``HOT`` of all rows, at most ``HOT`` of them, are
    joined by a broadcast of their rows, all others by an ordinary join, so that
    no task holds a hot key. Both tables are read twice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > total / HOT)
    names = hot.select(*key)
    warm = left.join(F.broadcast(hot), key)
    cold = left.join(F.broadcast(names), key, "left_anti").join(right.where(F.col(weight) <= total / HOT), key, how)
    return cold.unionByName(warm.select(*cold.columns))


def tidied(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after whose last batch the worker gives back the memory it no longer uses.

    Workers wait for the next task and the next stage, and several of them share an executor.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
        if trim:
            trim(0)

    return inner


class RowNumbers:
    """Numbers that are unique in the job and the same when a task is run again.

    Used inside ``mapInArrow``: partition number in the high bits, place in the
    partition in the low ones. A table's split fixes both.
    """

    def __init__(self) -> None:
        context = TaskContext.get()
        self.partition = context.partitionId() if context else 0
        self.next = 0

    def take(self, n: int) -> range:
        first = (self.partition << PLACE_BITS) + self.next
        self.next += n
        return range(first, first + n)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.fill_null("").view(kind).to_pylist()


def texts(column: pa.Array) -> list[str]:
    """A string column as ``str``; null is empty."""
    return column.fill_null("").to_pylist()


def chunks(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` rows."""
    part: list = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def columns_batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as one Arrow batch."""
    by_column = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(v), type=t) for v, t in zip(by_column, types, strict=True)], names=names)


def lower_ascii(column):
    """Lower-case A-Z and nothing else, as a SQL expression."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
