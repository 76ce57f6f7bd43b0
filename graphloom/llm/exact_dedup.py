"""Exact duplicates by content sort.

Normalised texts are sorted over the whole corpus: sampled splitters cut the
order into ranges, each range is sorted externally by Spark (which spills), and
a pass over neighbours compares whole texts. The order is (first bytes, hash of
the whole text, text, id), so texts that share a long beginning still spread,
and the copies of a hot text spread by id over as many ranges as they need.
A run of equal texts that crosses the border of a range, or that is too long to
be held by a task, is put together from its parts.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, only, stored, tidied, with_rows

#: Bytes of a text that a splitter holds; the hash behind them orders the rest.
LEAD = 48
#: Splitters are taken from a random sample of about so many rows for each range, whatever the ids are.
SAMPLED = 64
SEED = 7
#: Copies of one text held by a task before their rows go out under one run number.
RUN_ROWS = 50_000


def _sign(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _normalised(column: pa.Array) -> pa.Array:
    return pc.ascii_lower(column.fill_null("")).cast(pa.binary())


def _keys(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    norm = _normalised(column)
    hashes = [_sign(xxhash.xxh3_64_intdigest(x)) for x in norm.to_pylist()]
    return norm, pc.binary_slice(norm, 0, LEAD), pa.array(hashes, pa.int64())


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, lead, h = _keys(batch.column(1))
        yield pa.RecordBatch.from_arrays([lead, h, batch.column(0)], ["lead", "h", "id"])


def _dealt(splitters) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, cuts = RowNumbers(), splitters.value
        for batch in batches:
            norm, lead, h = _keys(batch.column(1))
            ids = batch.column(0).to_pylist()
            to = [bisect.bisect_right(cuts, (a, b, _last(i))) for a, b, i in zip(lead.to_pylist(), h.to_pylist(), ids, strict=True)]
            rows = batch.column(2) if batch.num_columns > 2 else pa.array(numbers.take(len(ids)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), norm, h, pa.array(to, pa.int32())], ["row", "id", "norm", "h", "to"])

    return run


def _last(i: int | None) -> int:
    return -(1 << 63) if i is None else i


RUNS = "row long, id long, text_sha256 string, part int, run long, keep_id long, keep_row long, size long, edge boolean"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours; a run's rows get its largest id and its size.

    Runs at a border of the range, and the parts of a run so long that its rows
    go out before its end, are marked ``edge``; ``merged`` puts those together.
    """
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["row", "id", "text_sha256", "part", "run", "keep_id", "keep_row", "size", "edge"]
    run, first, key, text, sha, cut = 0, None, None, None, "", False
    rows: list[tuple] = []  # of the run
    held: list[tuple] = []  # runs with the same key, which may be the last one
    out: list[tuple] = []

    def close(whole: bool) -> None:
        nonlocal run, rows, cut
        run += 1
        known, low, row = max((i is not None, _last(i), -row) for row, i in rows)
        held.append((rows, sha, run, low if known else None, -row, cut or not whole))
        rows, cut = [], not whole

    def settle(last: bool) -> None:
        for own, digest, k, keep, keep_row, split in held:
            edge = split or last or key == first
            out.extend((row, i, digest, part, k, keep, keep_row, len(own), edge) for row, i in own)
        held.clear()

    def batch_of() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, kinds, strict=True)], names)
        out.clear()
        return made

    for batch in batches:
        for row, i, norm, h in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if norm != text:
                if rows:
                    close(True)
                cut = False
                if (own := (h, norm[:LEAD])) != key:
                    settle(False)
                    key = own
                    first = first or own
                text, sha = norm, hashlib.sha256(norm).hexdigest()
            rows.append((row, i))
            if len(rows) >= RUN_ROWS:
                close(False)
                settle(False)
        if out:
            yield batch_of()
    if rows:
        close(True)
    settle(True)
    if out:
        yield batch_of()


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Groups of equal texts: ``row, id, keep_id, group_size, kept, text_sha256`` for every input row.

    Texts are equal if they are once A-Z is lower-cased; null is empty. The row
    with the largest id stays. Among repeated ids, the one read first stays.
    Null ids lose against others; a group of null ids keeps the row read first.
    Other columns are not read; an empty table gives no rows. ``row`` names a
    column of numbers that tell the rows apart; without it they are numbered as
    they are read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), *([F.col(row).alias("row")] if row else []))
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(1.0, SAMPLED * ranges / max(1, own.count()))
    sampled = own.select("id", "text").sample(share, SEED).mapInArrow(tidied(_sampled), "lead binary, h long, id long").toArrow()
    keys = sorted((lead, h, _last(i)) for lead, h, i in zip(*(sampled.column(k).to_pylist() for k in range(3)), strict=True))
    splitters = spark.sparkContext.broadcast([keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else [])
    dealt = own.mapInArrow(tidied(_dealt(splitters)), "row long, id long, norm binary, h long, to int").repartitionById(ranges, F.col("to"))
    ordered = dealt.sortWithinPartitions(F.substring("norm", 1, LEAD), "h", "norm", F.col("id").asc_nulls_first()).select("row", "id", "norm", "h")
    return merged(stored(ordered.mapInArrow(tidied(_neighbours), RUNS), "runs"))


def merged(runs: DataFrame) -> DataFrame:
    """Whole groups out of runs whose parts lie in several ranges.

    Rows find their text's whole by their own part, which has ``RUN_ROWS`` rows
    at most, so that the copies of a hot text never meet in one task.
    """
    best = F.max(F.struct(F.col("keep_id").alias("id"), (-F.col("keep_row")).alias("row")))
    parts = runs.where("edge").groupBy("text_sha256", "part", "run").agg(best.alias("best"), F.first("size").alias("size"))
    texts = parts.groupBy("text_sha256").agg(F.max("best").alias("best"), F.sum("size").alias("edge_size"))
    edges = parts.select("text_sha256", "part", "run").join(texts, "text_sha256").select("part", "run", "best", "edge_size")
    whole = runs.join(edges, ["part", "run"], "left")
    at_edge = F.col("best").isNotNull()
    return whole.select(
        "row",
        "id",
        F.when(at_edge, F.col("best.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(at_edge, F.col("edge_size")).otherwise(F.col("size")).alias("group_size"),
        (F.col("row") == F.when(at_edge, -F.col("best.row")).otherwise(F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of equal texts, with all its columns; which one, ``exact_groups`` says."""
    own, row = with_rows(docs)
    stays = exact_groups(own, id_column, text, row).where("kept")
    return only(own, row, stays.select("row")).select(*docs.columns)
