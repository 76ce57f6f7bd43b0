"""Rows in the order of a key, named by their place in it, with equal neighbours found by comparing them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE_BITS, kept


def packed(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """A stored table and its path, in as little space as is cheap, as many of them lie side by side."""
    return kept(df, tag, "zstd")


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it."""
    n = len(column)
    return pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)


def _named(key: list[str], keep: list[str], every: bool) -> Callable:
    """Sorted rows in; out go their other columns, ``name``, ``shared``, ``leads``, and the key at both ends of the range.

    Rows that share their key with none go only if ``every`` row is wanted, or at an end of the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << PLACE_BITS
        held, again, begun = None, False, False  # the last row seen, and whether it equals the one before it

        def made(batch: pa.RecordBatch, names: np.ndarray, same: np.ndarray, shared: np.ndarray, last: bool) -> pa.RecordBatch:
            nonlocal begun
            n = batch.num_rows
            leads, first = pa.array(~same), pa.array(np.arange(n), mask=same)
            ends: list = [None] * n
            for k in ([] if begun else [0]) + ([n - 1] if last else []):
                ends[k] = pickle.dumps([batch.column(x)[k].as_py() for x in key])
            begun = True
            rest = [x for x in batch.schema.names if x not in key]
            own = [batch.column(x) for x in rest] + [batch.column(x).take(first) for x in keep]
            out = pa.RecordBatch.from_arrays([*own, pa.array(names), pa.array(shared), leads, pa.array(ends, pa.binary())], [*rest, *keep, "name", "shared", "leads", "ends"])
            if every:
                return out
            wanted = shared.copy()
            wanted[[0, -1]] |= [ends[0] is not None, ends[-1] is not None]
            return out.filter(pa.array(wanted))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            same = np.ones(n, bool)
            same[0] = again
            for x in key:
                same[1:] &= ~_differs(batch.column(x))
            steps = ~same
            steps[0] = False
            names = number + np.cumsum(steps)
            if n > 1:
                yield made(batch.slice(0, n - 1), names[:-1], same[:-1], same[:-1] | same[1:], False)
            held, again, number = batch.slice(n - 1), bool(same[-1]), int(names[-1])
        if held is not None:
            yield made(held, np.array([number]), np.array([again]), np.array([again]), True)

    return run


def ranked(rows: DataFrame, key: list[str], salt: list[str], tag: str, keep: list[str] | None = None, every: bool = False) -> tuple[DataFrame, str]:
    """``rows``, a stored table, without ``key`` and with ``name``, ``shared`` and ``leads``; and the path it is written to.

    Names are as many numbers as there are keys, in the order of the keys.
    ``shared`` holds for rows whose key another row has too, ``leads`` for the
    first row of each key; that one keeps the columns ``keep`` of its key.
    Only rows with a shared key come back, unless ``every`` row is wanted.

    Rows are sorted in ranges. A range ends within equal keys where these are
    many, as ``salt``, columns that tell rows apart, is part of the order; so a
    hot key takes as many tasks as it needs. The keys at the ends of the ranges,
    two for each, are compared on the driver.
    """
    spark, keep = rows.sparkSession, keep or []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{x}` {kind[x]}" for x in kind if x not in key] + [f"`{x}` {kind[x]}" for x in keep] + ["name long", "shared boolean", "leads boolean", "ends binary"])
    ordered = rows.repartitionByRange(parts, *key, *salt).sortWithinPartitions(*key)
    made, path = packed(ordered.mapInArrow(_named(key, keep, every), schema), tag)
    ends: dict[int, dict[int, list]] = {}
    for r in made.where("ends is not null").select("name", "ends").collect():  # two a range
        ends.setdefault(r["name"] >> PLACE_BITS, {})[r["name"]] = pickle.loads(r["ends"])
    same, before, own = {}, None, None
    for part in sorted(ends):
        first, last = min(ends[part]), max(ends[part])
        if ends[part][first] == before:
            same[first] = same[own] = own
        before, own = ends[part][last], same.get(last, last)
    made = made.drop("ends")
    if same:
        fixes = F.broadcast(spark.createDataFrame([(a, b) for a, b in same.items()], "name long, whole long"))  # at most one a range
        other = [F.col(x) for x in made.columns if x not in ("name", "shared", "leads", *keep)]
        leads = F.col("leads") & (F.col("whole").isNull() | (F.col("whole") == F.col("name")))
        made = made.join(fixes, "name", "left").select(
            *other, *(F.when(leads, F.col(x)).alias(x) for x in keep), F.coalesce("whole", "name").alias("name"), (F.col("shared") | F.col("whole").isNotNull()).alias("shared"), leads.alias("leads")
        )
    return made if every else made.where("shared"), path
