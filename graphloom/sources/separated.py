"""Separated text files of any size, read by ranges with the rules of Python's ``csv.DictReader``.

Lines come from Spark's reader, a range of the file at a time. Whether a line
starts within a quoted cell depends on all lines before it, but each line only
maps one of two states to one of two, and such maps can be put together: a first
pass gives the map of each range, the driver runs through one map a range, and a
second pass parses all ranges at once. A record that a range's end cuts is put
together from its pieces. So one file is read by many tasks, and quoted line
breaks hold.

Any of ``\\n``, ``\\r\\n`` and ``\\r`` ends a line and is ``\\n`` within a cell. Blank
lines are no records. Short records have nulls, long ones keep the rest apart. A
cell that is open at the end of the file ends there, before a last line break. The
file is UTF-8, with or without a mark for it.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: The rest of a quoted cell, from behind its opening quote to its closing one.
REST = re.compile(r'(?:[^"]++|"")*+"')


def quoted_after(line: str, quoted: bool, separator: str) -> bool:
    """Whether a quoted cell is open behind a line, given whether one is before it."""
    at = 0
    while True:
        if not quoted:
            while not line.startswith('"', at):  # a quote opens a cell only where the cell starts
                at = line.find(separator, at) + 1
                if not at:
                    return False
            at += 1
        closed = REST.match(line, at)
        if not closed:
            return True
        at = line.find(separator, closed.end()) + 1  # what follows the quote belongs to the cell
        if not at:
            return False
        quoted = False


def _maps(separator: str) -> Callable:
    """For each range, whether a cell is open behind it if none, and if one, is open before it; and whether that one ends in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, closed, open_, ends = None, False, True, False
        for batch in batches:
            rows: list[tuple] = []
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    if now is not None:
                        rows.append((now, closed, open_, ends))
                    now, closed, open_, ends = at, False, True, False
                if '"' in line:
                    closed, open_ = quoted_after(line, closed, separator), quoted_after(line, open_, separator)
                    ends = ends or not open_
            if rows:
                yield _batch(MAP.names, rows, MAP)
        if now is not None:
            yield _batch(MAP.names, [(now, closed, open_, ends)], MAP)

    return run


MAP = pa.schema([("range", pa.string()), ("closed", pa.bool_()), ("open", pa.bool_()), ("ends", pa.bool_())])


def _batch(names: list[str], rows: list[tuple], schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)


def _cells(lines: list[str], separator: str) -> Iterator[list[str]]:
    csv.field_size_limit(2**31 - 1)
    return csv.reader([*(line + "\n" for line in lines[:-1]), lines[-1]], delimiter=separator)


RECORD = pa.schema([("range", pa.string()), ("place", pa.int64()), ("cells", pa.list_(pa.string())), ("cut", pa.string()), ("text", pa.string())])


def _parsed(separator: str, before: dict[str, tuple[bool, str]]) -> Callable:
    """Records of each range: whole ones with ``place`` and ``cells``; pieces of cut ones with ``cut``, the range they start in.

    ``before`` has, for each range, whether a quoted cell is open there and in which range its record starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> Iterator[tuple]:
            """What is left at the end of a range: a record that goes on in the next one."""
            if lines:
                yield now, None, None, start, "\n".join(lines)

        now, quoted, start, place = None, False, None, 0
        lines: list[str] = []
        head = min(before, default=None)
        for batch in batches:
            rows: list[tuple] = []
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != now:
                    rows += closed()
                    now, place, lines = at, 0, []
                    quoted, start = before[at]
                lines.append(line)
                quoted = quoted_after(line, quoted, separator) if '"' in line else quoted
                if quoted:
                    continue
                if start != now:  # the end of a record that started before the range
                    rows.append((now, None, None, start, "\n".join(lines)))
                else:
                    for cells in _cells(lines, separator):
                        if cells or (at == head and place == 0):  # a blank first line is a header without names
                            rows.append((now, place, cells, None, None))
                            place += 1
                lines, start = [], now
            if rows:
                yield _batch(RECORD.names, rows, RECORD)
        rest = list(closed())
        if rest:
            yield _batch(RECORD.names, rest, RECORD)

    return run


def _joined(separator: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, c) for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in _cells(text.split("\n"), separator) if c]
            yield _batch(["range", "cells"], rows, pa.schema([RECORD.field("range"), RECORD.field("cells")]))

    return run


def records(spark: SparkSession, path: str, separator: str = ",") -> tuple[list[str], DataFrame]:
    """A file's header and ``_row, cells``, written once; ``_row`` counts records below the header from 0.

    A folder is read as the one file that its files are in the order of their names.
    """
    place = F.format_string("%s:%020d", "_metadata.file_path", "_metadata.file_block_start")
    lines = spark.read.text(path).select(place.alias("range"), "value")
    found = {r["range"]: r for r in lines.mapInArrow(_maps(separator), "range string, closed boolean, open boolean, ends boolean").collect()}  # one row a range
    before, open_, start = {}, False, None
    for at in sorted(found):
        before[at] = (open_, start if open_ else at)
        start = start if open_ and not found[at]["ends"] else at
        open_ = found[at]["open" if open_ else "closed"]
    kinds = "range string, place long, cells array<string>, cut string, text string"
    parsed = stored(lines.mapInArrow(_parsed(separator, before), kinds), "records")
    pieces = parsed.where("cut is not null").groupBy(F.col("cut").alias("range")).agg(F.array_sort(F.collect_list(F.struct(F.col("range").alias("piece"), "text"))).alias("own"))  # one record's, a range each
    whole = pieces.select("range", F.array_join(F.transform("own", lambda x: x["text"]), "\n").alias("text")).mapInArrow(_joined(separator), "range string, cells array<string>")
    sizes = {r["range"]: r["n"] for r in parsed.where("cut is null").groupBy("range").agg(F.count("*").alias("n")).collect()}
    cut = stored(whole, "cut")
    over = {r["range"] for r in cut.select("range").collect()}  # at most one a range
    # a cut record follows all others of the range it starts in
    total, firsts = 0, []
    for at in sorted(found):
        firsts.append((at, total, sizes.get(at, 0)))
        total += sizes.get(at, 0) + (at in over)
    offsets = F.broadcast(spark.createDataFrame(firsts, "range string, first long, n long"))  # one row a range
    both = parsed.where("cut is null").select("range", "place", "cells").unionByName(cut.select("range", F.lit(None).cast("long").alias("place"), "cells"))
    placed = both.join(offsets, "range").select((F.col("first") + F.coalesce("place", "n") - 1).alias("_row"), "cells")
    header = placed.where("_row = -1").first()
    return list(header["cells"]) if header else [], placed.where("_row >= 0")


class Records(Sequence):
    """A table file as a sequence of records, one mapping for each, that stays in Spark.

    ``frame`` has a text column for each name of the header and ``_row``. Going
    through the sequence brings one record after another to the driver; what a
    long record has beyond the header is under None there.
    """

    def __init__(self, spark: SparkSession, path: str, separator: str = ",") -> None:
        self.names, self.rows = records(spark, path, separator)
        place = {name: k for k, name in enumerate(self.names)}  # of repeated names the last counts
        self.frame = self.rows.select(*(F.get("cells", F.lit(k)).alias(name) for name, k in place.items()), "_row")

    def _record(self, row: Any) -> dict[str | None, Any]:
        cells, n = row["cells"], len(self.names)
        short = dict.fromkeys(self.names[len(cells) :]) if len(cells) < n else {}
        return dict(zip(self.names, cells, strict=False)) | short | ({None: cells[n:]} if len(cells) > n else {})

    def __iter__(self) -> Iterator[dict[str | None, Any]]:
        return map(self._record, self.rows.orderBy("_row").toLocalIterator())

    def __len__(self) -> int:
        return self.rows.count()

    def __getitem__(self, at: Any) -> Any:
        if isinstance(at, slice):
            return list(self)[at]
        row = self.rows.where(F.col("_row") == (at if at >= 0 else len(self) + at)).first()
        if row is None:
            raise IndexError(at)
        return self._record(row)

    def __eq__(self, other: Any) -> bool:
        return list(self) == list(other) if isinstance(other, Sequence) and not isinstance(other, str) else NotImplemented

    __hash__ = None
