"""JSON files of any size: the items of an array, read by ranges.

Spark's reader cuts the file at commas, a range of it at a time. Whether a range
starts within a string, how deep, and below which keys depends on all that is
before it, but each range only changes these, and its changes can be put together:
one pass finds quotes and depths of all ranges at once, a second the keys on the
way to the array, and the driver runs through one row a range after each. The
third pass cuts out the items; one that a range's end cuts is put together again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import Any
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

PATH = re.compile(r"[\w\-]*(\.[\w\-]+|\[(\d+|-\d+|\*|)\])*")
STEP = re.compile(r"([\w\-]+)|\[([^\]]*)\]")
COLON, COMMA = ord(":"), ord(",")


def steps(path: str | None) -> list[str | int | None]:
    """Steps of a path: keys, places, and None for all items."""
    if path in (None, "", "$"):
        return []
    if not PATH.fullmatch(path):
        raise ValueError(f"the path {path!r} has more than keys, [n] and [*]")
    return [key if key else None if index in ("*", "") else int(index) for key, index in STEP.findall(path)]


def walked(value: Any, way: list[str | int | None]) -> list[Any]:
    """Values at the end of a way. ``None`` goes to all items of a list; what isn't there is left out behind one."""
    found, many = [value], False
    for step in way:
        if step is None:
            many = True
            found = [y for x in found if isinstance(x, list) for y in x]
        elif isinstance(step, int):
            found = [x[step] if isinstance(x, list) and -len(x) <= step < len(x) else None for x in found]
        else:
            found = [x.get(step) if isinstance(x, dict) else None for x in found]
        found = [x for x in found if x is not None] if many else found
    if many:
        return found
    return [] if found[0] is None else list(found[0]) if isinstance(found[0], list) else found


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether it is a quote that is not escaped, and whether an odd number of these is up to it."""
    at = np.arange(len(data))
    solid = np.maximum.accumulate(np.where(data != 92, at, -1))  # the last byte that is no backslash
    before = np.concatenate(([0], (at - solid)[:-1]))  # backslashes right before a byte
    real = (data == 34) & (before % 2 == 0)
    return real, np.cumsum(real) % 2 == 1


def depths(data: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The change of depth at each byte, of brackets outside of strings."""
    opens, closes = ((data == 91) | (data == 123)) & plain, ((data == 93) | (data == 125)) & plain
    return opens.astype(np.int64) - closes


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """A range's place and its next bytes; a comma that the reader took stands at the end of each line again."""
    for batch in batches:
        starts = batch.column(0).to_numpy()
        lines = batch.column(1).cast(pa.large_binary()).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(starts)) + 1).tolist(), len(lines)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield int(starts[a]), b",".join(lines[a:b]) + b","


def whole_strings(batches: Iterator[pa.RecordBatch], quoted: Callable[[int], bool]) -> Iterator[tuple[int, bytes, bool]]:
    """As ``chunks``, with whether a string is open before; a string that a batch's end cuts is kept for the next one of its range."""
    now, held, open_ = None, b"", False
    for at, data in chunks(batches):
        if at != now:
            if held:
                yield now, held, open_
            now, held, open_ = at, b"", quoted(at)
        data = held + data
        real, odd = marks(np.frombuffer(data, np.uint8))
        held = b""
        if bool(odd[-1]) != open_:  # open behind it: hold the last string back
            last = np.flatnonzero(real)
            cut = int(last[-1]) if len(last) else 0
            data, held = data[:cut], data[cut:]
        if data:
            yield at, data, open_
            open_ = False if held else open_ != bool(odd[-1])
    if held:
        yield now, held, open_


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, whether it ends within a string if it starts outside, and its change of depth if it starts outside and within one."""
    rows: list[list] = []
    for at, data in chunks(batches):
        if not rows or rows[-1][0] != at:
            rows.append([at, False, 0, 0])
        row, own = rows[-1], np.frombuffer(data, np.uint8)
        real, odd = marks(own)
        odd = odd ^ row[1]
        row[2] += int(depths(own, ~odd & ~real).sum())
        row[3] += int(depths(own, odd & ~real).sum())
        row[1] = bool(odd[-1])
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["range", "quoted", "plain", "within"])


class Place:
    """Where a reader is: depth, the key at each depth on the way, and the bracket that opened the depth below the way."""

    def __init__(self, depth: int, keys: list, kind: Any) -> None:
        self.depth, self.keys, self.kind = depth, list(keys), kind

    def events(self, data: bytes, quoted: bool) -> Iterator[tuple[int, int]]:
        """Positions where an array or object at most as deep as the way's end begins or ends, or a key stands, with the depth behind it."""
        own, k = np.frombuffer(data, np.uint8), len(self.keys)
        real, odd = marks(own)
        plain = ~(odd ^ quoted) & ~real
        delta = depths(own, plain)
        self.after = self.depth + np.cumsum(delta)
        self.commas = np.flatnonzero((own == COMMA) & plain & (self.after == k + 1))
        quotes = np.flatnonzero(real)
        for p in np.flatnonzero(((delta == 1) & (self.after <= k + 1)) | ((delta == -1) & (self.after <= k)) | ((own == COLON) & plain & (self.after <= k))).tolist():
            d = int(self.after[p])
            if delta[p] == 1:
                if d == k + 1:
                    self.kind = data[p : p + 1].decode()
                self.keys[d - 1 :] = [None] * (k - d + 1)
            elif delta[p] == -1:
                self.keys[d:], self.kind = [None] * (k - d), None
            else:
                n = int(np.searchsorted(quotes, p))
                self.keys[d - 1] = json.loads(data[quotes[n - 2] : quotes[n - 1] + 1]) if n > 1 else CUT
                self.keys[d:], self.kind = [None] * (k - d), None
            yield p, d
        self.depth = int(self.after[-1])


#: A key that the start of its range cuts, and a part of a place that its range leaves as it is.
CUT, SAME = {"cut": True}, {"same": True}


def _keys(way: int, most: int, before: dict[int, tuple[bool, int]]) -> Callable:
    """What each range does to the keys on the way, as JSON; and the string that its start and its end cut, where these are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        place = None
        for at, data, quoted in whole_strings(batches, lambda r: before[r][0]):
            quotes = np.flatnonzero(marks(np.frombuffer(data, np.uint8))[0])
            if not rows or rows[-1][0] != at:
                place = Place(before[at][1], [SAME] * way, SAME)
                rows.append([at, None, data[: quotes[0]] if len(quotes) else data, b"", len(quotes) > 0])
            for _ in place.events(data, quoted):
                pass
            rows[-1][1] = json.dumps([place.keys, place.kind])
            rows[-1][3] = data[quotes[-1] :] if len(quotes) else data
            rows[-1][4] |= len(quotes) > 0
        cut = lambda text: text if len(text) <= most else None
        made = [[r[0] for r in rows], [r[1] for r in rows], [cut(r[2]) for r in rows], [cut(r[3]) for r in rows], [r[4] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_()], strict=True)], ["range", "does", "head", "tail", "some"])

    return run


PIECE = pa.schema([("range", pa.int64()), ("place", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("bound", pa.bool_()), ("more", pa.bool_())])


def _given(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([None if r[k] is None else r[k].decode() if k == 3 else r[k] for r in rows], f.type) for k, f in enumerate(PIECE)], PIECE.names)


def _items(way: list[str], before: dict[int, tuple[bool, int, list, Any]]) -> Callable:
    """Items of the array at the end of the way: whole ones with their place in the range, and the parts of cut ones.

    A range's last row has its number of whole items, whether an item begins or ends in it, and whether one goes on behind it.
    """
    k = len(way)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[bytes] = []
        now, place, number, bound, active = None, None, 0, False, False

        def ended() -> None:
            if active:
                rows.append((now, None, int(bound), b"".join(held), None, None))
            if now is not None:
                rows.append((now, number, None, None, bound, active))

        for at, data, quoted in whole_strings(batches, lambda r: before[r][0]):
            if at != now:
                ended()
                now, number, bound, place = at, 0, False, Place(*before[at][1:])
                held.clear()
                active = place.depth > k and place.keys == way and place.kind == "["
            begun, closed = set(), set()
            for p, d in place.events(data, quoted):
                if data[p] in OPENS and d == k + 1 and place.keys == way and place.kind == "[":
                    begun.add(p)
                elif data[p] in CLOSES and d == k:
                    closed.add(p)
            last = 0
            for p in sorted({*place.commas.tolist(), *begun, *closed}):
                if p in begun:
                    active = True
                elif not active:
                    continue
                else:
                    text = b"".join([*held, data[last:p]])
                    if not bound:
                        rows.append((now, None, 0, text, None, None))
                    elif text.strip():
                        rows.append((now, number, None, text, None, None))
                        number += 1
                    active = p not in closed
                held.clear()
                bound, last = True, p + 1
            if active:
                held.append(data[last:])
            yield from _given(rows)
            rows.clear()
        ended()
        yield from _given(rows)

    return run


OPENS, CLOSES = b"{[", b"}]"


def array_items(spark: SparkSession, path: str, way: list[str]) -> DataFrame | None:
    """``_i, text``: the items of the array that the keys lead to, as they stand in the file; None if there is no array.

    If an object has a key twice, the items of both are given. A folder is read as
    the one file that its files are in the order of their names, if each but the last
    ends behind an item's comma.
    """
    read = spark.read.text(path, lineSep=",")
    names = sorted({unquote(f.rsplit("/", 1)[-1]) for f in read.inputFiles()})
    order = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k long, name string"))  # one row a file
    lines = read.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), "value")
    lines = lines.join(order, "name").select((F.shiftleft("k", 42) + F.col("start")).alias("range"), "value")
    shapes = sorted(lines.mapInArrow(_shapes, "range long, quoted boolean, plain long, within long").collect(), key=lambda r: r["range"])  # one row a range
    at, quoted, depth = {}, False, 0
    for r in shapes:
        at[r["range"]] = (quoted, depth)
        depth += r["within"] if quoted else r["plain"]
        quoted = r["quoted"] != quoted
    most = 16 + 6 * max(map(len, way), default=0)
    done = sorted(lines.mapInArrow(_keys(len(way), most, at), "range long, does string, head binary, tail binary, some boolean").collect(), key=lambda r: r["range"])
    before, keys, kind, text = {}, [None] * len(way), None, b""
    for k, r in enumerate(done):
        before[r["range"]] = (*at[r["range"]], list(keys), kind)
        own, its_kind = json.loads(r["does"])
        whole = None if text is None or r["head"] is None else text + bytes(r["head"]) + b'"'
        for d, key in enumerate(own):
            if key != SAME:
                keys[d] = key if key != CUT else None if whole is None else json.loads(whole)
        kind = kind if its_kind == SAME else its_kind
        open_ = k + 1 < len(done) and at[done[k + 1]["range"]][0]
        tail = None if r["tail"] is None else bytes(r["tail"])
        text = b"" if not open_ else tail if r["some"] or None in (text, tail) else text + tail
    kinds = "range long, place long, part long, text string, bound boolean, more boolean"
    found = stored(lines.mapInArrow(_items(way, before), kinds), "items")
    told = {r["range"]: r for r in found.where("bound is not null").select("range", "place", "bound", "more").collect()}
    total, group, places = 0, None, []
    for r in sorted(told):
        one = told[r]
        own = r if one["bound"] and one["more"] else None
        places.append((r, total, one["place"], group))
        total += one["place"] + (own is not None)
        group = (own if one["bound"] else group) if one["more"] else None
    if not any(r["bound"] for r in told.values()):
        return None
    offsets = F.broadcast(spark.createDataFrame(places, "range long, first long, n long, open long"))  # one row a range
    parts = found.where("bound is null").join(offsets, "range")
    cut = parts.where("part is not null").withColumn("start", F.when(F.col("part") == 1, F.col("range")).otherwise(F.col("open")))
    joined = cut.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("range", "text"))).alias("own")).where("start is not null")  # one item's, a range each
    whole = joined.join(offsets.select(F.col("range").alias("start"), "first", "n"), "start").select((F.col("first") + F.col("n")).alias("_i"), F.array_join(F.transform("own", lambda x: x["text"]), "").alias("text"))
    return parts.where("place is not null").select((F.col("first") + F.col("place")).alias("_i"), "text").unionByName(whole)


def _walked(way: list[str | int | None], every: bool) -> Callable:
    """Values at the end of a way from each item; ``every`` if the items are all of their array's, and not one that the path names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, j, json.dumps(v, ensure_ascii=False)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for j, v in enumerate(walked([json.loads(text)], [None, *way]) if every else walked(json.loads(text), way))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string()])], ["_i", "_j", "item"])

    return run


class JsonFile:
    """A JSON file that stays where it is. ``rows`` selects from it in Spark; all else reads the value on the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @cached_property
    def value(self) -> Any:
        return json.loads(self.spark.read.text(self.path, wholetext=True).first()["value"])

    def rows(self, select: str | None = None) -> DataFrame | None:
        """``_i, _j, item``: the values at a path, as JSON and in order, of the array that its first keys lead to; None if there is none."""
        way = steps(select)
        first = next((k for k, step in enumerate(way) if not isinstance(step, str)), len(way))
        items = array_items(self.spark, self.path, way[:first])
        if items is None:
            return None
        place = way[first] if first < len(way) else None
        if place is not None:
            items = items.where(F.col("_i") == (place if place >= 0 else place + items.count()))
        return items.mapInArrow(_walked(way[first + 1 :], place is None), "_i long, _j long, item string")

    def __eq__(self, other: Any) -> bool:
        return self.value == (other.value if isinstance(other, JsonFile) else other)

    __hash__ = None

    def __getitem__(self, key: Any) -> Any:
        return self.value[key]

    def __iter__(self) -> Iterator[Any]:
        return iter(self.value)

    def __len__(self) -> int:
        return len(self.value)
