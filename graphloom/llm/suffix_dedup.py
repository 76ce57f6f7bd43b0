"""Repeated byte strings by a distributed difference-cover algorithm.

What cannot repeat is left out first. Every window of ``WINDOW`` bytes has an
anchor, the first of its smallest shorter grams, and equal windows have it in
the same place; so a window whose anchor has a hash that is nowhere else is
unique. The windows of one anchor lie side by side and span a stretch.

Whole copies come next. Stretches around the same anchor are sorted by their
bytes and compared with their neighbours; the windows of equal ones repeat each
other, and one of them goes on for all. Only anchors with several kinds of
stretches go on, and of these stretches the parts of ``PART`` windows whose
common middle is somewhere else too (by a hash, which lets through at most more);
equal parts are found like equal stretches.

The windows that are left are decided by the difference cover. Positions 1 and 2
modulo 3 are the sample. Triples of words at sampled positions are sorted and
named by their order; then triples of names are, and so on until the names
stand for all of a window that no shift leaves out, or none is shared. A
position with a name that no other shares drops out at each level, as nothing
that holds it repeats. The remaining positions are merged in by the bytes that
lead to the next sampled one: any two positions are both sampled after 0, 1 or 2
bytes, so sorted by shift, leading bytes, trailing bytes and name, equal windows
are neighbours, which are compared.

All sorts are over ranges of the key (``ordering.ranked``); every comparison is of
whole keys.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, chunks, columns_batch, dropped, stored, utf8
from .ordering import packed, ranked

WINDOW, GRAM = 200, 100
#: Bytes of a triple of words.
TRIPLE = 66
PART = 8
#: Bytes of a text whose anchors are found together; the arrays for it take about 64 times as much.
BLOCK = 1 << 20
#: Bytes of texts that are gone through together, so that the arrays stay in the processor's cache.
GROUP = 1 << 16
PLACE = np.uint64((1 << 31) - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of each ``width`` neighbours, in time that does not depend on the width."""
    n = len(values)
    fill = values[-1:].repeat(-n % width)
    blocks = np.concatenate((values, fill)).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from the first on, for a block of texts."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(BLOCK + WINDOW, x, np.uint64)) for x in (BASE, INVERSE))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each anchor the number of its text, its place there, its hash, and the first and last window that have it.

    The texts of a call have at most ``BLOCK + WINDOW`` bytes together; they are
    gone through as one array, and windows that reach into the next text are left out.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(sizes.sum())
    if n < WINDOW:
        none = np.array([], np.int64)
        return none, none, none, none, none
    power, inverse = _powers()
    with np.errstate(over="ignore"):
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * power[:n])))
        # bytes of a gram times the base to the power of their places, brought to the power of its first place
        gram = (total[GRAM:] - total[: n - GRAM + 1]) * inverse[: n - GRAM + 1]
        gram ^= gram >> np.uint64(29)
        gram *= MIX
        gram ^= gram >> np.uint64(32)
    # the upper bits decide, then the place: the first of the smallest
    order = gram & ~PLACE | np.arange(len(gram), dtype=np.uint64)
    at = (_sliding(order, WINDOW - GRAM + 1, np.minimum) & PLACE).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    window = np.flatnonzero(np.arange(WINDOW, n + 1) <= ends[owner])
    owner, at = owner[window], at[window]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))) if len(window) else window
    last = np.concatenate((first[1:], [len(window)]))[: len(first)] - 1
    base = (ends - sizes)[owner[first]]
    return owner[first], at[first] - base, gram[at[first]].view(np.int64), window[first] - base, window[last] - base


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, places and texts, up to ``GROUP`` bytes at a time; a longer text comes in pieces that share all but a window."""
    rows, places, texts, size = [], [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for base in range(0, len(text) - WINDOW + 1, BLOCK):
                piece = text[base : base + BLOCK + WINDOW - 1] if base or len(text) > BLOCK else text
                if texts and size + len(piece) > GROUP:
                    yield rows, places, texts
                    rows, places, texts, size = [], [], [], 0
                rows.append(row)
                places.append(base)
                texts.append(piece)
                size += len(piece)
    if texts:
        yield rows, places, texts


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor the first window of its stretch, how far the anchor is behind it, how many more windows there are, and its hash."""
    for rows, places, texts in _blocks(batches):
        owner, at, h, first, last = anchors(texts)
        row, base = np.array(rows, np.int64)[owner], np.array(places, np.int64)[owner]
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(first + base), pa.array((at - first).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(h)], ["row", "first", "off", "more", "h"])


def _numbered_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = RowNumbers()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(numbers.take(batch.num_rows), pa.int64()), batch.column(0), pa.array(utf8(batch.column(1)), pa.binary())], ["row", "id", "text"])


#: A stretch's key: its anchor's name, how far the anchor is behind the first window, how many more windows there are, its bytes.
HEAD = struct.Struct(">qBB")


def lists(column: pa.ListArray, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row the fields of a list of structs, as arrays; nothing for null."""
    values, offsets = column.values, column.offsets.to_numpy()
    fields = [values.field(n).to_numpy() for n in names]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield tuple(f[a:b] for f in fields)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of stretches, from their texts; a place holds the first window and the number of others."""
    for batch in batches:
        for row, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists(batch.column(2), "first", "anchor", "off", "more"), strict=True):
            for k in range(0, len(found[0]), 10_000):
                first, anchor, off, more = (f[k : k + 10_000] for f in found)
                keys = [HEAD.pack(n, o, m) + text[f : f + m + WINDOW] for f, n, o, m in zip(first.tolist(), anchor.tolist(), off.tolist(), more.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row, np.int64)), pa.array(first << 8 | more), pa.array(keys, pa.binary())], ["row", "place", "key"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a stretch by their distance from the anchor, ``PART`` at a time, with a hash of what all of the part's windows hold."""
    for batch in batches:
        for some in chunks(zip(*(batch.column(n).to_pylist() for n in ("row", "place", "key")), strict=True), 1_000):
            rows = []
            for row, place, key in some:
                _, far, more = HEAD.unpack_from(key)
                data, near = key[HEAD.size :], far - more
                for part in range(near // PART, far // PART + 1):
                    middle = data[far - part * PART : far - (part * PART + PART - 1) + WINDOW]
                    a, b = far - min(far, part * PART + PART - 1), far - max(near, part * PART)
                    mark = hashlib.blake2b(key[:8] + bytes([part]) + middle, digest_size=8)
                    rows.append((row, place, a, b, int.from_bytes(mark.digest(), "big", signed=True)))
            yield columns_batch(["row", "place", "a", "b", "middle"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()], rows)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of parts, behind their distances from the anchor."""
    for batch in batches:
        for some in chunks(zip(*(batch.column(n).to_pylist() for n in ("row", "place", "key")), lists(batch.column("parts"), "a", "b", "middle"), strict=True), 1_000):
            rows = []
            for row, place, key, parts in some:
                for a, b, middle in zip(*(p.tolist() for p in parts), strict=True):
                    rows.append((row, place, a, b, middle, bytes([key[8] - a, key[8] - b]) + key[HEAD.size + a : HEAD.size + b + WINDOW]))
            yield columns_batch(["row", "place", "a", "b", "middle", "piece"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], rows)


def _open(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Stretches with windows to be sorted: row, place, first window, bytes, the windows' places in them."""
    for row, place, key, (a, b) in zip(*(batch.column(n).to_pylist() for n in ("row", "place", "key")), lists(batch.column("parts"), "a", "b"), strict=True):
        starts = [np.arange(x, y + 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield row, place, place >> 8, np.frombuffer(key, np.uint8)[HEAD.size :], np.concatenate(starts)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triples of words that a window holds from each sampled position on; positions count in the text."""
    steps = range(0, WINDOW - 2 - TRIPLE + 1, TRIPLE)
    for batch in batches:
        for some in chunks(_open(batch), 500):
            places, words = [], []
            for _, _, first, data, starts in some:
                pos = np.unique(np.concatenate((starts, starts + 1, starts + 2))) + first
                pos = pos[pos % 3 > 0]
                raw = data.tobytes()
                words += [raw[p + k : p + k + TRIPLE] for p in (pos - first).tolist() for k in steps]
                places.append(pos.repeat(len(steps)))
            sizes = [len(p) for p in places]
            row, place = (pa.array(np.array([x[k] for x in some], np.int64).repeat(sizes)) for k in range(2))
            k = np.tile(np.arange(len(steps), dtype=np.int32), len(words) // len(steps))
            yield pa.RecordBatch.from_arrays([row, place, pa.array(np.concatenate(places)), pa.array(k), pa.array(words, pa.binary())], ["row", "place", "pos", "k", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window with the name it leads to and the bytes at its ends, once for each shift; windows that lead to no shared name are left out."""
    for batch in batches:
        for some in chunks(zip(_open(batch), lists(batch.column("ranks"), "pos", "name"), strict=True), 500):
            row, sizes, found = [], [], []
            for (own_row, _, base, data, starts), (pos, name) in some:
                order = np.argsort(pos)
                pos, name = pos[order], name[order]
                to = starts + base + np.arange(3)[:, None]
                at = np.minimum(np.searchsorted(pos, to), len(pos) - 1)
                shift, k = np.nonzero(pos[at] == to)  # sampled, with a shared name
                own = starts[k]
                # of the two bytes that a name does not cover, ``shift`` are before it
                b0, b1 = data[own + np.where(shift > 0, 0, WINDOW - 2)], data[own + np.where(shift > 1, 1, WINDOW - 1)]
                row.append(own_row)
                sizes.append(len(own))
                found.append((shift.astype(np.int32), own + base, b0.astype(np.int32), b1.astype(np.int32), name[at[shift, k]]))
            whole = [np.array(row, np.int64).repeat(sizes), *map(np.concatenate, zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in whole], ["row", "shift", "start", "b0", "b1", "rank"])


def sorted_windows(stretches: DataFrame) -> DataFrame:
    """``row, first, last`` for windows that are another's equal, one by one; ``stretches`` has ``row, place, key, parts``.

    Names of triples are sorted again, in triples, until one name stands for
    all of ``WINDOW`` but the two bytes that a shift leaves at its ends.
    """
    spark = stretches.sparkSession
    names, path = packed(stretches.mapInArrow(_sampled, "row long, place long, pos long, k int, words binary"), "sample")
    key, left = ["words"], (WINDOW - 2) // TRIPLE
    while True:
        made, made_path = ranked(names, key, ["row", "pos"], "names")
        dropped(spark, path)
        if left == 1:
            break
        # a triple of names for each position, where all three are shared
        key = ["n0", "n1", "n2"]
        triple = [F.max(F.when(F.col("k") % 3 == j, F.col("name"))).alias(n) for j, n in enumerate(key)]
        names, path = packed(made.groupBy("row", "place", "pos", F.floor(F.col("k") / 3).cast("int").alias("k")).agg(*triple, F.count("*").alias("n")).where("n = 3").drop("n"), "triples")
        dropped(spark, made_path)
        left //= 3
    ranks = made.groupBy("row", "place").agg(F.collect_list(F.struct("pos", "name")).alias("ranks"))
    merged, path = packed(stretches.join(ranks, ["row", "place"]).select("row", "place", "key", "parts", "ranks").mapInArrow(_windows, "row long, shift int, start long, b0 int, b1 int, rank long"), "merged")
    dropped(spark, made_path)
    equal, equal_path = ranked(merged, ["shift", "rank", "b0", "b1"], ["row", "start"], "equal")
    dropped(spark, path)
    found = stored(equal.select("row", F.col("start").alias("first"), F.col("start").alias("last")).distinct(), "windows")
    dropped(spark, equal_path)
    return found


def repeated(docs: DataFrame) -> DataFrame:
    """``row, first, last``: ranges of windows that start anywhere else too; ``docs`` has ``row`` and binary ``text``."""
    spark = docs.sparkSession
    first = F.shiftright("place", 8)
    found, old = packed(docs.select("row", "text").mapInArrow(_anchored, "row long, first long, off int, more int, h long"), "anchors")
    shared, path = ranked(found, ["h"], ["row", "first"], "shared")
    dropped(spark, old)
    by_text = shared.groupBy("row").agg(F.collect_list(F.struct("first", F.col("name").alias("anchor"), "off", "more")).alias("found"))
    stretches, old = packed(docs.join(by_text, "row").select("row", "text", "found").mapInArrow(_stretches, "row long, place long, key binary"), "stretches")
    dropped(spark, path)
    # copies: equal stretches around one anchor; one of each kind goes on where an anchor has several
    kinds, kinds_path = ranked(stretches, ["key"], ["row", "place"], "kinds", ["key"], every=True)
    dropped(spark, old)
    copies = stored(kinds.where("shared").select("row", first.alias("first"), (first + F.col("place").bitwiseAND(255)).alias("last")), "copies")
    one = kinds.where("leads").select("row", "place", "key", F.substring("key", 1, 8).alias("anchor"))
    unlike, unlike_path = ranked(one, ["anchor"], ["row", "place"], "unlike")
    dropped(spark, kinds_path)
    # parts of these whose middle is somewhere else too
    parts, old = packed(unlike.mapInArrow(_parts, "row long, place long, a int, b int, middle long"), "parts")
    middles, path = ranked(parts, ["middle"], ["row", "place", "a"], "middles")
    dropped(spark, old)
    open_parts = middles.groupBy("row", "place").agg(F.collect_list(F.struct("a", "b", F.col("name").alias("middle"))).alias("parts"))
    opened, opened_path = packed(unlike.join(open_parts, ["row", "place"]).select("row", "place", "key", "parts"), "opened")
    for done in (unlike_path, path):
        dropped(spark, done)
    # equal parts again are copies, and one of each goes on where a middle has several
    pieces, old = packed(opened.mapInArrow(_pieces, "row long, place long, a int, b int, middle long, piece binary"), "pieces")
    alike, path = ranked(pieces, ["middle", "piece"], ["row", "place", "a"], "alike", ["middle"], every=True)
    dropped(spark, old)
    equal = stored(alike.where("shared").select("row", (first + F.col("a")).alias("first"), (first + F.col("b")).alias("last")), "equal")
    left, left_path = ranked(alike.where("leads").select("row", "place", "a", "b", "middle"), ["middle"], ["row", "place", "a"], "left")
    dropped(spark, path)
    last_parts = left.groupBy("row", "place").agg(F.collect_list(F.struct("a", "b")).alias("parts"))
    last, path = packed(opened.drop("parts").join(last_parts, ["row", "place"]), "last")
    for done in (opened_path, left_path):
        dropped(spark, done)
    windows = sorted_windows(last)
    dropped(spark, path)
    return copies.unionByName(equal).unionByName(windows)


def _runs(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Bytes covered by ranges of windows, as disjoint runs in order."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    start, stop = first[order], np.maximum.accumulate(last[order] + WINDOW)
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return list(zip(start[new].tolist(), stop[np.concatenate((new[1:], [True]))].tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    for batch in batches:
        rows = []
        for i, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists(batch.column(2), "first", "last"), strict=True):
            runs = _runs(*found)
            left, last = hashlib.sha256(), 0
            for a, b in runs:
                left.update(text[last:a])
                last = b
            left.update(text[last:])
            rows.append((i, len(text), sum(b - a for a, b in runs), len(runs), left.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
        yield columns_batch(["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], kinds, rows)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans`` for every row.

    Removed are all bytes in a string of 200 that starts anywhere else too, in
    the same text or another. Null and short texts lose nothing; repeated rows
    repeat each other. Spans are byte offsets, ends exclusive.
    """
    own = packed(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_numbered_texts, "row long, id long, text binary"), "texts")[0]
    starts = repeated(own.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    return own.join(starts, "row", "left").select("id", "text", "starts").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")
