"""Best-fit packing of tokenised documents with large-item matching.

Lengths are whole numbers up to the capacity, so a plan for any number of
documents needs only how many there are of each length. The driver plans on
that histogram (at most ``capacity`` rows) and tasks look their documents up
in the plan by length and rank within the length.

Documents above a third of the capacity share a sequence with one more of
their kind at most: from the longest on, each is matched with the longest that
still fits beside it. Shorter ones then go, longest first, to the sequence with
the smallest sufficient gap, else to a new one.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RowNumbers, stored, tidied, utf8

CAPACITY = 4096
END_ID = 1
#: White-space-free chunks and lower-case words whose ids a Python worker remembers, up to twice as many.
CHUNKS, WORDS = 250_000, 350_000
#: Chunks of more characters go to the tokenizer as they are.
LONG = 64
#: Bytes of texts that are encoded together.
TOGETHER = 4 << 20
#: The tokenizer's own pre-tokens, for characters below U+0250 where both sides agree on letters and numbers.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|_)+")
BEYOND = re.compile("[^\x21-\x7e¡-¬®-ɏ]|<\\|")


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known(dict):
    """A mapping that makes what it lacks, or takes it from one that was kept ``before``."""

    def __init__(self, make: Callable, before: dict) -> None:
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Recent:
    """A mapping that forgets what was not used for ``size`` to twice ``size`` new keys."""

    def __init__(self, size: int, make: Callable) -> None:
        self.size, self.now = size, Known(make, {})

    def turn(self) -> None:
        if len(self.now) >= self.size:
            before = self.now
            before.before = {}
            self.now = Known(before.make, before)

    def forget(self, key) -> None:
        self.now.pop(key, None)


#: The tokenizer's letters for bytes: printable ones stand for themselves, the others follow from U+0100 on.
LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


def _bytes(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class ChunkIds:
    """Ids (little-endian unsigned 32-bit) of texts, by way of their white-space-free chunks.

    The tokenizer drops white space and never merges across it, so the ids of
    a text are those of its chunks in turn. A chunk's are those of its
    pre-tokens; only new ones reach the tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.encoder = _tokenizer(path)
        self.merge = self.encoder.model.tokenize
        self.chunks, self.words = Recent(CHUNKS, self._chunk), Recent(WORDS, self._merged)
        self.long: list[bytes] = []

    def _merged(self, word: str) -> bytes:
        """Of a pre-token: only the model is left to apply, on its letters for bytes."""
        return _bytes([x.id for x in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS))])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if len(text) > LONG or (not chunk.isalpha() and BEYOND.search(text)):
            if len(chunk) > 4 * LONG:
                self.long.append(chunk)
            return _bytes(self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        lower, word = text.lower(), self.words.now
        if lower.isalpha():  # a single pre-token
            return word[lower]
        if lower[-1] in ",." and lower[:-1].isalpha():
            return word[lower[:-1]] + word[lower[-1]]
        return b"".join(map(word.__getitem__, PRETOKEN.findall(lower)))

    def ids(self, given: list[bytes]) -> list[bytes]:
        self.chunks.turn()
        self.words.turn()
        known = self.chunks.now.__getitem__
        out = [b"".join(map(known, text.split())) for text in given]
        for chunk in self.long:
            self.chunks.forget(chunk)
        self.long.clear()
        return out


#: ``spot`` is the place among the pieces of this length in this part of the input.
PIECES = "row long, id long, piece int, start long, length int, ids_crc32 long, part int, spot long"


def together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts, about ``TOGETHER`` bytes at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _cut(path: str, capacity: int, with_ids: bool) -> Callable:
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, numbers, seen = ChunkIds(path), RowNumbers(), {}
        for batch in batches:
            out: list[list] = [[] for _ in range(8 + with_ids)]
            texts = utf8(batch.column(1))
            encoded = (ids for part in together(texts) for ids in chunks.ids(part))
            for row, i, ids in zip(numbers.take(batch.num_rows), batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    spot = seen[length] = seen.get(length, -1) + 1
                    for column, value in zip(out, (row, i, piece, at // 4, length, zlib.crc32(own), numbers.partition, spot, own), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["row", "id", "piece", "start", "length", "ids_crc32", "part", "spot", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=False)], names[: len(out)])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``capacity``; ``with_ids`` keeps the ids."""
    kept = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text))
    return kept.mapInArrow(tidied(_cut(tokenizer_path, capacity, with_ids)), PIECES + (", ids binary" if with_ids else ""))


class Plan:
    """Where the pieces of each length go: runs of (first rank, first sequence, per sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.placed: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        counts = {k: v for k, v in counts.items() if v}
        large = {k: v for k, v in counts.items() if 3 * k > capacity}
        for length in sorted(large, reverse=True):
            while large[length]:
                mate = next((x for x in range(min(length, capacity - length), 0, -1) if large.get(x) and (x != length or large[x] > 1)), 0)
                n = large[length] // 2 if mate == length else min(large[length], large[mate]) if mate else large[length]
                first = self._new(n)
                if mate == length:
                    self._put(length, n * 2, first, 2, 0)
                    large[length] -= 2 * n
                else:
                    self._put(length, n, first, 1, 0)
                    large[length] -= n
                    if mate:
                        self._put(mate, n, first, 1, length)
                        large[mate] -= n
                self._gap(capacity - length - mate, first, n)
        for length in sorted((k for k in counts if k not in large), reverse=True):
            left = counts[length]
            while left:
                gap = next((g for g in range(length, capacity) if self.gaps.get(g)), 0)
                if not gap:
                    each = capacity // length
                    self._gap(capacity, self._new(-(-left // each)), -(-left // each))
                    gap = capacity
                first, n = self.gaps[gap].pop()
                each = gap // length
                full = min(n, left // each)
                self._put(length, full * each, first, each, capacity - gap)
                self._gap(gap - each * length, first, full)
                left -= full * each
                rest = n - full
                if rest and left:  # the last sequence takes fewer
                    self._put(length, left, first + full, each, capacity - gap)
                    self._gap(gap - left * length, first + full, 1)
                    left, full, rest = 0, full + 1, rest - 1
                self._gap(gap, first + full, rest)

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        if n:
            rank = self.placed.get(length, 0)
            self.runs.setdefault(length, []).append((rank, first, each, offset))
            self.placed[length] = rank + n

    def _gap(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            self.gaps.setdefault(gap, []).append((first, n))

    def arrays(self) -> dict[int, np.ndarray]:
        return {k: np.array(v, np.int64).T.copy() for k, v in self.runs.items()}


def _placed(plan) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)).astype(np.int64) for k in ("length", "rank"))
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[own[0]])
                first, start, each, at = runs[length]
                k = np.searchsorted(first, ranks[own], side="right") - 1
                nth = ranks[own] - first[k]
                sequence[own], offset[own] = start[k] + nth // each[k], at[k] + nth % each[k] * length
            keep = [n for n in batch.schema.names if n not in ("rank", "part", "spot")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of each piece.

    ``cut`` comes from ``pieces``, stored, so that its parts and spots are final.
    A piece's rank within its length is its spot plus the number of pieces of
    that length in earlier parts; hot lengths are spread over parts.
    """
    spark = cut.sparkSession
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).arrays())
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("spot") + F.col("before")).drop("before")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("rank", "part", "spot"))
    return ranked.mapInArrow(tidied(_placed(plan)), schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    One row for each piece: ``row, id, piece, start, length, ids_crc32,
    sequence_id, offset`` (and ``ids``). Null and empty texts are a single end
    id. Only documents longer than the capacity are cut. Repeated rows and ids
    are packed as often as they occur; an empty table gives no rows.
    """
    return assign(stored(pieces(docs, tokenizer_path, id_column, text, capacity, with_ids), "pieces"), capacity)
