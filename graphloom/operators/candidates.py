"""Pairs of similar texts, by prefixes of their q-grams.

Two texts are similar if the Jaccard index of their sets of q-grams reaches a
threshold. In any fixed order of all q-grams, similar sets then share one in
their first ``n - ceil(threshold * n) + 1``; ordered with common ones last, these
prefixes hold rare q-grams, so only texts that are in the list of one are compared.

A list is compared in Arrow batches, by what bounds the number of q-grams that
only one of two texts has: their parities in 256 bits differ in as many bits at
most. Few pairs stay; they are compared by all q-grams, at the first shared one
only. Long lists are split into tiles by a hash, and any two tiles meet in one
place, so no task holds a whole list. Here q-grams are hashes of 32 bits, equal
for equal q-grams, which may propose a pair too many but lose none; in the end
texts decide. No similar pair is lost, and none is made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_entity
from ..storage import stored
from .batches import whole_keys

#: Common q-grams whose counts order the prefixes.
COMMON = 10_000
#: Texts of a list, about, that are compared with as many at once.
TILE = 8_192
#: Q-grams of a text up to which it has them in the lists; pairs with a longer one are proposed by their bits alone.
SHORT = 64
#: Pairs that are compared by one task, about.
SHARE = 2_000_000_000
#: Texts of a list up to which its pairs are compared together with those of other lists.
FEW = 32
WORDS = ["w0", "w1", "w2", "w3"]
SLACK = 1e-9


def plain(text: Column) -> Column:
    """A name without case, punctuation and legal forms; the text in lower case if nothing is left."""
    return F.coalesce(F.nullif(normalize_entity(text), F.lit("")), F.lower(text))


def bare(text: Column) -> Column:
    """A text without case, spaces and punctuation; in lower case if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(text), r"[\p{P}\p{Z}\p{C}\s]+", ""), F.lit("")), F.lower(text))


def _grams(plain: Column, size: int) -> Column:
    marked = F.concat(F.repeat(F.lit("\x02"), F.lit(size - 1)), plain, F.repeat(F.lit("\x03"), F.lit(size - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - (size - 1), F.lit(1))), lambda i: F.substr(marked, i, F.lit(size))))


def grams(text: Column, size: int = 3) -> Column:
    """The distinct q-grams of a name without case, punctuation and legal forms, its ends marked; of the bare text if nothing is left."""
    return _grams(plain(text), size)


def _arranged(similarity: float, common: np.ndarray, short: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts' codes in order, those of their prefixes, and the parities of all; ``common`` has the most common codes, commonest first."""
    by_code = np.argsort(common)
    known = common[by_code]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("codes")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            code, row, first = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            place = code & 0xFFFFFFFF
            if len(known):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                place = np.where(known[at] == code, (len(known) - by_code[at]) << 32, place)
            code = code[np.lexsort((place, row))]
            bit = np.uint64(1) << (code & 63).astype(np.uint64)
            words = [pa.array(np.bitwise_xor.reduceat(np.where((code >> 6 & 3) == k, bit, np.uint64(0)), first).view(np.int64)) for k in range(4)]
            early = np.arange(len(code)) - first[row] < (n - np.ceil(n * similarity - SLACK).astype(np.int64) + 1)[row]
            early[1:] &= (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            listed = lambda keep: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(n)))]), pa.int32()), pa.array(code[keep], pa.int32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int32()), *words, listed((n <= short)[row]), listed(early)], ["id", "n", *WORDS, "codes", "prefix"])

    return run


class _Texts:
    """Texts of whole lists, and which of them are similar."""

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        column = lambda name: rows.column(name).to_numpy()
        self.similarity, self.apart = similarity, (1 - similarity) / (1 + similarity)
        self.id, self.n, self.code = column("id"), column("n").astype(np.int64), column("code").astype(np.int64)
        self.own, self.x, self.y = column("own"), column("x"), column("y")
        self.words = np.stack([column(w).view(np.uint64) for w in WORDS])
        self.folded = self.words[:2] ^ self.words[2:]  # parities in 128 bits
        lists = rows.column("codes").combine_chunks()
        length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.short = length > 0
        self.codes = np.full((len(length), max(1, length.max())), 1 << 40)
        at = np.repeat(np.arange(len(length)), length)
        self.codes[at, np.arange(len(at)) - (np.cumsum(length) - length)[at]] = lists.flatten().to_numpy()

    def most(self, n: np.ndarray | int) -> np.ndarray | int:
        """Q-grams that only one of two similar texts has, which have n in all."""
        return np.floor(self.apart * n + 1e-6)

    def few(self, pick: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of the picked texts that are in one list."""
        start = np.cumsum(starts_of(self.code, self.x, self.y))[pick]
        for d in range(1, most):
            i = np.flatnonzero(start[d:] == start[:-d])
            if not len(i):
                return
            i, j = pick[i], pick[i + d]
            meant = (self.x[i] == self.y[i]) | (self.own[i] != self.own[j])
            yield i[meant], j[meant]

    def many(self, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of a list's texts, in the order of their sizes, that parities in 128 bits do not tell apart."""
        n, limit = self.n[right], np.minimum(np.ceil(self.apart * self.n + 1e-6), 127).astype(np.uint8)  # two of them hold what 128 bits can differ by
        for i in range(0, len(left), 64):
            rows = left[i : i + 64]
            low = np.searchsorted(n, self.n[rows[0]] * self.similarity - SLACK)
            high = np.searchsorted(n, self.n[rows[-1]] / self.similarity + 1e-6, side="right")
            for j in range(max(low, i) if same else low, high, 512):
                cols = right[j : min(j + 512, high)]
                differ = np.bitwise_count(self.folded[0, rows][:, None] ^ self.folded[0, cols][None, :])
                differ += np.bitwise_count(self.folded[1, rows][:, None] ^ self.folded[1, cols][None, :])
                near = np.flatnonzero((differ <= limit[rows][:, None] + limit[cols][None, :]).ravel())
                a, b = np.divmod(near, len(cols))
                if same:
                    later = b + j > a + i
                    a, b = a[later], b[later]
                yield rows[a], cols[b]

    def similar(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are similar, at their first shared q-gram; of those with a long text, all that may be."""
        a, b = self.n[i], self.n[j]
        differ = np.zeros(len(i), dtype=np.int16)
        for w in self.words:
            differ += np.bitwise_count(w[i] ^ w[j])
        keep = (np.minimum(a, b) >= self.similarity * np.maximum(a, b) - SLACK) & (differ <= self.most(a + b))
        i, j = i[keep], j[keep]
        both = self.short[i] & self.short[j]
        out = [(i[~both], j[~both])]
        i, j = i[both], j[both]
        for k in range(0, len(i), 2_048):
            p, q = i[k : k + 2_048], j[k : k + 2_048]
            a, b = self.codes[p][:, : self.n[p].max()], self.codes[q][:, : self.n[q].max()]
            equal = (a[:, :, None] == b[:, None, :]) & (a < 1 << 40)[:, :, None]
            shared = equal.sum(axis=(1, 2))
            first = a[np.arange(len(p)), equal.any(axis=2).argmax(axis=1)]
            keep = (shared >= self.similarity * (self.n[p] + self.n[q] - shared) - SLACK) & (first == self.code[p])
            out.append((p[keep], q[keep]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin = np.flatnonzero(starts_of(self.code, self.x, self.y))
        size = np.diff(np.append(begin, len(self.code)))
        yield from self.few(np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size)), FEW)
        for k in np.flatnonzero(size > FEW):
            rows = np.arange(begin[k], begin[k] + size[k])
            rows = rows[np.argsort(self.n[rows], kind="stable")]
            same = self.x[rows[0]] == self.y[rows[0]]
            left, right = (rows, rows) if same else (rows[self.own[rows] == self.x[rows]], rows[self.own[rows] == self.y[rows]])
            yield from self.many(left, right, same)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _met(similarity: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``a, b``: ids of similar texts, from the texts of lists in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, ["code", "x", "y"]):
            texts, waiting = _Texts(rows, similarity), []
            held = 0
            for pair in chain(texts.pairs(), [None]):
                if pair is not None:
                    waiting.append(pair)
                    held += len(pair[0])
                if waiting and (pair is None or held > 50_000):
                    i, j = texts.similar(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                    a, b = texts.id[i], texts.id[j]
                    waiting, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def similar_pairs(values: DataFrame, similarity: float = 0.5, size: int = 3) -> DataFrame:
    """``block, a, b`` with a < b for all similar texts of a block, from distinct ``block, value``.

    ``similarity`` is above 0 and at most 1. Null texts are similar to none. Texts
    that are the same without case and punctuation are compared as one.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity must be above 0 and at most 1, not {similarity!r}")
    spark = values.sparkSession
    own = stored(values.where("value is not null").select("block", "value", plain(F.col("value")).alias("plain")), "values")
    texts = stored(own.select("block", "plain").distinct().select(F.monotonically_increasing_id().alias("id"), "block", "plain", F.transform(_grams(F.col("plain"), size), lambda g: F.hash("block", g)).alias("codes")), "texts")
    common = texts.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy(F.desc("count"), "code").limit(COMMON).collect()
    order = _arranged(similarity, np.array([r["code"] for r in common], dtype=np.int64), SHORT)
    sets = stored(texts.select("id", "codes").mapInArrow(order, f"id long, n int, {', '.join(f'{w} long' for w in WORDS)}, codes array<int>, prefix array<int>"), "sets")
    sizes = stored(sets.select(F.explode("prefix").alias("code")).groupBy("code").agg(F.count("*").alias("texts")), "sizes")
    tiles = F.ceil(F.col("texts") / TILE).cast("int")
    work = sizes.agg(F.sum(F.col("texts").cast("double") * F.col("texts")) / 2, F.sum(F.col("texts") * tiles)).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((work[0] or 0) / SHARE) + 1, int((work[1] or 0) / 1_000_000) + 1)
    long = sizes.where(F.col("texts") > TILE).select("code", tiles.alias("tiles"))  # at most one for TILE rows of lists
    listed = sets.select(F.explode("prefix").alias("code"), "id", "n", *WORDS, "codes").join(F.broadcast(long), "code", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    listed = listed.withColumn("own", F.pmod(F.xxhash64("id", "code"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    listed = listed.select("code", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", *WORDS, "codes")
    met = stored(listed.repartition(tasks, "code", "x", "y").sortWithinPartitions("code", "x", "y").mapInArrow(_met(similarity), "a long, b long"), "met").distinct()
    side = lambda n: texts.select(F.col("id").alias(n), F.col("block").alias(f"block_{n}"), F.col("plain").alias(f"p{n}"))
    both = met.join(side("a"), "a").join(side("b"), "b").where("block_a = block_b").select("a", "b", _grams(F.col("pa"), size).alias("ga"), _grams(F.col("pb"), size).alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    found = both.where(shared >= similarity * (F.size("ga") + F.size("gb") - shared) - SLACK).select("a", "b")
    names = own.join(texts.select("id", "block", "plain"), ["block", "plain"])
    of = lambda n: names.select(F.col("id").alias(n), "block", F.col("value").alias(f"v{n}"))
    apart = found.join(of("a"), "a").join(of("b").drop("block"), "b").select("block", F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"))
    alike = of("a").join(of("b").drop("block"), F.col("a") == F.col("b")).where("va < vb").select("block", F.col("va").alias("a"), F.col("vb").alias("b"))
    return apart.unionByName(alike)


def respelled_pairs(values: DataFrame, similarity: float, size: int = 3) -> DataFrame:
    """``block, a, b`` with a < b for texts that differ in case, spaces and punctuation only, of those that ``similar_pairs`` leaves out."""
    own = stored(values.where("value is not null").select("block", "value", bare(F.col("value")).alias("bare"), plain(F.col("value")).alias("plain")), "bare")
    side = lambda n: own.select("block", "bare", F.col("plain").alias(f"p{n}"), F.col("value").alias(n))
    met = side("a").join(side("b"), ["block", "bare"]).where("a < b and pa <> pb")
    met = met.select("block", "a", "b", _grams(F.col("pa"), size).alias("ga"), _grams(F.col("pb"), size).alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    return met.where(shared < similarity * (F.size("ga") + F.size("gb") - shared) - SLACK).select("block", "a", "b")
