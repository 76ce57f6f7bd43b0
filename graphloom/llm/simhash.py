"""SimHash near-duplicates through vantage-point trees.

Each distinct fingerprint is one point of the 64-bit Hamming space. The bits
fall into more groups than the radius, so two points within the radius are equal
in one group at least. For each group a vantage-point tree cuts the space into
shards: its vantage points measure distances in that group alone, where the
search radius is 0 and a ball lies on one side of each bound. So a point is sent
once for each group, however many shards there are. Where a single value of a
group fills more than a shard, the tree goes on with distances in all bits and
the whole radius: a point lives in one shard and is sent as a query to every
shard that its ball may touch (triangle bound at each vantage point). Within a
shard the same search goes on, vectorised, down to small blocks that are
compared exactly.

Trees are grown on the driver from a sample of ``PER_SHARD`` points a shard, a
share of ``PER_SHARD / SHARD`` of the distinct fingerprints.

A shard hands on a spanning forest of its links, never the pairs themselves;
components over all shards are found by star contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, dropped, hot_join, kept, only, stored, tidied, utf8, with_rows

WORDS, RADIUS, SEED = 3, 3, 42
#: Points that a shard should hold, and sampled points for each, from which the driver grows the trees.
SHARD, PER_SHARD = 20_000, 16
ALL = (1 << 64) - 1
#: Pairs compared at once within a shard.
BLOCK = 1 << 20
#: Points with one value of a group that are compared with their neighbours in order; more are searched through.
FEW = 24
#: Shingles hashed before their bits are added up.
BATCH = 200_000


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """Unsigned XXH64 of each shingle of words, repeats included."""
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    cut = [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return list(map(xxhash.xxh64_intdigest, cut, repeat(SEED)))


def fingerprint(hashes: list[int]) -> int:
    """Bits that are set in over half of the hashes."""
    if not hashes:
        return 0
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BATCH):
        own = np.array(hashes[i : i + BATCH], np.uint64).byteswap().view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = RowNumbers()
    for batch in batches:
        made = np.array([fingerprint(shingle_hashes(t)) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
        rows = batch.column(2) if batch.num_columns > 2 else pa.array(numbers.take(batch.num_rows), pa.int64())
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(made)], ["row", "id", "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``row, id, fp`` for every row; null and wordless texts have fingerprint 0."""
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text), *([F.col(row)] if row else []))
    return own.mapInArrow(tidied(_fingerprints), "row long, id long, fp long")


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def bit_groups(radius: int) -> list[int]:
    """Masks of ``radius + 1`` groups of neighbouring bits; points within the radius agree in one of them."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


class Tree:
    """Vantage-point trees, one for each group of bits, whose leaves are shards of about ``most`` sampled points."""

    def __init__(self, sample: np.ndarray, radius: int, most: int = PER_SHARD) -> None:
        self.radius, self.most = radius, most
        self.nodes: list[tuple[int, int, int, int, int, int]] = []  # vantage point, mask, radius, median, child within, child beyond; children < 0: shards
        self.groups: list[int] = []  # by shard: the bits in which its points are looked up
        self.roots = [self._grow(np.unique(sample), group, False) for group in bit_groups(radius)]

    def _grow(self, points: np.ndarray, group: int, whole: bool) -> int:
        rules = [(ALL, self.radius)] if whole else [(group, 0), (ALL, self.radius)]
        for mask, radius in rules if len(points) > 2 * self.most else ():
            seen = points & np.uint64(mask)
            picks = seen[:: max(1, len(seen) // 16)][:16]
            vantage = picks[int(np.argmax([distances(seen, p).astype(np.float64).std() for p in picks]))]
            far = distances(seen, vantage).astype(np.int16)
            median = int(np.median(far))
            if (far <= median).all():
                median -= 1
            within = far <= median
            # where balls cross the bound, a cut is of use only if less goes to both sides than is there
            crossing = (far <= median + radius).sum() + (far > median - radius).sum()
            if within.any() and crossing < 1.8 * len(points):
                k = len(self.nodes)
                self.nodes.append((0, 0, 0, 0, 0, 0))
                self.nodes[k] = (int(vantage), mask, radius, median, self._grow(points[within], group, mask == ALL), self._grow(points[~within], group, mask == ALL))
                return k
        self.groups.append(group)
        return -len(self.groups)

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: the points it must see, and whether it is their home in that tree."""
        stack = [(root, np.arange(len(points)), np.ones(len(points), bool)) for root in self.roots]
        while stack:
            node, own, home = stack.pop()
            if not len(own):
                continue
            if node < 0:
                yield -node - 1, own, home
                continue
            vantage, mask, radius, median, within, beyond = self.nodes[node]
            far = distances(points[own] & np.uint64(mask), np.uint64(vantage & mask)).astype(np.int16)
            near = far <= median + radius
            stack.append((within, own[near], home[near] & (far[near] <= median)))
            away = far > median - radius
            stack.append((beyond, own[away], home[away] & (far[away] > median)))


def _routed(tree) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.asarray(batch.column(0)).view(np.uint64)
            for shard, own, home in tree.value.route(points):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int32)), pa.array(points[own].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    return run


class Links:
    """Union-find over the points of one shard, fed with arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._find(a), self._find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.root, high, low)

    def _find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if np.array_equal(up, self.root[up]):
                return up
            self.root[x] = self.root[up]
            x = up

    def roots(self) -> np.ndarray:
        return self._find(np.arange(len(self.root)))


def search(points: np.ndarray, home: np.ndarray, queries: np.ndarray, radius: int, links: Links) -> None:
    """Link each home point to the query points within the radius.

    ``home`` and ``queries`` index ``points``; every home point is a query too.
    """
    stack = [(home, queries)]
    while stack:
        home, queries = stack.pop()
        if not len(home) or not len(queries):
            continue
        if len(home) * len(queries) <= BLOCK or len(home) <= 64:
            for own in np.array_split(queries, max(1, len(home) * len(queries) // BLOCK)):
                i, j = np.nonzero(np.bitwise_count(points[home][:, None] ^ points[own][None, :]) <= radius)
                links.join(home[i], own[j])
            continue
        picks = points[home[:: max(1, len(home) // 6)][:6]]
        all_far = [distances(points[home], p) for p in picks]
        best = int(np.argmax([x.astype(np.float32).std() for x in all_far]))
        far, to = all_far[best].astype(np.int16), distances(points[queries], picks[best]).astype(np.int16)
        median = int(np.median(far))
        if (far <= median).all():
            median -= 1
        within = far <= median
        if not within.any():  # one distance only: split by number, compare with all
            half = len(home) // 2
            stack += [(home[:half], queries), (home[half:], queries)]
            continue
        stack.append((home[within], queries[to <= median + radius]))
        stack.append((home[~within], queries[to > median - radius]))


def look_up(points: np.ndarray, home: np.ndarray, group: int, radius: int, links: Links) -> None:
    """Link the points of a shard that agree in the group's bits and lie within the radius."""
    order = np.argsort(points & np.uint64(group), kind="stable")
    value = points[order] & np.uint64(group)
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    sizes = np.diff(np.concatenate((first, [len(order)])))
    small = np.repeat(sizes <= FEW, sizes)
    for lag in range(1, FEW):
        a = np.flatnonzero(small[:-lag] & (value[lag:] == value[:-lag]))
        if not len(a):
            break
        i, j = order[a], order[a + lag]
        near = np.bitwise_count(points[i] ^ points[j]) <= radius
        links.join(i[near], j[near])
    for k in np.flatnonzero(sizes > FEW):
        own = order[first[k] : first[k] + sizes[k]]
        search(points, own[home[own]], own, radius, links)


def _linked(radius: int, groups: list[int]) -> Callable:
    """Shards arrive sorted; each leaves its spanning forest: point and smaller-numbered root."""

    def forest(shard: int, points: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        links = Links(len(points))
        look_up(points, home, groups[shard], radius, links)
        roots = links.roots()
        own = np.flatnonzero(roots != np.arange(len(points)))
        return pa.RecordBatch.from_arrays([pa.array(points[own].view(np.int64)), pa.array(points[roots[own]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, homes = None, [], []
        for batch in batches:
            shards, fps, home = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2).to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if shard is not None and shards[a] != shard:
                    yield forest(shard, np.concatenate(points), np.concatenate(homes))
                    points, homes = [], []
                shard = shards[a]
                points.append(fps[a:b])
                homes.append(home[a:b])
        if points:
            yield forest(shard, np.concatenate(points), np.concatenate(homes))

    return run


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (``u, v``) of the links between distinct fingerprints ``fp``."""
    spark = points.sparkSession
    share = PER_SHARD / SHARD
    sampled = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toArrow()
    sample = np.sort(np.asarray(sampled.column(0).combine_chunks() if sampled.num_rows else np.array([], np.int64)).view(np.uint64))
    tree = Tree(sample, radius)
    routed = points.select("fp").mapInArrow(tidied(_routed(spark.sparkContext.broadcast(tree))), "shard int, fp long, home boolean")
    dealt = routed.repartitionById(len(tree.groups), F.col("shard")).sortWithinPartitions("shard")
    return dealt.mapInArrow(tidied(_linked(radius, tree.groups)), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for each node of the edges, by star contraction.

    Each round hangs every node under the smallest node it knows (large star,
    then small star). Rounds grow with the logarithm of the size; minima are
    combined before each shuffle, and a node with very many links is joined
    apart from the others.
    """
    spark = edges.sparkSession
    now, path = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "low")
        large = hot_join(both.where("v > u"), low.where("n > 0"), ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = kept(large.where("u <> v").distinct(), "large")
        dropped(spark, low_path)
        low, low_path = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = hot_join(large, low, ["u"], "n")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last = path
        now, path = kept(after, "edges")
        for old in (last, large_path, low_path):
            dropped(spark, old)
        before, last = digest(now), before
        if before == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, row: str | None = None) -> DataFrame:
    """``row, id, fp, component_id, component`` for every row; the id is the smallest reachable by links.

    Rows with equal fingerprints are linked, wordless and null texts (0) among
    them. Null ids take part in links and are never the smallest, unless a
    component has no other; then the id is null. ``component`` is a number of the
    component itself. ``row`` names a column of numbers that tell the rows apart;
    without it they are numbered as they are read. Other columns are not read.
    """
    spark = docs.sparkSession
    made = stored(fingerprints(docs, id_column, text, row), "fingerprints")
    points, points_path = kept(made.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "points")
    found = components(links(points.select("fp"), radius))
    joined = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    named, named_path = kept(joined, "named")
    dropped(spark, points_path)
    least = named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    by_point = stored(hot_join(named.withColumnRenamed("n", "copies"), least, ["component"], "n").select("fp", "component", "component_id", "copies"), "components")
    dropped(spark, named_path)
    return hot_join(made, by_point, ["fp"], "copies").select("row", "id", "fp", "component_id", "component")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest id.

    Null ids come last, and among repeated ids the row read first stays.
    """
    own, row = with_rows(docs)
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first")
    stays = near_duplicates(own, id_column, text, row=row).groupBy("component").agg(first)
    return only(own, row, stays.select("first.row")).select(*docs.columns)
