"""Ranked search over inverted treaps.

Documents are read in blocks of consecutive rows. A block's inverted index has a
treap for each term that some item asks for: a binary search tree by document
and a heap by impact, so a node's impact is the largest of its subtree. An item
goes through the treaps of its terms together, interval of documents by
interval: in each treap it holds the topmost node that lies in the interval, and
the sum of their impacts bounds every score in it. Intervals whose bound cannot
enter the top k are pruned; others are cut at the document of the strongest
node, which is scored, down to short runs of documents that are scored whole.
The best k of one block are the bar that the next block of the task starts with.

Corpus counts are exact integers over all documents. The items' terms are dealt
into groups of about ``PAIRS`` (item, term) pairs, each written by a task to the
shared folder and searched by a pass of its own, so neither driver nor task
holds all items at any number of them.
"""

from __future__ import annotations

import functools
import math
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_batch, scratch, store, stored, utf8

#: (item, term) pairs of one group of items.
PAIRS = 1_000_000
#: Postings and documents of a block, and documents that are scored without cutting further.
POSTINGS, DOCUMENTS, RUN = 1 << 20, 1 << 15, 16
#: Intervals that are gone through at once.
FRONT = 64
#: Separators to blanks and A-Z to a-z.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all beyond ASCII, with A-Z lower-cased."""
    return text.translate(TERMS).split()


def weight(documents: int, found: int) -> int:
    """Weight of a term that ``found`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * found + 1)))


class Group:
    """Some items and their terms: ``items`` by number, ``ids`` of terms, ``asked`` term numbers by item."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]) -> None:
        self.ids: dict[bytes, int] = {}
        asked: dict[int | None, set[int]] = {}
        for item, term in pairs:
            asked.setdefault(item, set()).add(self.ids.setdefault(term, len(self.ids)))
        self.items = sorted(asked, key=lambda i: (i is None, i or 0))
        self.asked = [np.array(sorted(asked[i]), np.int64) for i in self.items]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [(i, t) for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for t in set(terms(text))]
        yield columns_batch(["item", "term"], [pa.int64(), pa.binary()], own)


def _grouped(folder: str) -> Callable:
    """The group of a task's pairs, written to the shared folder; gives its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if pairs:
            filesystem, path = store(folder)
            filesystem.create_dir(path, recursive=True)
            path = f"{path}/{uuid.uuid4().hex}"
            with filesystem.open_output_stream(path, compression=None) as file:
                pickle.dump(Group(pairs), file, protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return run


@functools.lru_cache(1)
def _loaded(folder: str, path: str) -> Group:
    with store(folder)[0].open_input_stream(path, compression=None) as file:
        return pickle.loads(file.read())


def groups(items: DataFrame, id_column: str = "item_id", text: str = "text", pairs: int = PAIRS) -> tuple[str, list[str]]:
    """Groups of items, each written by a task: their folder and paths. Items with one id are one item, null ids too."""
    spark = items.sparkSession
    own = stored(items.select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(_item_terms, "item long, term binary").distinct(), "terms")
    parts = -(-own.count() // pairs) or 1
    folder = scratch(spark, "groups")
    dealt = own.repartitionById(parts, F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).sortWithinPartitions("item", "term")
    made = stored(dealt.mapInArrow(_grouped(folder), "path string"), "paths")
    return folder, [r["path"] for r in made.orderBy("path").collect()]  # one row a group


FOUND = "id long, n long, terms array<int>, counts array<int>"


def _occurrences(folder: str, path: str) -> Callable:
    """For each document with terms: how many it has, and which of the group's, how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(folder, path).ids
        for batch in batches:
            own = [terms(t) for t in utf8(batch.column(1))]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            codes = np.fromiter((known.get(w, -1) for words in own for w in words), np.int64, int(sizes.sum()))
            place = np.repeat(np.arange(len(own)), sizes)
            hit = codes >= 0
            pairs, counts = np.unique(place[hit] * max(1, len(known)) + codes[hit], return_counts=True)
            at = pairs // max(1, len(known))
            offsets = np.searchsorted(at, np.arange(len(own) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (pairs % max(1, len(known)), counts)]
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *lists], ["id", "n", "terms", "counts"])
            yield made.filter(pa.array(sizes > 0))

    return run


class Treaps:
    """The inverted index of a block: a treap for each term, and each document's impacts.

    ``ids`` ascend (None last); ``owner``, ``term`` and ``impact`` are the postings, sorted by document.
    """

    def __init__(self, ids: list[int | None], owner: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.ids, self.term, self.impact = ids, term, impact
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))
        order = np.lexsort((owner, term))
        none = len(order)  # the node that stands for no node
        self.doc = np.append(owner[order], -1)
        self.heap = np.append(impact[order], 0)
        self.left, self.right = np.full(none + 1, none), np.full(none + 1, none)
        self.root = np.full(n_terms, none)
        self.none = none
        bounds = np.searchsorted(term[order], np.arange(n_terms + 1)).tolist()
        # equal impacts are ranked by a mix of the document's number, else they would make one long branch
        heap = np.empty(none, np.int64)
        heap[np.lexsort((self.doc[:none] * 2654435761 % (1 << 32), self.heap[:none]))] = np.arange(none)
        left, right, heap = self.left.tolist(), self.right.tolist(), heap.tolist()
        for t in np.unique(term).tolist():
            spine: list[int] = []
            for node in range(bounds[t], bounds[t + 1]):
                last = none
                while spine and heap[spine[-1]] < heap[node]:
                    last = spine.pop()
                left[node] = last
                if spine:
                    right[spine[-1]] = node
                spine.append(node)
            self.root[t] = spine[0]
        self.left, self.right = np.array(left), np.array(right)

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each interval (row) and treap (column), the topmost node of the subtree that lies in the interval."""
        shape, node = node.shape, node.ravel().copy()
        lo, hi = np.repeat(lo, shape[1]), np.repeat(hi, shape[1])
        at = np.flatnonzero(node != self.none)
        while len(at):
            own = node[at]
            doc = self.doc[own]
            before, behind = doc < lo[at], doc >= hi[at]
            moved = np.where(before, self.right[own], np.where(behind, self.left[own], own))
            node[at] = moved
            at = at[(before | behind) & (moved != self.none)]
        return node.reshape(shape)

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of documents for the terms that ``wanted`` marks."""
        first, size = self.first[docs], self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        sums = np.concatenate(([0], np.cumsum(np.where(wanted[self.term[at]], self.impact[at], 0))))
        return sums[ends] - sums[ends - size]

    def search(self, asked: np.ndarray, k: int, best: Best) -> None:
        """Put the block's documents that belong there into ``best``."""
        node = self.root[asked]
        node = node[node != self.none][None, :]
        if not node.size:
            return
        wanted = np.zeros(len(self.root), bool)
        wanted[asked] = True
        lo, hi = np.array([0]), np.array([len(self.ids)])
        bound = self.heap[node].sum(axis=1)
        while len(lo):
            alive = best.open(bound, lo, self.ids)
            lo, hi, node, bound = lo[alive], hi[alive], node[alive], bound[alive]
            if not len(lo):
                return
            if len(lo) > FRONT:
                order = np.argsort(-bound, kind="stable")
                lo, hi, node, bound = lo[order], hi[order], node[order], bound[order]
            a, b, n = lo[:FRONT], hi[:FRONT], node[:FRONT]
            short = b - a <= RUN
            pivot = self.doc[n[np.arange(len(a)), self.heap[n].argmax(axis=1)]]
            run = np.arange(RUN)[None, :] + a[short][:, None]
            docs = np.concatenate([pivot[~short], run[run < b[short][:, None]]])
            best.add(self.scores(docs, wanted), docs, self.ids)
            cut, n = pivot[~short], n[~short]
            new_lo, new_hi = np.concatenate([a[~short], cut + 1]), np.concatenate([cut, b[~short]])
            new = self.within(np.concatenate([n, n]), new_lo, new_hi)
            lo, hi = np.concatenate([lo[FRONT:], new_lo]), np.concatenate([hi[FRONT:], new_hi])
            node, bound = np.concatenate([node[FRONT:], new]), np.concatenate([bound[FRONT:], self.heap[new].sum(axis=1)])


class Best:
    """The k best documents so far: highest score first, then the smallest id, None last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []  # (-score, id is None, id or 0)

    def open(self, bound: np.ndarray, lo: np.ndarray, ids: list[int | None]) -> np.ndarray:
        """Which intervals may hold a document that belongs here, by their bound and first document."""
        if len(self.rows) < self.k:
            return bound > 0
        score, last = -self.rows[-1][0], self.rows[-1][1:]
        alive = bound > score
        for x in np.flatnonzero(bound == score).tolist():
            first = ids[lo[x]]
            alive[x] = (first is None, first or 0) < last
        return alive

    def add(self, scores: np.ndarray, docs: np.ndarray, ids: list[int | None]) -> None:
        least = -self.rows[-1][0] if len(self.rows) == self.k else 1
        at = np.flatnonzero(scores >= least)
        if len(at):
            new = [(-s, ids[d] is None, ids[d] or 0) for s, d in zip(scores[at].tolist(), docs[at].tolist(), strict=True)]
            self.rows = sorted(self.rows + new)[: self.k]


def impacts(sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting adds to a score, in 64-bit integers, rounding down."""
    m = 10 + np.array([90 * n * documents // length for n in sizes.tolist()], np.int64)
    return weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[owner]))


RANKED = "item_id long, doc_id long, score long"


def _ranked(folder: str, path: str, found: dict[int, int], documents: int, length: int, k: int) -> Callable:
    """Search the group's items in a task's documents, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _loaded(folder, path)
        weights = np.array([weight(documents, found.get(t, 0)) for t in range(len(group.ids))], np.int64)
        best = [Best(k) for _ in group.items]

        def searched(block: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(block).combine_chunks()
            ids = rows.column("id").to_pylist()
            order = sorted(range(len(ids)), key=lambda x: (ids[x] is None, ids[x] or 0))
            rows, ids = rows.take(pa.array(order, pa.int64())), [ids[x] for x in order]
            lists = rows.column("terms").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            term, counts = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
            index = Treaps(ids, owner, term, impacts(rows.column("n").to_numpy(), owner, term, counts, weights, documents, length), len(group.ids))
            for asked, own in zip(group.asked, best, strict=True):
                index.search(asked, k, own)

        block, postings, docs = [], 0, 0
        for batch in batches:
            block.append(batch)
            postings += len(batch.column(2).flatten())
            docs += batch.num_rows
            if postings >= POSTINGS or docs >= DOCUMENTS:
                searched(block)
                block, postings, docs = [], 0, 0
        if docs:
            searched(block)
        out = [(item, None if none else i, -s) for item, own in zip(group.items, best, strict=True) for s, none, i in own.rows]
        yield columns_batch(["item_id", "doc_id", "score"], [pa.int64()] * 3, out)

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents with the highest scores above 0.

    A score sums, over the item's distinct terms, weight times saturated count.
    Equal scores are in order of the document's id, null last. Repeated rows and
    repeated ids are documents of their own. Null and termless texts are no
    documents and ask for nothing; items with one id, null too, are one item with
    the terms of all. Empty tables give no rows. Other columns are not read.
    """
    folder, paths = groups(items, item_column, item_text, pairs)
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text))
    parts = []
    for path in paths:
        held = stored(own.mapInArrow(_occurrences(folder, path), FOUND), "occurrences")
        documents, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most a group's terms
        found = dict(zip(counted.column(0).to_pylist(), counted.column(1).to_pylist(), strict=True))
        parts.append(held.where("size(terms) > 0").mapInArrow(_ranked(folder, path, found, documents, length, k), RANKED))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return functools.reduce(DataFrame.unionByName, parts).withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
