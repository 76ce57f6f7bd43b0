"""Benchmark decontamination through a generalised suffix automaton.

The normalised items form one automaton over word numbers. A document's words
stream through it while the length of the longest match that ends at each word
is tracked; a match of at least a window's length marks a hit. Stretches in
which no two neighbouring words are neighbours in any item cannot hold a window
and are passed over, which changes no result.

An automaton covers about ``SHARD_WORDS`` item words. It is built by the task
that holds these items and written to the shared folder, where the tasks that
scan documents load it; more items make more automata, each with a scan of its
own, so what a task holds has a fixed bound and the driver holds only paths.
"""

from __future__ import annotations

import functools
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowNumbers, fresh, scratch, store, stored, tidied, utf8, with_rows

WINDOW = 10
#: Words of items in one automaton, about 400 MB of Python objects, and bytes that a word has at least with its gap.
SHARD_WORDS, BYTES_A_WORD = 1_000_000, 4
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 with A-Z lower-cased: runs of ASCII letters and digits and of all beyond ASCII."""
    return WORD.findall(text.lower())


class Automaton:
    """A generalised suffix automaton of items, and which windows each state stands for.

    A window is ``window`` consecutive words of an item, or a whole item of fewer words.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.ids.setdefault(w, len(self.ids)) for w in own]) for i, own in items if own]
        for _, own in coded:
            last = 0
            for w in own:
                last = self._extend(last, w)
        self.shortest = min((min(len(own), window) for _, own in coded), default=window)
        pairs = {a * len(self.ids) + b for _, own in coded for a, b in zip(own, own[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        # windows by state: {state: {length: items}}
        self.ends: dict[int, dict[int, set[int | None]]] = {}
        for i, own in coded:
            for state, length in self._windows(own):
                self.ends.setdefault(state, {}).setdefault(length, set()).add(i)
        # the nearest state at or above each on its suffix path that has windows
        self.near = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.near[state] = state if state in self.ends else self.near[self.link[state]] if state else -1

    def _extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None:
            if self.length[there] == self.length[last] + 1:
                return there
            return self._clone(last, w, there)
        state = self._new(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p == -1:
            self.link[state] = 0
        else:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return state

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _new(self, length: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append(following)
        return len(self.length) - 1

    def _windows(self, own: list[int]) -> Iterator[tuple[int, int]]:
        need = min(self.window, len(own))
        state = length = 0
        for w in own:
            state, length = self.next[state][w], length + 1
            while self.length[self.link[state]] >= need:
                state = self.link[state]
                length = self.length[state]
            if length >= need:
                yield state, need

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches outside of which no window can lie."""
        if self.shortest < 2:
            good = codes >= 0
            need = 1
        else:
            good = (codes[:-1] >= 0) & (codes[1:] >= 0)
            if len(self.pairs) and good.any():
                at = np.flatnonzero(good)
                pair = codes[at].astype(np.int64) * len(self.ids) + codes[at + 1]
                k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                good[at] = self.pairs[k] == pair
            need = self.shortest - 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= need:
                yield a, b + (need and self.shortest >= 2)

    def matches(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """Hit spans (first word, behind the last; disjoint, in order) and the items hit."""
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in own), np.int32, len(own))
        spans: list[tuple[int, int]] = []
        items: set[int | None] = set()
        for a, b in self.stretches(codes):
            state = length = 0
            for k, w in enumerate(codes[a:b].tolist(), a + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                else:
                    length = 0
                at, most = self.near[state], 0
                while at > 0:
                    for need, found in self.ends[at].items():
                        if need <= length:
                            most = max(most, need)
                            items |= found
                    at = self.near[self.link[at]]
                if most:
                    start = k - most
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, k))
        return spans, items


SCHEMA = "row long, id long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>"
KIND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _built(folder: str, window: int) -> Callable:
    """One automaton for the items of a task, written to the shared folder; gives its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(i, words(t)) for batch in batches for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)]
        if items:
            filesystem, path = store(folder)
            filesystem.create_dir(path, recursive=True)
            path = f"{path}/{uuid.uuid4().hex}"
            with filesystem.open_output_stream(path, compression=None) as file:
                pickle.dump(Automaton(items, window), file, protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return run


def automata(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW, unnamed: bool = True) -> tuple[str, list[str]]:
    """Automata of the items, each built by a task and stored: their folder and paths.

    Items are dealt by a hash over as many shards as keep each near
    ``SHARD_WORDS`` words, so neither the driver nor a task holds all of them.
    ``unnamed`` takes items without an id too.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null" if unnamed else "id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // (SHARD_WORDS * BYTES_A_WORD)) or 1
    folder = scratch(spark, "automata")
    dealt = items.repartitionById(shards, F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")).sortWithinPartitions("id", "text")
    made = stored(dealt.mapInArrow(tidied(_built(folder, window)), "path string"), "paths")
    return folder, [r["path"] for r in made.orderBy("path").collect()]  # one row a shard


@functools.lru_cache(1)
def _loaded(folder: str, path: str) -> Automaton:
    """An automaton from the shared folder; a worker holds one at a time."""
    with store(folder)[0].open_input_stream(path, compression=None) as file:
        return pickle.loads(file.read())


def _matched(folder: str, path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = RowNumbers()
        automaton = _loaded(folder, path) if path else Automaton([])
        for batch in batches:
            own = [words(t) for t in utf8(batch.column(1))]
            found = [automaton.matches(w) for w in own]
            spans = [[{"start": a, "stop": b} for a, b in united(x)] for x, _ in found]
            items = [sorted(x, key=lambda i: (i is None, i or 0)) for _, x in found]
            rows = batch.column(2) if batch.num_columns > 2 else pa.array(numbers.take(len(own)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array([len(w) for w in own], pa.int64()), pa.array(spans, KIND), pa.array(items, pa.list_(pa.int64()))], ["row", "id", "n_words", "spans", "items"])

    return run


#: SQL for a document's spans put together, from its spans by automaton, sorted.
UNITED = """
aggregate(slice(array_sort(flatten(collect_list(spans))), 2, 1000000000),
  named_struct('out', slice(array_sort(flatten(collect_list(spans))), 1, 1)),
  (acc, s) -> named_struct('out', if(s.start <= element_at(acc.out, -1).stop,
    array_append(slice(acc.out, 1, size(acc.out) - 1), named_struct('start', element_at(acc.out, -1).start, 'stop', greatest(s.stop, element_at(acc.out, -1).stop))),
    array_append(acc.out, s))), acc -> acc.out)
"""


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, unnamed: bool = False, row: str | None = None) -> DataFrame:
    """Where benchmark items occur: ``row, id, n_words, spans, items`` for every document row.

    Spans count words. Null and empty texts have no words; items that are null
    or wordless are never found. Items with one id count as one. With ``unnamed``,
    items without an id are found too and count as one, a null in ``items``;
    else they are not. An empty benchmark hits nothing. ``row`` names a column of
    numbers that tell the rows apart; without it they are numbered as they are
    read. Other columns are not read.

    With several automata the documents are scanned once for each, and what was
    found is put together by document.
    """
    folder, paths = automata(benchmark, item_column, item_text, window, unnamed)
    if len(paths) > 1 and row is None:
        docs, row = with_rows(docs)
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text), *([F.col(row)] if row else []))
    found = [own.mapInArrow(tidied(_matched(folder, p)), SCHEMA) for p in paths or [None]]
    if len(found) == 1:
        return found[0]
    both = functools.reduce(DataFrame.unionByName, found).groupBy("row", "id", "n_words")
    return both.agg(F.expr(UNITED).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _without(batch: pa.RecordBatch, at: int, found: Iterator[list[tuple[int, int]]], most_words: int, most_share: float) -> pa.RecordBatch:
    """The batch with each row's spans cut out of its text in column ``at``, or without the row."""
    out, keep = batch.column(at).to_pylist(), []
    for k, spans in enumerate(found):
        keep.append(True)
        if not spans:
            continue
        own = out[k].encode()
        places = [m.span() for m in WORD.finditer(own.lower())]
        sizes = [b - a for a, b in spans]
        kept, last = bytearray(), 0
        for a, b in spans:
            kept += own[last : places[a][0]]
            last = places[b - 1][1]
        kept += own[last:]
        keep[-1] = max(sizes) <= most_words and sum(sizes) <= most_share * len(places)
        out[k] = kept.decode()
    columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))


def _removed(text: str, most_words: int, most_share: float) -> Callable:
    """Cut the spans in the last column out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ([(s["start"], s["stop"]) for s in spans or ()] for spans in batch.column(batch.num_columns - 1).to_pylist())
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield _without(rest, batch.schema.get_field_index(text), found, most_words, most_share)

    return run


def _cleaned(folder: str, path: str | None, text: str, most_words: int, most_share: float) -> Callable:
    """Find spans with one automaton and cut them out, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _loaded(folder, path) if path else Automaton([])
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = (united(automaton.matches(words(t))[0]) for t in utf8(batch.column(at)))
            yield _without(batch, at, found, most_words, most_share)

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_words: int = 200, most_share: float = 0.5, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Documents without the spans that match benchmark items.

    A document goes altogether if one span has over ``most_words`` words or if
    spans cover over ``most_share`` of its words. Others keep their rows and
    columns; only hit spans leave ``text``. Clean texts are unchanged, null ones
    too. Items need no id.
    """
    folder, paths = automata(benchmark, window=window)
    if len(paths) < 2:
        return docs.mapInArrow(tidied(_cleaned(folder, paths[0] if paths else None, text, most_words, most_share)), docs.schema)
    spans = fresh(docs, "_spans")
    own, row = with_rows(docs)
    matched = functools.reduce(DataFrame.unionByName, [own.select(F.lit(None).cast("long").alias("id"), F.col(text), F.col(row)).mapInArrow(tidied(_matched(folder, p)), SCHEMA) for p in paths])
    hits = matched.where("size(spans) > 0").groupBy(F.col("row").alias(row)).agg(F.expr(UNITED).alias(spans))
    found = own.join(hits, row, "left").select(*docs.columns, spans)
    return found.mapInArrow(tidied(_removed(text, most_words, most_share)), docs.schema)
