"""Sources and ordered bundles of them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .separated import Records

TEXT, TABLE, JSON = "text", "table", "json"
TEXTS = "ordinal long, source_id string, text string"


@dataclass(frozen=True)
class Source:
    """One input. ``content`` is a string, a list of records, a JSON value, or a DataFrame.

    A text source may be a DataFrame with ``source_id`` and ``text`` columns: as
    many texts as it has rows, in the order of ``ordinal`` (below 2^40), if it has one, and ``source_id``.
    """

    id: str
    content: Any
    kind: str = TEXT
    schema: Any = None
    metadata: Mapping[str, Any] = field(default_factory=dict)


class SourceBundle:
    """Sources in order, with unique ids."""

    def __init__(self, sources: Iterable[Source] = ()) -> None:
        self._by_id: dict[str, Source] = {}
        self._numbered: dict[str, DataFrame] = {}
        self._shared: set[str] = set()
        for s in sources:
            if s.id in self._by_id:
                raise ValueError(f"two sources have the id {s.id!r}")
            self._by_id[s.id] = s

    def __iter__(self) -> Iterator[Source]:
        return iter(self._by_id.values())

    def __len__(self) -> int:
        return len(self._by_id)

    def __contains__(self, id: str) -> bool:
        return id in self._by_id

    def share(self, ids: Iterable[str]) -> None:
        """Sources that several bindings read: their row numbers are written once, so that all see the same."""
        self._shared |= set(ids) - set(self._numbered)

    def get(self, id: str) -> Source | None:
        return self._by_id.get(id)

    def of_kind(self, kind: str) -> list[Source]:
        return [s for s in self if s.kind == kind]

    def texts(self, spark: SparkSession) -> DataFrame:
        """All text as ``ordinal, source_id, text``; ordinals give the bundle's order."""
        single, frames = [], []
        for k, s in enumerate(self):
            if s.kind != TEXT:
                continue
            if isinstance(s.content, DataFrame):
                order = F.col("ordinal").cast("long") if "ordinal" in s.content.columns else F.lit(0).cast("long")  # ``source_id`` orders within
                far = F.raise_error(F.lit(f"source {s.id!r} has an ordinal below 0 or from 2^40 on")).cast("long")
                order = F.when(order.isNull() | order.between(0, (1 << 40) - 1), order).otherwise(far)
                frames.append(s.content.select((F.lit(k << 40) + order).alias("ordinal"), F.col("source_id").cast("string").alias("source_id"), "text"))
            else:
                single.append((k << 40, s.id, s.content))
        out = spark.createDataFrame(single, TEXTS)
        for frame in frames:
            out = out.unionByName(frame)
        return out

    def table(self, spark: SparkSession, id: str) -> DataFrame | None:
        """A table source as a DataFrame with its row number ``_row``; None for an unknown id."""
        s = self.get(id)
        if s is None:
            return None
        if isinstance(s.content, DataFrame):
            if "_row" in s.content.columns:
                return s.content
            if id not in self._numbered:
                numbered = s.content.withColumn("_row", F.monotonically_increasing_id())
                self._numbered[id] = stored(numbered, "rows") if id in self._shared else numbered
            return self._numbered[id]
        if isinstance(s.content, Records):
            return s.content.frame
        return records_frame(spark, s.content or [], s.schema)


def records_frame(spark: SparkSession, records: Iterable[Mapping[str, Any]], schema: Any = None) -> DataFrame:
    """Driver-side records as a DataFrame with ``_row``; columns are all keys in order of appearance."""
    rows = [dict(r) for r in records]
    names = list(dict.fromkeys(k for r in rows for k in r if isinstance(k, str)))
    if schema is not None:
        return spark.createDataFrame([{**r, "_row": i} for i, r in enumerate(rows)], schema.add("_row", "long"))
    kinds = []
    for n in names:
        values = [r[n] for r in rows if r.get(n) is not None]
        kind = "string"
        if values and all(isinstance(v, bool) for v in values):
            kind = "boolean"
        elif values and all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            kind = "long"
        elif values and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
            kind = "double"
        kinds.append(kind)
    make = {"string": lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False), "double": lambda v: None if v is None else float(v)}
    data = [(*(make.get(k, lambda v: v)(r.get(n)) for n, k in zip(names, kinds, strict=True)), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join([f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)] + ["_row long"]))


def coerce_sources(given: Any) -> SourceBundle:
    """A bundle from a text, a source, a bundle, an iterable of sources, or a mapping of ids to contents."""
    if isinstance(given, SourceBundle):
        return given
    if isinstance(given, str):
        return SourceBundle([Source("source", given)])
    if isinstance(given, Source):
        return SourceBundle([given])
    if isinstance(given, DataFrame):
        return SourceBundle([Source("source", given, TEXT if {"source_id", "text"} <= set(given.columns) else TABLE)])
    if isinstance(given, Mapping):
        return SourceBundle(v if isinstance(v, Source) else Source(k, v, _kind(v)) for k, v in given.items())
    return SourceBundle(s if isinstance(s, Source) else Source(f"source{i}", s, _kind(s)) for i, s in enumerate(given))


def _kind(content: Any) -> str:
    if isinstance(content, DataFrame):
        return TEXT if {"source_id", "text"} <= set(content.columns) else TABLE
    return TEXT if isinstance(content, str) else TABLE if isinstance(content, (list, Records)) else JSON
