"""What strategies get and give, and the registry of strategies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evidence import EVIDENCE, Evidence
from ..graph import STAGED_EDGES, STAGED_NODES, attribute_map
from ..sources import SourceBundle
from ..spec import ElementType, GraphSpec


@dataclass(frozen=True)
class ExtractedNode:
    id: str
    type: str
    attributes: Mapping[str, Any] = field(default_factory=dict)
    evidence: Evidence | None = None


@dataclass(frozen=True)
class ExtractedEdge:
    id: str
    type: str
    source: str
    target: str
    attributes: Mapping[str, Any] = field(default_factory=dict)
    evidence: Evidence | None = None


@dataclass(frozen=True)
class Extraction:
    """What one strategy found: driver-side elements, or DataFrames.

    ``node_rows`` has ``id, types, attributes, evidence, seq``; ``edge_rows`` has
    ``source``, ``target`` and ``type`` in place of ``types``.
    """

    nodes: Sequence[ExtractedNode] = ()
    edges: Sequence[ExtractedEdge] = ()
    notes: str | None = None
    node_rows: DataFrame | None = None
    edge_rows: DataFrame | None = None

    @property
    def is_empty(self) -> bool:
        return not self.nodes and not self.edges and self.node_rows is None and self.edge_rows is None

    def staged(self, spark: SparkSession, step: int) -> tuple[list[DataFrame], list[DataFrame]]:
        """Node and edge frames with their order columns."""
        nodes, edges = [], []
        row = lambda e: None if e is None else e.to_row()
        if self.nodes:
            nodes.append(spark.createDataFrame([(n.id, [n.type], attribute_map(n.attributes), row(n.evidence), step, k) for k, n in enumerate(self.nodes)], STAGED_NODES))
        if self.edges:
            edges.append(spark.createDataFrame([(e.id, e.source, e.target, e.type, attribute_map(e.attributes), row(e.evidence), step, k) for k, e in enumerate(self.edges)], STAGED_EDGES))
        for frame, names, out in ((self.node_rows, STAGED_NODES, nodes), (self.edge_rows, STAGED_EDGES, edges)):
            if frame is not None:
                if "evidence" not in frame.columns:
                    frame = frame.withColumn("evidence", F.lit(None).cast(EVIDENCE))
                frame = frame.withColumn("step", F.lit(step))
                out.append(frame.select(*([F.col("id"), F.col("types")] if out is nodes else [F.col(c) for c in ("id", "source", "target", "type")]), "attributes", "evidence", F.col("step").cast("int").alias("step"), F.col("seq").cast("long").alias("seq")))
        return nodes, edges


@dataclass
class ExtractionContext:
    """What a strategy works on; ``element_types`` has several for a cluster."""

    spark: SparkSession
    sources: SourceBundle
    spec: GraphSpec
    element_type: ElementType | None = None
    element_types: Sequence[ElementType] = ()
    services: Mapping[str, Any] = field(default_factory=dict)
    cache: Any = None
    config: Mapping[str, Any] = field(default_factory=dict)


@runtime_checkable
class Extractor(Protocol):
    def __call__(self, context: ExtractionContext) -> Extraction: ...


class Registry:
    """Factories by name; a name is taken once, entry points of ``group`` are looked up when a name is unknown."""

    def __init__(self, what: str, group: str) -> None:
        self.what, self.group, self._by_name = what, group, {}

    def register(self, name: str) -> Callable:
        def put(factory):
            if name in self._by_name:
                raise ValueError(f"{self.what} {name!r} is registered already")
            self._by_name[name] = factory
            return factory

        return put

    def build(self, name: str, **params: Any) -> Any:
        if name not in self._by_name:
            for point in entry_points(group=self.group):
                self._by_name.setdefault(point.name, point.load())
        if name not in self._by_name:
            raise KeyError(f"unknown {self.what} {name!r}; known: {', '.join(self.names())}")
        return self._by_name[name](**params)

    def names(self) -> list[str]:
        return sorted(self._by_name)


extractors = Registry("strategy", "graphloom.extractors")
register_extractor, build_extractor, available_extractors = extractors.register, extractors.build, extractors.names


@runtime_checkable
class Cache(Protocol):
    def get(self, key: str) -> Any: ...

    def set(self, key: str, value: Any) -> None: ...


class NullCache:
    def get(self, key: str) -> None:
        return None

    def set(self, key: str, value: Any) -> None:
        pass


class DictCache:
    def __init__(self) -> None:
        self._values: dict[str, Any] = {}

    def get(self, key: str) -> Any:
        return self._values.get(key)

    def set(self, key: str, value: Any) -> None:
        self._values[key] = value


def cache_key(*parts: Any) -> str:
    """SHA-256 of the parts as JSON with sorted keys."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()
