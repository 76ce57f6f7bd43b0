"""A property graph held as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evidence import EVIDENCE, EVIDENCE_TABLE

NODES = "id string, types array<string>, attributes map<string,string>"
EDGES = "id string, source string, target string, type string, attributes map<string,string>"
STAGED_NODES = f"{NODES}, evidence {EVIDENCE}, step int, seq long"
STAGED_EDGES = f"{EDGES}, evidence {EVIDENCE}, step int, seq long"


@dataclass(frozen=True)
class Node:
    id: str
    types: tuple[str, ...]
    attributes: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    id: str
    source: str
    target: str
    type: str
    attributes: Mapping[str, Any] = field(default_factory=dict)


def attribute_map(attributes: Mapping[str, Any]) -> dict[str, str]:
    """Attribute values as JSON text."""
    return {str(k): json.dumps(v, ensure_ascii=False) for k, v in attributes.items()}


class Graph:
    """``nodes``, ``edges`` and ``evidence`` DataFrames, and ``reports`` by name.

    Attribute values are JSON text. Node ids and edge ids are unique; edges may
    be parallel. Everything is lazy.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, reports: dict[str, Any] | None = None) -> None:
        spark = nodes.sparkSession
        self.spark = spark
        self.nodes = nodes.select("id", "types", "attributes")
        self.edges = edges.select("id", "source", "target", "type", "attributes")
        self.evidence = spark.createDataFrame([], EVIDENCE_TABLE) if evidence is None else evidence
        self.reports = reports or {}

    @classmethod
    def of(cls, spark: SparkSession, nodes: Iterable[Node] = (), edges: Iterable[Edge] = ()) -> Graph:
        """A graph from driver-side elements, merged and checked like extracted ones."""
        from .operators.assembly import assemble

        staged_nodes = [(n.id, list(n.types), attribute_map(n.attributes), None, 0, k) for k, n in enumerate(nodes)]
        staged_edges = [(e.id, e.source, e.target, e.type, attribute_map(e.attributes), None, 0, k) for k, e in enumerate(edges)]
        return assemble(spark.createDataFrame(staged_nodes, STAGED_NODES), spark.createDataFrame(staged_edges, STAGED_EDGES), dangling="raise")

    def nodes_of_type(self, type: str) -> DataFrame:
        return self.nodes.where(F.array_contains("types", type))

    def edges_of_type(self, type: str) -> DataFrame:
        return self.edges.where(F.col("type") == type)

    def edges_between(self, source: str, target: str) -> DataFrame:
        """Directed, parallel ones too."""
        return self.edges.where((F.col("source") == source) & (F.col("target") == target))

    def node(self, id: str) -> Node:
        row = self.nodes.where(F.col("id") == id).first()
        if row is None:
            raise KeyError(id)
        return as_node(row)

    def edge(self, id: str) -> Edge:
        row = self.edges.where(F.col("id") == id).first()
        if row is None:
            raise KeyError(id)
        return as_edge(row)

    def has_node(self, id: str) -> bool:
        return not self.nodes.where(F.col("id") == id).isEmpty()

    def has_edge(self, id: str) -> bool:
        return not self.edges.where(F.col("id") == id).isEmpty()

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        return self.edges.count()

    def counts_by_type(self) -> DataFrame:
        """``kind, type, n`` over node labels and edge types."""
        nodes = self.nodes.select(F.lit("node").alias("kind"), F.explode("types").alias("type"))
        edges = self.edges.select(F.lit("edge").alias("kind"), "type")
        return nodes.unionByName(edges).groupBy("kind", "type").agg(F.count("*").alias("n"))

    def collect_nodes(self) -> list[Node]:
        """All nodes by id, on the driver: for small graphs and sinks."""
        return [as_node(r) for r in self.nodes.orderBy("id").toLocalIterator()]

    def collect_edges(self) -> list[Edge]:
        return [as_edge(r) for r in self.edges.orderBy("id").toLocalIterator()]

    def to_networkx(self):
        """A copy as a networkx multigraph, where that library is there."""
        try:
            import networkx
        except ImportError as missing:
            raise ImportError("to_networkx needs networkx; collect_nodes and collect_edges give the same elements") from missing
        out = networkx.MultiDiGraph()
        for n in self.collect_nodes():
            out.add_node(n.id, types=n.types, attributes=dict(n.attributes))
        for e in self.collect_edges():
            out.add_edge(e.source, e.target, key=e.id, type=e.type, attributes=dict(e.attributes))
        return out

    def write(self, path: str) -> None:
        """Parquet below ``path``, edges partitioned by type."""
        self.nodes.write.parquet(f"{path}/nodes")
        self.edges.write.partitionBy("type").parquet(f"{path}/edges")
        self.evidence.write.parquet(f"{path}/evidence")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Graph:
        edges = spark.read.schema("id string, source string, target string, attributes map<string,string>, type string").parquet(f"{path}/edges")
        return cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), edges, spark.read.schema(EVIDENCE_TABLE).parquet(f"{path}/evidence"))


def loaded(attributes: Mapping[str, str]) -> dict[str, Any]:
    return {k: json.loads(v) for k, v in (attributes or {}).items()}


def as_node(row) -> Node:
    return Node(row["id"], tuple(row["types"]), loaded(row["attributes"]))


def as_edge(row) -> Edge:
    return Edge(row["id"], row["source"], row["target"], row["type"], loaded(row["attributes"]))
