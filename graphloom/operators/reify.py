"""Edges into nodes and back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..spec import EdgeType, GraphSpec, NodeType
from ..storage import stored


def connector_types(type: str) -> tuple[str, str]:
    return f"{type}_subject", f"{type}_object"


def reified_spec(spec: GraphSpec, edge_type: str) -> GraphSpec:
    """The grammar with the edge type as a node type and its two connectors."""
    own = spec.edge_type(edge_type)
    if own is None:
        raise ValueError(f"{edge_type!r} is no edge type")
    subject, object = connector_types(edge_type)
    taken = {t.id for t in spec.iter_element_types()} & {subject, object}
    if taken:
        raise ValueError(f"types {sorted(taken)} exist already")
    node = NodeType(own.id, own.description, own.is_a, own.mixins, own.attributes, own.abstract)
    ends = (EdgeType(subject, subject_type=edge_type, object_type=own.subject_type), EdgeType(object, subject_type=edge_type, object_type=own.object_type))
    return replace(spec, node_types=(*spec.node_types, node), edge_types=(*(e for e in spec.edge_types if e.id != edge_type), *ends), _by_id={})


def _written(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, written once: the check and the result read these and not what they are made from."""
    return stored(graph.nodes, "nodes"), stored(graph.edges, "edges")


def reify(graph: Graph, edge_type: str) -> Graph:
    """Each edge of the type becomes a node with its id, linked to its former ends.

    Refused where a connector's type or a new id is taken. Evidence keeps its ids.
    """
    old_nodes, old_edges = _written(graph)
    own, others = old_edges.where(F.col("type") == edge_type), old_edges.where(F.col("type") != edge_type)
    subject, object = connector_types(edge_type)
    nodes = old_nodes.unionByName(own.select("id", F.array(F.lit(edge_type)).alias("types"), "attributes"))
    empty = F.create_map().cast("map<string,string>").alias("attributes")
    ends = [own.select(F.concat(F.lit(f"{t}:"), "id").alias("id"), F.col("id").alias("source"), F.col(end).alias("target"), F.lit(t).alias("type"), empty) for t, end in ((subject, "source"), (object, "target"))]
    edges = others.unionByName(ends[0]).unionByName(ends[1])
    # one aggregation over all ids tells whether any is taken twice
    typed = others.select(F.lit("edge").alias("kind"), "id", F.col("type").isin(subject, object).alias("typed"))
    claims = typed.unionByName(ends[0].unionByName(ends[1]).select(F.lit("edge").alias("kind"), "id", F.lit(False).alias("typed"))).unionByName(nodes.select(F.lit("node").alias("kind"), "id", F.lit(False).alias("typed")))
    clash = claims.groupBy("kind", "id").agg(F.count("*").alias("n"), F.max("typed").alias("typed")).where("n > 1 or typed").agg(F.max("typed").alias("typed"), F.min_by("kind", F.struct(F.col("kind") != "node", "id")).alias("kind"), F.min(F.struct(F.col("kind") != "node", "id"))["id"].alias("id")).first()
    if clash["typed"]:
        raise ValueError(f"the graph has edges of type {subject!r} or {object!r} already")
    if clash["kind"] == "node":
        raise ValueError(f"edge {clash['id']!r} cannot become a node: there is one with its id")
    if clash["kind"] == "edge":
        raise ValueError(f"edge id {clash['id']!r} is taken")
    return Graph(nodes, edges, graph.evidence, dict(graph.reports))


def unreify(graph: Graph, edge_type: str) -> Graph:
    """Nodes of the type that have both connectors become edges again; other nodes stay.

    Of several connectors of one kind the one with the largest id counts. The
    others would hang in the air, which is refused.
    """
    subject, object = connector_types(edge_type)
    old_nodes, old_edges = _written(graph)
    # both ends of a node in one aggregation: the connector with the largest id of each kind, and how many edges it has in all
    kind = lambda t, c: F.when(F.col("type") == t, F.col(c))
    ends = old_edges.where(F.col("type").isin(subject, object)).groupBy(F.col("source").alias("id")).agg(
        F.max_by(kind(subject, "target"), kind(subject, "id")).alias("source"), F.max(kind(subject, "id")).alias("source_edge"), F.max_by(kind(object, "target"), kind(object, "id")).alias("target"), F.max(kind(object, "id")).alias("target_edge")
    )
    own = stored(old_nodes.where(F.array_contains("types", edge_type)).join(ends.where("source_edge is not null and target_edge is not null"), "id"), "own")
    made = own.select("id", "source", "target", F.lit(edge_type).alias("type"), "attributes")
    gone = own.select(F.explode(F.array("source_edge", "target_edge")).alias("id"))
    nodes = old_nodes.join(own.select("id"), "id", "left_anti")
    rest = old_edges.join(gone, "id", "left_anti")
    touched = rest.select("id", F.explode(F.array("source", "target")).alias("_id"))
    hanging = touched.join(own.select(F.col("id").alias("_id")), "_id", "left_semi").first()
    if hanging:
        raise ValueError(f"edge {hanging['id']!r} ends at a node that becomes an edge")
    return Graph(nodes, rest.unionByName(made), graph.evidence, dict(graph.reports))
