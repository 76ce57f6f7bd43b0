"""Graphs compared without bringing them together: sums of hashes of canonical elements.

An element's canonical text has sorted keys and its values as JSON. The digest of
a graph is, for each kind, the number of elements and four sums of 60 bits of
their SHA-256; it does not depend on order or partitions, and digests of disjoint
parts add up to that of the whole.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from .rows import edge_fields, json_object, node_fields, quoted

SUMS = 4


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sorted(values: pd.Series) -> pd.Series:
    return values.map(lambda own: None if own is None else [json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False) for v in own])


def _canonical(attributes: Column) -> Column:
    """Attribute values whose inner keys are sorted; only elements that have lists or objects go through Python."""
    values = F.map_values(attributes)
    inner = F.exists(values, lambda v: v.startswith("{") | v.startswith("["))
    return F.map_from_arrays(F.map_keys(attributes), F.coalesce(_sorted(F.when(inner, values)), values))


def element_texts(graph: Graph, evidence: bool = False) -> DataFrame:
    """``kind, text``: each element's canonical text; ``evidence`` adds the rows that say where elements come from."""
    own = lambda elements: elements.withColumn("attributes", _canonical(F.col("attributes")))
    nodes = own(graph.nodes).select(F.lit("node").alias("kind"), json_object(node_fields("id", "types", "attributes")).alias("text"))
    edges = own(graph.edges).select(F.lit("edge").alias("kind"), json_object(edge_fields("id", "source", "target", "type", "attributes")).alias("text"))
    out = nodes.unionByName(edges)
    if evidence:
        told = json_object({"element_id": quoted(F.col("element_id")), "attribute": F.coalesce(quoted(F.col("attribute")), F.lit("null")), "evidence": F.coalesce(F.to_json("evidence"), F.lit("null"))})
        out = out.unionByName(graph.evidence.select(F.lit("evidence").alias("kind"), told.alias("text")))
    return out


def graph_digest(graph: Graph, evidence: bool = False) -> DataFrame:
    """``kind, n, digest``: a row for each kind that has elements."""
    hashed = element_texts(graph, evidence).select("kind", F.sha2("text", 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(SUMS)]
    sums = F.concat_ws(":", *(F.sum(p).cast("decimal(38,0)").cast("string") for p in parts))
    return hashed.groupBy("kind").agg(F.count("*").alias("n"), sums.alias("digest"))


def merged_digests(digests: DataFrame) -> DataFrame:
    """Digests of disjoint parts of a graph, added up."""
    part = lambda k: F.sum(F.get(F.split("digest", ":"), F.lit(k)).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string")
    return digests.groupBy("kind").agg(F.sum("n").alias("n"), F.concat_ws(":", *(part(k) for k in range(SUMS))).alias("digest"))


def same_graph(a: Graph, b: Graph, evidence: bool = False) -> bool:
    """Whether two graphs have the same elements; the driver sees a row for each kind."""
    found = [{tuple(r) for r in graph_digest(g, evidence).collect()} for g in (a, b)]
    return found[0] == found[1]
