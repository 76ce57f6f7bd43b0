"""Staged elements into a graph: keyed merge of nodes, endpoint checks of edges, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..evidence import EVIDENCE
from ..functions import same_value
from ..graph import Graph

def staged_order() -> Column:
    """Where a row stands: its step, then its place in it."""
    return F.struct("step", "seq")


def merge_attributes(rows: DataFrame, first: bool = False, order: Column | None = None) -> DataFrame:
    """``id, attributes``: for each key the last value by order, or the first."""
    pick = F.min_by if first else F.max_by
    one = rows.select("id", (staged_order() if order is None else order).alias("ord"), F.explode("attributes").alias("key", "value"))
    by_key = one.groupBy("id", "key").agg(pick("value", "ord").alias("value"))
    return by_key.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attributes"))


def merge_nodes(staged: DataFrame) -> DataFrame:
    """One node an id: types as an ordered union, attributes by their last value."""
    types = staged.select("id", staged_order().alias("ord"), F.posexplode("types").alias("at", "type")).groupBy("id", "type").agg(F.min(F.struct("ord", "at")).alias("ord"))
    listed = types.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type"))), lambda x: x["type"]).alias("types"))
    ids = staged.select("id").distinct()
    merged = ids.join(listed, "id", "left").join(merge_attributes(staged), "id", "left")
    return merged.select("id", F.coalesce("types", F.array().cast("array<string>")).alias("types"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def attribute_conflicts(staged: DataFrame) -> DataFrame:
    """``node, attribute, old, new`` for each value that a later one of the same node replaces by a different one."""
    one = staged.select("id", "step", "seq", F.explode("attributes").alias("attribute", "new"))
    own = Window.partitionBy("id", "attribute").orderBy("step", "seq")
    before = one.withColumn("old", F.lag("new").over(own))
    return before.where(F.col("old").isNotNull() & ~same_value(F.col("old"), F.col("new"))).select(F.col("id").alias("node"), "attribute", "old", "new")


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose endpoints exist."""
    ids = nodes.select(F.col("id").alias("_id"))
    out = edges
    for end in ("source", "target"):
        out = out.join(ids, F.col(end) == F.col("_id"), "left_semi")
    return out


def skipped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint missing, as ``edge, type, source, target, reason``."""
    ids = nodes.select(F.col("id").alias("_id"))
    found = edges.join(ids.withColumnRenamed("_id", "_s"), F.col("source") == F.col("_s"), "left").join(ids.withColumnRenamed("_id", "_t"), F.col("target") == F.col("_t"), "left")
    lost = found.where("_s is null or _t is null")
    return lost.select(F.col("id").alias("edge"), "type", "source", "target", F.lit("missing-endpoint").alias("reason"))


def latest_evidence(staged: DataFrame) -> DataFrame:
    """The last evidence of each element that has any."""
    known = staged.where("evidence is not null").select("id", "evidence", staged_order().alias("ord"))
    last = known.groupBy("id").agg(F.max_by("evidence", "ord").alias("evidence"))
    return last.select(F.col("id").alias("element_id"), F.lit(None).cast("string").alias("attribute"), F.col("evidence").cast(EVIDENCE).alias("evidence"))


def assemble(nodes: DataFrame, edges: DataFrame, dangling: str = "report", reports: dict | None = None) -> Graph:
    """A graph of staged nodes and edges.

    Edges without an endpoint are left out and reported (``dangling="raise"``
    refuses them). Two edges that stay and share an id are an error, found by
    one aggregation before this returns.
    """
    merged = merge_nodes(nodes)
    kept, lost = kept_edges(edges, merged), skipped_edges(edges, merged)
    doubled = kept.groupBy("id").count().where("count > 1").first()
    if doubled:
        raise ValueError(f"edge id {doubled['id']!r} occurs {doubled['count']} times")
    if dangling == "raise" and (missing := lost.first()):
        raise ValueError(f"edge {missing['edge']!r} needs nodes {missing['source']!r} and {missing['target']!r}")
    evidence = latest_evidence(nodes).unionByName(latest_evidence(kept))
    return Graph(merged, kept, evidence, {"skipped_edges": lost, "attribute_conflicts": attribute_conflicts(nodes), **(reports or {})})
