"""Digests tell graphs apart, whatever their order and partitions."""

import pytest
from pyspark.sql import functions as F

import graphloom as g
from graphloom.graph import Graph
from graphloom.sinks import graph_digest, merged_digests, same_graph

NODES = [g.Node("a", ("t", "u"), {"n": 1, "m": {"y": [1, {"b": 2, "a": 1}], "x": "é"}}), g.Node("b", (), {}), g.Node('q"', ("t",), {"n": None})]
EDGES = [g.Edge("e", "a", "b", "r", {"w": 1.5}), g.Edge("f", "a", "b", "r", {})]


@pytest.fixture(scope="module")
def own(spark):
    return Graph.of(spark, NODES, EDGES)


def test_order_partitions_and_inner_keys_do_not_matter(spark, own):
    other = Graph.of(spark, [g.Node("a", ("t", "u"), {"m": {"x": "é", "y": [1, {"a": 1, "b": 2}]}, "n": 1}), *reversed(NODES[1:])], reversed(EDGES))
    assert same_graph(own, Graph(other.nodes.repartition(5), other.edges.orderBy(F.desc("id"))))
    rows = {r["kind"]: r["n"] for r in graph_digest(own).collect()}
    assert rows == {"node": 3, "edge": 2} and graph_digest(Graph.of(spark)).collect() == []


@pytest.mark.parametrize(
    "change",
    [
        lambda n, e: (n.where("id <> 'b'"), e.where("false")),
        lambda n, e: (n.withColumn("types", F.reverse("types")), e),
        lambda n, e: (n.withColumn("attributes", F.transform_values("attributes", lambda k, v: F.when(k == "n", F.lit('"1"')).otherwise(v))), e),
        lambda n, e: (n, e.withColumn("source", F.col("target"))),
        lambda n, e: (n, e.unionByName(e.where("id = 'f'"))),
    ],
)
def test_any_change_shows(own, change):
    assert not same_graph(own, Graph(*change(own.nodes, own.edges)))


def test_digests_of_parts_add_up(own):
    halves = [graph_digest(Graph(own.nodes.where(c), own.edges.where("false" if k else "true"))) for k, c in enumerate(("id = 'a'", "id <> 'a'"))]
    assert {tuple(r) for r in merged_digests(halves[0].unionByName(halves[1])).collect()} == {tuple(r) for r in graph_digest(own).collect()}


def test_evidence_counts_where_asked(spark):
    bundle = g.SourceBundle([g.Source("s", [{"k": "1"}], "table"), g.Source("z", [{"k": "1"}], "table")])
    spec = g.GraphSpec((g.NodeType("t"),))
    one, two = (g.extract(bundle, spec, {"t": ("table_map", {"records_source": s, "id_from": "k"})}, spark=spark) for s in ("s", "z"))
    assert same_graph(one, two) and not same_graph(one, two, evidence=True) and same_graph(one, one, evidence=True)
