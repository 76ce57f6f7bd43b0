"""Registered queries on whole tables, against brute force over the tables' rows."""

import json
import re
from collections import Counter

import pytest

from graphloom import queries

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def bag(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def trade(spark):
    """Nodes as id to type and attributes, edges as id to source, type and target."""
    slug = lambda name: re.sub("[^a-z0-9]+", "-", name.lower())
    nation = {r["n_nationkey"]: r for r in table(spark, "nation")}
    region = {r["r_regionkey"]: r for r in table(spark, "region")}
    nodes = {f"region:{slug(r['r_name'])}": ("region", {"name": r["r_name"]}) for r in region.values()}
    nodes |= {f"nation:{slug(r['n_name'])}": ("nation", {"name": r["n_name"]}) for r in nation.values()}
    edges = {f"in:{slug(r['n_name'])}": (f"nation:{slug(r['n_name'])}", "in_region", f"region:{slug(region[r['n_regionkey']]['r_name'])}") for r in nation.values()}
    for c in table(spark, "customer"):
        nodes[f"customer:{slug(c['c_name'])}"] = ("customer", {"name": c["c_name"], "balance": c["c_acctbal"], "segment": c["c_mktsegment"], "key": c["c_custkey"]})
        edges[f"located:{c['c_custkey']}"] = (f"customer:{slug(c['c_name'])}", "located_in", f"nation:{slug(nation[c['c_nationkey']]['n_name'])}")
    assert len(nodes) == 180 and len(edges) == 175
    return nodes, edges


def test_cypher_parameters_of_all_elements(spark, trade):
    nodes, edges = trade
    got = {r["id"]: (r["source"], r["target"], json.loads(r["props"])) for r in queries.cypher_parameters(spark, SF).collect()}
    assert got == {i: (None, None, {"types": [t]} | a) for i, (t, a) in nodes.items()} | {i: (s, o, {}) for i, (s, _, o) in edges.items()}


def test_turtle_triples_of_all_elements(spark, trade):
    nodes, edges = trade
    name = lambda x: "g:" + x.replace(":", "_")
    want = [(i, f"{name(i)} rdf:type g:{t} .") for i, (t, _) in nodes.items()]
    want += [(i, f"{name(i)} g:{k} {json.dumps(v)} .") for i, (_, a) in nodes.items() for k, v in a.items()]
    want += [(i, f"{name(s)} g:{t} {name(o)} .") for i, (s, t, o) in edges.items()]
    assert bag(queries.turtle_triples(spark, SF)) == Counter(want)


def test_embedding_records_of_all_elements(spark, trade):
    nodes, edges = trade
    want = [(i, "node", t, f"{t}: " + "; ".join(f"{k}={a[k]}" for k in sorted(a))) for i, (t, a) in nodes.items()]
    want += [(i, "edge", t, f"{s} {t} {o}") for i, (s, t, o) in edges.items()]
    assert bag(queries.embedding_record_rows(spark, SF)) == Counter(want)


def test_evidence_of_all_elements(spark, trade):
    nodes, edges = trade
    source = {"located_in": "located", "in_region": "lies"}
    want = [(i, t, "query:table_map", "deterministic") for i, (t, _) in nodes.items()] + [(i, source[t], "query:table_map", "deterministic") for i, (_, t, _) in edges.items()]
    assert bag(queries.evidence_lookup(spark, SF)) == Counter(want)
