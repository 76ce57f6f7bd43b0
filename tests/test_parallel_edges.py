"""Parallel edges paired by levels, against sorting all pairs."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest

import graphloom as g
from graphloom.graph import EDGES, NODES, Graph, attribute_map
from graphloom.operators import verify


def all_pairs(a, e):
    agree = lambda j, i: sum(a[i].get(k) == v for k, v in e[j].items())
    used_a, used_e, out = set(), set(), []
    for _, j, i in sorted((-agree(j, i), j, i) for j in range(len(e)) for i in range(len(a))):
        if i not in used_a and j not in used_e:
            used_a.add(i)
            used_e.add(j)
            out.append((j, i))
    return sorted(out)


@pytest.mark.parametrize("wide", [0, 2, 10])
def test_random_multigraphs(monkeypatch, wide):
    monkeypatch.setattr(verify, "WIDE", wide)
    for seed in range(400):
        draw = random.Random(seed)
        edge = lambda: {k: draw.choice(["1", "2", "null"]) for k in draw.sample("abcd", draw.randint(0, 4))}
        a, e = ([edge() for _ in range(draw.randint(0, 9))] for _ in range(2))
        assert sorted(verify.partners(a, e)) == all_pairs(a, e)


def test_fifty_thousand_parallel_edges():
    draw = random.Random(1)
    edge = lambda k: {"currency": "EUR", "amount": str(draw.randrange(20_000)), "day": str(k % 365)}
    a, e = ([edge(k) for k in range(50_000)] for _ in range(2))
    began = time.perf_counter()
    found = list(verify.partners(a, e))
    assert len(found) == 50_000 == len({j for j, _ in found}) == len({i for _, i in found}) and time.perf_counter() - began < 60


def edges_of_keys(seed, most):
    """Edges of 300 keys as (type, source, target, side, attributes), in order."""
    draw = random.Random(seed)
    edge = lambda: {k: draw.choice(["1", "2"]) for k in draw.sample("abcd", draw.randint(0, most))}
    return [(t, s, t and "z", k, edge()) for t in (None, "t", "u") for s in map(str, range(1000, 1100)) for k in (0, 1) for _ in range(draw.choice([0, 1, 1, 2, 5]))]


@pytest.mark.parametrize("most", [1, 4])
@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_keys_are_paired_in_batches(most, size):
    kinds = pa.schema([("type", pa.string()), ("source", pa.string()), ("target", pa.string()), ("side", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))])
    rows = edges_of_keys(size + most, most)
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows[k : k + size]], kinds) for k in range(0, len(rows), size)]
    got = Counter((r["type"], tuple(sorted(r["actual"])), tuple(sorted(r["expected"]))) for b in verify.paired(batches) for r in b.to_pylist())
    want = Counter()
    for key in {r[:3] for r in rows}:
        a, e = ([r[4] for r in rows if r[:3] == key and r[3] == k] for k in (0, 1))
        want.update((key[0], tuple(sorted(a[i].items())), tuple(sorted(e[j].items()))) for j, i in all_pairs(a, e))
    assert got == want and sum(got.values()) > 200


def test_keys_need_no_call_each(spark):
    """Edges go to Python in batches of many keys, in one pass over them."""
    edges = spark.range(40).selectExpr("concat('e', id) AS id", "concat('x', id % 10) AS source", "'y' AS target", "'pays' AS type", "map('n', cast(id % 3 AS string)) AS attributes")
    graph = Graph(spark.createDataFrame([], NODES), edges)
    rows = g.GraphMatch().attribute_rows(graph, graph)
    assert [r["actual"] == r["expected"] for r in rows.collect()] == [True] * 40
    assert "CoGroup" not in rows._jdf.queryExecution().toString()


def test_graph_match_of_parallel_edges(spark):
    def graph(*amounts):
        nodes = spark.createDataFrame([("x", ["t"], {}), ("y", ["t"], {})], NODES)
        edges = spark.createDataFrame([(f"e{k}", "x", "y", "pays", attribute_map(v)) for k, v in enumerate(amounts)], EDGES)
        return Graph(nodes, edges)

    expected = graph({"n": 1, "c": "a"}, {"n": 2, "c": "a"}, {"n": 3})
    same = graph({"n": 3}, {"n": 2, "c": "a"}, {"n": 1, "c": "a"})
    assert g.GraphMatch()(same, expected).details["attributes"] == {"score": 1.0, "compared": 5}
    less = g.GraphMatch()(graph({"n": 2, "c": "b"}, {"n": 1, "c": "a"}), expected)
    assert less.details["attributes"]["compared"] == 4 and less.details["attributes"]["score"] == pytest.approx(3 / 4)
