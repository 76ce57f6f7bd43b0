"""Whole documents as sorted part files: the same bytes as the documents on the driver."""

import json
import xml.etree.ElementTree as ET

import pytest

import graphloom as g
from graphloom import queries
from graphloom.graph import Graph
from graphloom.sinks import canonical_document, documents, dot_document, graphml_document, jgf_document, mermaid_document, turtle_document

VALUES = {"s": 'a "b" <c> & é\n\\x', "i": 7, "f": 1.5, "e": 1e22, "yes": True, "none": None, "list": [1, "two", {"k": None}], "map": {"b": 1, "a": [True]}, "types": "shadow"}


@pytest.fixture(scope="module")
def odd(spark):
    nodes = [g.Node('n "1" <x>', ("t",), VALUES), g.Node("a:2", ("t", "u&v"), {}), g.Node("éz", (), {"name": "Zoë"}), g.Node("10", ("t",), {"i": 1}), g.Node("9", ("t",), {"i": 2})]
    edges = [g.Edge("e2", "a:2", "éz", "knows", VALUES), g.Edge("e10", "a:2", "éz", "knows", {}), g.Edge('e"', "9", "9", 'is "it"', {"w": -2})]
    return Graph.of(spark, nodes, edges)


def written(spark, document, path):
    document.write(str(path))
    return documents.read(spark, str(path))


def test_canonical_parts_are_the_drivers_bytes(spark, odd, tmp_path):
    spec = g.GraphSpec(id="s", version="2")
    for k, (graph, own) in enumerate([(odd, None), (odd, spec), (Graph.of(spark), None), (Graph.of(spark, [g.Node("only", ("t",), {})]), None)]):
        assert written(spark, canonical_document(graph, spec=own), tmp_path / str(k)) == g.to_canonical_json(graph, spec=own) + "\n"


def test_canonical_document_of_a_large_graph(spark, tmp_path):
    graph = queries.trade_graph(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text = written(spark, canonical_document(graph), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert text == g.to_canonical_json(graph) + "\n"
    found = documents.parts(spark, path)
    assert len(found) > 1 and [at for _, at, _ in found] == [sum(n for _, _, n in found[:k]) for k in range(len(found))] and sum(n for _, _, n in found) == len(text.encode())
    back = g.from_canonical_json(spark, text)
    assert back.number_of_nodes() == graph.number_of_nodes()


def test_every_format_is_its_text(spark, odd, tmp_path):
    made = {"jgf": jgf_document(odd), "graphml": graphml_document(odd), "dot": dot_document(odd, label_attr="s"), "mermaid": mermaid_document(odd), "turtle": turtle_document(odd)}
    for name, document in made.items():
        assert written(spark, document, tmp_path / name) == document.text() + "\n"
    assert made["jgf"].text() == json.dumps(g.to_jgf(odd), sort_keys=True, ensure_ascii=False, indent=2)


def test_jgf_is_of_the_graph(odd):
    got = g.to_jgf(odd)["graph"]
    assert got["directed"] is True and got["nodes"]['n "1" <x>'] == {"label": "t", "metadata": {**VALUES, "types": "shadow"}} and got["nodes"]["éz"] == {"label": "", "metadata": {"types": [], "name": "Zoë"}}
    assert [e["id"] for e in got["edges"]] == ['e"', "e10", "e2"] and got["edges"][2] == {"id": "e2", "source": "a:2", "target": "éz", "relation": "knows", "metadata": VALUES}


def test_graphml_holds_every_value(odd):
    root = ET.fromstring(g.to_graphml(odd).encode())
    of = "{http://graphml.graphdrawing.org/xmlns}"
    keys = {k.get("id"): (k.get("for"), k.get("attr.name")) for k in root.findall(f"{of}key")}
    assert len(keys) == len(set(keys.values()))
    for kind, elements in (("node", odd.collect_nodes()), ("edge", odd.collect_edges())):
        got = {x.get("id"): [(keys[d.get("key")], d.text or "") for d in x.findall(f"{of}data")] for x in root.findall(f"{of}graph/{of}{kind}")}
        for e in elements:
            first = ("types", ",".join(e.types)) if kind == "node" else ("type", e.type)
            assert got[e.id] == [((kind, k), v) for k, v in [first, *((k, str(e.attributes[k])) for k in sorted(e.attributes))]]


def test_drawings_and_triples(spark, odd):
    assert g.to_dot(odd).splitlines()[2] == '  "10" [label="10"];' and g.to_dot(odd, label_attr="name").splitlines()[-5] == '  "éz" [label="Zoë"];'
    lines = g.to_mermaid(odd).splitlines()
    assert lines[:3] == ["flowchart LR", '  n0["10"]', '  n1["9"]'] and lines[-3:] == ["  n1 -->|is  it | n1", "  n2 -->|knows| n4", "  n2 -->|knows| n4"]
    turtle = g.to_turtle(odd).splitlines()
    assert "g:a_2 g:knows g:_z ." in turtle and "g:n__1___x_ g:e 1e+22 ." in turtle and "<< g:a_2 g:knows g:_z >> g:list \"[1, 'two', {'k': None}]\" ." in turtle
    assert g.to_turtle(Graph.of(spark)).count("\n") == 3 and g.to_dot(Graph.of(spark)).splitlines()[-1] == "}"


def test_records_and_tables(odd):
    got = g.to_node_edge_records(odd)
    assert [n["id"] for n in got["nodes"]] == ["10", "9", "a:2", 'n "1" <x>', "éz"] and got["nodes"][3] == {"id": 'n "1" <x>', **VALUES}
    assert got["edges"][2] == {"id": "e2", "type": "knows", "source": "a:2", "target": "éz", **VALUES}
    assert [r["id"] for r in g.to_table(odd, "t")] == ["10", "9", "a:2", 'n "1" <x>'] and [r["id"] for r in g.to_table(odd, "knows")] == ["e10", "e2"]
    text = {r["id"]: r["text"] for r in g.to_embedding_records(odd)}
    assert text["e10"] == "a:2 knows éz" and text["éz"] == "node: name=Zoë" and text["e2"].startswith("a:2 knows éz (e=1e+22; f=1.5; i=7; list=[1, 'two', {'k': None}]; map={'b': 1, 'a': [True]}; none=None")
