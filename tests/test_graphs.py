"""Validation, verification, resolution, reshaping, tracing and sinks."""

import json

import pytest
from pyspark.sql import functions as F

import coast
import graphloom as g
from graphloom.operators.trace import reanchored, spans_at, spans_overlapping
from graphloom.operators.validation import validate_attributes, validate_spec
from graphloom.operators.verify import greedy_pairs, parse_judgement
from graphloom.sinks import embedding_rows, typed_view
from graphloom.spec import to_struct_type
from graphloom.streaming import KeyedMerge


@pytest.fixture(scope="module")
def graph(spark):
    return g.extract(coast.sources(), coast.SPEC, coast.BINDINGS, spark=spark, on_missing_binding="skip")


def issues(spark, spec, nodes, edges=()):
    # built directly, since assembly would refuse some of these
    from graphloom.graph import EDGES, NODES, attribute_map

    n = spark.createDataFrame([(i, list(t), attribute_map(a)) for i, t, a in nodes], NODES)
    e = spark.createDataFrame([(*x[:4], attribute_map(x[4])) for x in edges], EDGES)
    return sorted((r["element_id"], r["code"]) for r in g.validate_graph(g.Graph(n, e), spec).collect())


def test_grammar():
    spec = g.GraphSpec((g.NodeType("a", attributes=(g.AttrSchema("x"), g.AttrSchema("y"))), g.NodeType("m", attributes=(g.AttrSchema("y", "integer"),)), g.NodeType("b", is_a="a", mixins=("m",), attributes=(g.AttrSchema("z", multivalued=True),))))
    assert {k: v.range for k, v in g.effective_attributes(spec, "b").items()} == {"x": "string", "y": "integer", "z": "string"}
    assert spec.is_subtype("b", "m") and spec.is_subtype("b", "b") and not spec.is_subtype("a", "b")
    assert to_struct_type(spec, "b").simpleString() == "struct<x:string,y:bigint,z:array<string>>"
    loop = g.GraphSpec((g.NodeType("p", is_a="q"), g.NodeType("q", is_a="p")))
    assert loop.is_subtype("p", "q") and g.effective_attributes(loop, "p") == {}


def test_linkml_and_schemas():
    assert g.load_linkml(g.to_linkml(coast.SPEC)) == g.GraphSpec(coast.SPEC.node_types, coast.SPEC.edge_types, coast.SPEC.enums, id="coast")
    defs = g.generate_json_schema(coast.SPEC)["$defs"]
    assert defs["saw"]["properties"]["bearing"] == {"type": "integer", "minimum": 0, "maximum": 359} and defs["lamp"]["properties"]["colour"] == {"enum": ["white", "red", "green"]}
    models = g.generate_pydantic(coast.SPEC)
    assert models["vessel"](tons=7, rig="brig").rig == "brig"
    with pytest.raises(ValueError):
        models["vessel"](tons=7, rig="Brig 2")


def test_validation_codes(spark):
    spec = g.GraphSpec(
        (g.NodeType("n", attributes=(g.AttrSchema("r", required=True), g.AttrSchema("i", "integer", minimum=0, maximum=9), g.AttrSchema("l", "decimal", multivalued=True, minimum=1), g.AttrSchema("e", enum=("u", "v")), g.AttrSchema("p", pattern="b+"), g.AttrSchema("o", "mystery"), g.AttrSchema("d", "date"))), g.NodeType("k", is_a="nowhere")),
        (g.EdgeType("e", subject_type="n", object_type="k"), g.EdgeType("f", subject_type="none")),
    )
    assert [(i.element_id, i.code) for i in validate_spec(spec)] == [("f", "unknown-endpoint-type"), ("k", "unknown-parent-type")]
    own = [("f", "unknown-endpoint-type"), ("k", "unknown-parent-type")]
    nodes = [
        ("1", ("n",), {"r": None, "i": True, "l": [1, 2.5], "e": "u", "p": "abbc", "o": {"x": 1}, "extra": 1, "d": "not a day"}),
        ("2", ("n",), {"i": 10, "l": 5, "e": "w", "p": "x", "d": 3}),
        ("3", ("n", "k"), {"r": "x", "i": "4", "l": [0.5, "z"]}),
        ("4", (), {}),
        ("5", ("zzz",), {}),
        ("6", ("k",), {}),
    ]
    edges = [("a", "1", "6", "e", {}), ("b", "6", "1", "e", {}), ("c", "1", "99", "e", {}), ("d", "1", "6", "x", {})]
    want = own + [("1", "range-type"), ("2", "missing-required"), ("2", "maximum"), ("2", "not-multivalued"), ("2", "enum"), ("2", "pattern"), ("2", "range-type")]
    want += [("3", "range-type"), ("3", "minimum"), ("3", "range-type"), ("4", "untyped"), ("5", "unknown-type"), ("b", "endpoint-type"), ("b", "endpoint-type"), ("c", "missing-endpoint"), ("d", "unknown-type")]
    assert issues(spark, spec, nodes, edges) == sorted(want)
    assert [i.code for i in validate_attributes(spark, "n", {"r": "x", "i": -1}, spec)] == ["minimum"]
    with pytest.raises(g.GraphValidationError):
        g.validate_graph(g.Graph.of(spark, [g.Node("4", ("q",))]), spec, raise_on_error=True)


def test_graph_match(spark, graph):
    same = g.from_canonical_json(spark, g.to_canonical_json(graph))
    assert g.GraphMatch(coast.SPEC)(graph, same).score == 1.0
    doc = g.to_canonical_dict(graph)
    doc["nodes"]["keeper:mara-voss"]["attributes"]["name"] = "  MARA   voss "
    assert g.GraphMatch(coast.SPEC)(graph, g.from_canonical_dict(spark, doc)).score == 1.0
    next(e for e in doc["edges"] if e["type"] == "saw")["attributes"]["bearing"] = 1
    worse = g.GraphMatch(coast.SPEC)(graph, g.from_canonical_dict(spark, doc))
    assert 0.9 < worse.score < 1.0 and worse.details["nodes"]["f1"] == 1.0
    empty = g.Graph.of(spark)
    assert g.GraphMatch()(empty, empty).score == 1.0 and g.GraphMatch()(empty, graph).score == 0.0
    strict = g.GraphMatch(coast.SPEC, {("saw", "bearing"): lambda a, e, context=None: g.Verdict(0.0, False)})(graph, same)
    assert strict.details["attributes"]["score"] < 1
    assert greedy_pairs([{"a": "1"}, {"a": "2", "b": "3"}], [{"a": "2", "b": "3"}, {"a": "9"}]) == {2: 1, 0: 1}


def test_parallel_edges_short_by_one(spark):
    nodes = [g.Node("x", ("t",)), g.Node("y", ("t",))]
    many = g.Graph.of(spark, nodes, [g.Edge(f"e{i}", "x", "y", "r", {"v": i}) for i in range(3)])
    few = g.Graph.of(spark, nodes, [g.Edge(f"f{i}", "x", "y", "r", {"v": i}) for i in (1, 2)])
    got = g.GraphMatch()(few, many)
    assert got.details["edges"] == {"precision": 1.0, "recall": 2 / 3, "f1": 0.8} and got.details["attributes"] == {"score": 1.0, "compared": 2}


def test_verifiers():
    v = g.build_verifier
    assert v("exact")(1, 1.0).passed and not v("exact")("1", 1).passed
    assert v("normalized")(" A  b", "a B").passed and v("numeric_tolerance", abs_tol=1)("10.5", 10).passed and not v("numeric_tolerance")("x", 1).passed and not v("numeric_tolerance")(float("nan"), 1).passed
    assert v("set_match")([1, 2], [2, 3]).score == 0.5 and v("set_match")([], []).score == 1.0
    assert v("predicate", predicate=lambda x: x > 3)(4, None).passed
    assert v("semantic_similarity")("same text", "same text").score == 1.0
    assert v("semantic_similarity", embedder=lambda t: [len(t), 1.0])("ab", "cd").score == pytest.approx(1.0)
    assert v("composite", components=[(v("exact"), 3), (v("normalized"), 1)])("A", "a").score == 0.25
    judge = lambda prompt: 'Sure: {"score": 1.7, "reason": "a {brace} \\" in it"} done'
    assert v("llm_rubric", rubric="same?", judge=judge)(1, 2) == g.Verdict(1.0, True, 'a {brace} " in it')
    with pytest.raises(ValueError, match="judge"):
        v("llm_rubric")(1, 2)
    for bad in ("no", "{}", {"score": "high"}):
        with pytest.raises(ValueError):
            parse_judgement(bad)
    with pytest.raises(KeyError, match="exact"):
        v("none")
    with pytest.raises(ValueError):
        g.register_verifier("exact")(object)
    assert g.schema_description_verifier(coast.SPEC, "saw", "bearing", judge)(1, 1).passed
    assert len(g.available_verifiers()) == 10 and len(g.available_extractors()) == 8


def test_evaluation(spark, graph):
    expected = g.from_canonical_json(spark, g.to_canonical_json(graph))
    cases = [g.CorpusCase("right", coast.sources(), coast.SPEC, coast.BINDINGS, expected), g.CorpusCase("nothing", "no text", coast.SPEC, None, expected)]
    got = g.evaluate_corpus(cases)
    assert got.mean_score == 0.5 and got.pass_rate == 0.5 and got.summary()["cases"]["right"] == {"score": 1.0, "passed": True}
    assert g.evaluate_corpus([]).mean_score == 1.0


def donors(spark):
    nodes = [g.Node("d:1", ("donor",), {"name": "Acme Inc", "a": 1}), g.Node("d:2", ("donor",), {"name": "The ACME", "a": 2, "b": 3}), g.Node("p", ("project",), {"name": "acme"}), g.Node("d:3", ("donor",), {"name": "The"}), g.Node("d:4", ("donor",), {"name": "Dr."}), g.Node("d:5", ("donor",), {})]
    return g.Graph.of(spark, nodes, [g.Edge("e1", "d:1", "p", "funds"), g.Edge("e2", "d:2", "p", "funds"), g.Edge("e3", "d:1", "d:2", "twin")])


def test_normalised_names_resolve(spark):
    got = g.resolve_graph(donors(spark), g.NormalizeResolver())
    assert {n.id: n.attributes for n in got.collect_nodes()} == {"donor:acme": {"name": "Acme Inc", "a": 1, "b": 3}, "project:acme": {"name": "acme"}, "donor:d-3": {"name": "The"}, "d:5": {}}
    assert {(e.id, e.source, e.target) for e in got.collect_edges()} == {("e1", "donor:acme", "project:acme"), ("e2", "donor:acme", "project:acme"), ("e3", "donor:acme", "donor:acme")}
    assert {r["canonical"]: r["members"] for r in got.reports["merges"].collect()} == {"donor:acme": ["d:1", "d:2"], "donor:d-3": ["d:3", "d:4"]}


def test_registry_judge_and_cascade(spark):
    by_registry = g.resolve_graph(donors(spark), g.RegistryResolver({"Acme Inc": "org:1", "acme": "org:1"}))
    assert {n.id for n in by_registry.collect_nodes()} == {"org:1", "d:3", "d:4", "d:5"}  # both types meet in one id
    assert by_registry.node("org:1").types == ("donor", "project")
    judged = g.resolve_graph(donors(spark), g.LLMResolver(lambda a, b: {a, b} == {"Acme Inc", "Dr."}))
    assert {n.id for n in judged.collect_nodes()} == {"d:1", "d:2", "d:3", "d:5", "p"}
    both = g.resolve_graph(donors(spark), g.CascadeResolver([g.NormalizeResolver(aliases={"The": "acme"}), g.LLMResolver(lambda a, b: {a, b} == {"Acme Inc", "Dr."})]))
    assert {n.id for n in both.collect_nodes()} == {"donor:acme", "project:acme", "d:5"}


def test_reify_round_trip(spark, graph):
    there = g.reify(graph, "saw")
    assert there.node("saw:light-gull-rock->vessel-amalia:0").attributes["far"] == 3.5
    assert there.edges_of_type("saw_subject").count() == 3
    assert g.to_canonical_json(g.unreify(there, "saw")) == g.to_canonical_json(graph)
    with pytest.raises(ValueError, match="saw_subject"):
        g.reify(g.Graph(there.nodes, there.edges.unionByName(graph.edges_of_type("saw"))), "saw")
    clash = g.Graph.of(spark, [g.Node("x", ("t",))], [g.Edge("x", "x", "x", "r")])
    with pytest.raises(ValueError, match="'x'"):
        g.reify(clash, "r")


def test_traces(spark, graph):
    index = g.TraceIndex(graph.evidence)
    at = coast.LOG.index("1880")
    found = index.at(spark.createDataFrame([("log", at), ("log", 0), ("other", at)], "source_id string, offset long"))
    assert [r["element_id"] for r in found.collect()] == ["light:cape-sorrow"]
    cell = index.in_cell(spark.createDataFrame([("vessels", 0, "vessel")], "source_id string, row long, column string"))
    assert {r["element_id"] for r in cell.collect()} == {"vessel:amalia"}
    spans = spark.createDataFrame([("d", "a", 10, 20), ("d", "b", 30, 45), ("d", "c", 0, 20000)], "source_id string, element_id string, start long, end long")
    probes = spark.createDataFrame([("d", 9), ("d", 10), ("d", 19), ("d", 20), ("d", 19999)], "source_id string, offset long")
    assert sorted((r["offset"], r["element_id"]) for r in spans_at(spans, probes).collect() if r["element_id"] != "c") == [(10, "a"), (19, "a")] and spans_at(spans, probes).where("element_id = 'c'").count() == 5
    ranges = spark.createDataFrame([("d", 20, 30), ("d", 19, 31), ("d", 4000, 9000)], "source_id string, from long, to long")
    assert sorted((r["from"], r["element_id"]) for r in spans_overlapping(spans, ranges).collect()) == [(19, "a"), (19, "b"), (19, "c"), (20, "c"), (4000, "c")]
    own = g.set_attribute_evidence(graph.evidence, "light:gull-rock", "name", g.Evidence(g.Provenance("hand", "typed", attributed_kind="person")))
    wanted = spark.createDataFrame([("light:gull-rock", "name"), ("light:gull-rock", "year"), ("none", "x")], "element_id string, attribute string")
    got = {(r[0], r[1]): r[2] and r[2]["provenance"]["derived_from"] for r in g.attribute_evidence(wanted, own).collect()}
    assert got == {("light:gull-rock", "name"): "hand", ("light:gull-rock", "year"): "log", ("none", "x"): None}


def test_anchors(spark):
    q = g.TextQuoteSelector("the cat", "saw ", " sat")
    assert g.reanchor(q, "I the cat x. We saw the cat sat.") == g.TextPositionSelector(20, 27)
    assert g.reanchor(g.TextQuoteSelector("ab"), "ab ab ab", hint=6).start == 6
    assert g.reanchor(g.TextQuoteSelector("fundamental"), "a fundamentxl b").end == 11 and g.reanchor(g.TextQuoteSelector("fundamental"), "nothing") is None and g.reanchor(g.TextQuoteSelector(""), "x") is None
    assert g.verify_anchor(g.TextQuoteSelector("b"), "abc") and not g.verify_anchor(g.TextQuoteSelector(""), "abc")
    rows = spark.createDataFrame([("the cat", "saw ", " sat", "x the cat", None), ("ab", "", "", "ab ab", 3), ("zzz", "", "", "a", None)], "exact string, prefix string, suffix string, text string, hint long")
    assert sorted((r["exact"], r["start"], r["end"]) for r in reanchored(rows).collect()) == [("ab", 3, 5), ("the cat", 2, 9), ("zzz", None, None)]


def test_canonical_json(spark, graph):
    text = g.to_canonical_json(graph, spec=coast.SPEC)
    doc = json.loads(text)
    assert doc["spec"] == {"id": "coast", "version": "1"} and list(doc["nodes"]) == sorted(doc["nodes"])
    assert g.to_canonical_json(g.from_canonical_json(spark, text), spec=coast.SPEC) == text
    for wrong in ([], {**doc, "nodes": []}, {**doc, "more": 1}, {**doc, "edges": [{"id": "x"}]}, {**doc, "nodes": {"x": {"types": [1], "attributes": {}}}}):
        with pytest.raises(ValueError):
            g.validate_canonical(wrong)
    odd = g.Graph.of(spark, [g.Node("n", ("t",), {"x": float("nan"), "big": 1e20, "u": "é\U0001f600"})])
    with pytest.raises(ValueError):
        g.to_canonical_json(odd)
    assert g.Graph.of(spark, [g.Node("n", ("t",), {"big": 1e20})]).node("n").attributes["big"] == 1e20


def hostile(spark):
    nodes = [g.Node("b\"1", ("t", "u"), {'x"y<z&': "v", "id": "other", "n": 2, "f": 1.5, "ok": True}), g.Node("a:2", ("t",), {})]
    return g.Graph.of(spark, nodes, [g.Edge("e", "a:2", "b\"1", "rel", {"w": None, "s": "li\nne"})])


def test_views(spark):
    graph = hostile(spark)
    assert g.to_node_edge_records(graph)["nodes"][1]["id"] == "other"
    assert g.to_table(graph, "rel") == [{"id": "e", "source": "a:2", "target": "b\"1", "w": None, "s": "li\nne"}] and len(g.to_table(graph, "t")) == 2 and g.to_table(graph, "zz") == []
    assert g.to_dot(graph).splitlines()[2:5] == ['  "a:2" [label="a:2"];', '  "b"1" [label="b 1"];', '  "a:2" -> "b"1" [label="rel"];']
    assert g.to_mermaid(graph, label_attr="n").splitlines() == ["flowchart LR", '  n0["a:2"]', '  n1["2"]', "  n0 -->|rel| n1"]
    assert g.to_cytoscape(graph)["elements"]["edges"][0]["data"]["type"] == "rel"
    records = g.to_embedding_records(graph)
    assert records[0]["text"] == "t" and records[1]["text"] == "t: f=1.5; id=other; n=2; ok=True; x\"y<z&=v" and records[2]["text"] == "a:2 rel b\"1 (s=li\nne; w=None)"
    assert {r["id"]: r["text"] for r in embedding_rows(graph).collect()}["e"] == "a:2 rel b\"1 (s=li\nne; w=None)"
    spec = g.GraphSpec((g.NodeType("t", attributes=(g.AttrSchema("n", "integer"), g.AttrSchema("ok", "boolean"))),))
    assert [tuple(r) for r in typed_view(graph, spec, "t").orderBy("id").collect()] == [("a:2", None, None), ("b\"1", 2, True)]


def test_exports(spark):
    import xml.etree.ElementTree as ET

    graph = hostile(spark)
    root = ET.fromstring(g.to_graphml(graph).encode())
    assert len(root.findall(".//{*}key")) == 9 and root.find(".//{*}edge").get("target") == "b\"1"
    assert g.to_jgf(graph)["graph"]["nodes"]["a:2"] == {"label": "t", "metadata": {"types": ["t"]}}
    statements = g.to_cypher(graph)
    assert all("b\"1" not in s for s, _ in statements) and statements[2][1]["props"] == {"w": None, "s": "li\nne"}
    turtle = g.to_turtle(graph).splitlines()
    assert "g:a_2 rdf:type g:t ." in turtle and "<< g:a_2 g:rel g:b_1 >> g:s \"li\\nne\" ." in turtle and "g:b_1 g:ok true ." in turtle


def test_annotations():
    note = g.Annotation("n1", ("p", "title"), "check", provenance=g.Provenance("x", "y", attributed_kind="person"))
    assert note.target_element_id() == "p" and note.to_dict()["target"] == ["p", "title"] and note.provenance.is_manual
    place = g.Selection("s1", "doc", g.TextPositionSelector(1, 2, "doc"))
    assert g.Annotation("n2", place, "b").to_dict()["target"]["selector"] == {"type": "TextPositionSelector", "start": 1, "end": 2, "source": "doc"}
    assert g.AnnotatedGraph(None, [note]).annotations_for("p") == [note]
    record = g.Evidence(g.Provenance("a", "b"), (g.TextQuoteSelector("q"),), g.Confidence("m", 0.5))
    assert record.to_dict() == {"provenance": {"derived_from": "a", "generated_by": "b"}, "grounding": [{"type": "TextQuoteSelector", "exact": "q", "prefix": "", "suffix": ""}], "confidence": {"method": "m", "score": 0.5, "review_status": "auto"}}


def test_written_graphs_and_streams(spark, graph, tmp_path):
    graph.write(f"{tmp_path}/g")
    assert g.to_canonical_json(g.Graph.read(spark, f"{tmp_path}/g")) == g.to_canonical_json(graph)
    spark.createDataFrame([("a", "1"), ("b", "2")], "id string, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    made = lambda batch: batch.select("id", F.array(F.lit("t")).alias("types"), F.create_map(F.lit("v"), "v").alias("attributes"), F.lit(0).alias("seq"))
    sink = KeyedMerge(f"{tmp_path}/nodes", made)

    def run():
        query = spark.readStream.schema("id string, v string").parquet(f"{tmp_path}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    spark.createDataFrame([("b", "3"), ("c", "4")], "id string, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {r["id"]: r["attributes"]["v"] for r in sink.current(spark).collect()} == {"a": "1", "b": "3", "c": "4"}
    sink(spark.createDataFrame([("a", "9")], "id string, v string"), 1)  # a batch that runs again
    assert sink.current(spark).count() == 3
