"""Extraction end to end, strategies and assembly."""

import json

import pytest
from pyspark.sql import functions as F

import coast
import graphloom as g
from graphloom.evidence import is_corrected, is_machine
from graphloom.functions import cast_value, fill_template, json_text, normalize_entity, slug, slug_fast, slug_text
from graphloom.operators.records import check_where, json_records, select_path, where_column


@pytest.fixture(scope="module")
def graph(spark):
    return g.extract(coast.sources(), coast.SPEC, coast.BINDINGS, spark=spark, on_missing_binding="skip")


def test_whole_corpus(graph):
    counts = {(r["kind"], r["type"]): r["n"] for r in graph.counts_by_type().collect()}
    nodes = {"keeper": 2, "light": 2, "vessel": 2, "port": 2, "lamp": 3}
    edges = {"keeps": 2, "saw": 3, "hails_from": 2, "shines_at": 3}
    assert counts == {("node", k): n for k, n in nodes.items()} | {("edge", k): n for k, n in edges.items()}
    assert graph.node("light:cape-sorrow").attributes == {"name": "Cape Sorrow", "year": 1880}
    assert graph.node("vessel:amalia").attributes == {"rig": "brig", "tons": 1150} and graph.node("vessel:petrel").attributes["tons"] == 38.5
    assert graph.edge("saw:light-gull-rock->vessel-amalia:0").attributes == {"time": "18:40", "far": 3.5, "unit": "miles", "bearing": 120}
    assert graph.edge("saw:light-cape-sorrow->vessel-petrel:2").attributes == {"time": "23:50", "far": 1200, "unit": "yards", "bearing": 7}
    assert graph.edge("hails_from:1").target == "port:hythe" and graph.edge("shines_at:1").source == "lamp:gull-rock-red"
    assert graph.edges_between("light:gull-rock", "vessel:amalia").count() == 2
    assert graph.reports["skipped_edges"].isEmpty() and graph.reports["unbound_elements"] == ["craft"]
    assert g.validate_graph(graph, coast.SPEC, raise_on_error=True).isEmpty()


def test_grounding(graph):
    row = graph.evidence.where("element_id = 'keeper:ilse-brandt'").first()["evidence"]
    quote, place = row["grounding"]
    assert coast.LOG[place["start"] : place["end"]] == quote["exact"] == "Ilse Brandt keeps"
    assert coast.LOG[: place["start"]].endswith(quote["prefix"]) and len(quote["prefix"]) == 24
    cell = graph.evidence.where("element_id = 'port:hythe'").first()["evidence"]["grounding"][0]
    assert (cell["source_id"], cell["row"], cell["column"]) == ("vessels", 1, "port")
    assert graph.evidence.where(is_machine(F.col("evidence.provenance")) | is_corrected(F.col("evidence.provenance"))).isEmpty()


def test_order_of_input_rows_does_not_show(spark, graph):
    text = spark.createDataFrame([("log", coast.LOG)], "source_id string, text string").repartition(3)
    vessels = spark.createDataFrame(coast.VESSELS).withColumn("_row", F.when(F.col("rig") == "brig", 0).otherwise(1)).repartition(2)
    bundle = g.SourceBundle([g.Source("log", text), g.Source("vessels", vessels, "table"), g.Source("lamps", coast.LAMPS, "table")])
    again = g.extract(bundle, coast.SPEC, coast.BINDINGS, spark=spark, on_missing_binding="skip")
    assert g.to_canonical_json(again) == g.to_canonical_json(graph)


def test_many_text_sources(spark):
    """The last value wins in the order of the sources, however many there are, and of the texts within one."""
    spec = g.GraphSpec((g.NodeType("w"),))
    bound = {"w": ("regex_node", {"pattern": r"(?P<name>[a-z]+)=(?P<v>\d+)", "id_attribute": "name"})}
    single = [g.Source(f"s{k:02}", f"a={k} b{chr(97 + k)}={k}") for k in range(20)]
    frame = spark.createDataFrame([(f"t{k:03}", f"c={k} d={1000 - k}") for k in range(300)], "source_id string, text string").repartition(5)
    graph = g.extract(g.SourceBundle([*single[:10], g.Source("frame", frame), *single[10:]]), spec, bound, spark=spark)
    assert graph.node("w:a").attributes == {"name": "a", "v": "19"} and graph.number_of_nodes() == 23
    assert graph.node("w:c").attributes["v"] == "299" and graph.node("w:d").attributes["v"] == "701"


def test_json_strategy_over_a_column(spark):
    docs = spark.createDataFrame([(2, '{"l": [{"id": "x", "v": 1}, {"id": "y", "v": 5}]}'), (1, '{"l": [{"id": "z", "v": 9}]}'), (3, None), (4, '{"l": []}')], "_row long, doc string")
    bound = {"n": ("json_query", {"records_source": "j", "select": "l[*]", "where": {"v": {"$gt": 2}}, "column": "doc", "id_from": "id", "attributes": ["v"]})}
    graph = g.extract({"j": g.Source("j", docs, "json")}, g.GraphSpec((g.NodeType("n"),)), bound, spark=spark)
    assert {n.id: n.attributes for n in graph.collect_nodes()} == {"n:z": {"v": 9}, "n:y": {"v": 5}}
    grounding = {r["element_id"]: [s["expression"] for s in r["evidence"]["grounding"]] for r in graph.evidence.collect()}
    assert grounding == {"n:z": ["l[*][0]", "l[*][0]"], "n:y": ["l[*][1]", "l[*][2]"]}


def test_binding_forms_and_errors(spark):
    spec = g.GraphSpec((g.NodeType("a"), g.NodeType("b")))
    one = lambda c: g.Extraction([g.ExtractedNode(f"{t.id}:1", t.id, {"v": 1}) for t in c.element_types])
    for given in ({"*": one}, {"pair": {"elements": ["a", "b", "none"], "extractor": one}}, g.ExtractorBindings([g.ExtractorBinding("a", extractor=one), g.ExtractorBinding("b", "function", {"func": one})])):
        assert {n.id for n in g.extract("x", spec, given, spark=spark).collect_nodes()} == {"a:1", "b:1"}
    assert g.extract("x", spec, {"a": one}, spark=spark, on_missing_binding="skip").reports["unbound_elements"] == ["b"]
    for wrong, error, words in (
        ({"a": ("nothing", {})}, KeyError, "regex_node"),
        ({"a": ("regex_node", {"patern": "x"})}, ValueError, "regex_node"),
        ({"a": ("regex_node", ["x"])}, ValueError, "mapping"),
        ({"a": {}}, ValueError, "no strategy"),
        ({"a": one}, ValueError, r"\['b'\].*llm"),
        ({"a": 3}, TypeError, "'a'"),
    ):
        with pytest.raises(error, match=words):
            g.extract("x", spec, wrong, spark=spark)
    with pytest.raises(ValueError, match="'b'"):
        g.extract("x", spec, {"a": one}, spark=spark, on_missing_binding="error")


def test_assembly(spark):
    made = lambda c: g.Extraction(
        [g.ExtractedNode("x", "a", {"n": 1, "k": "old"}), g.ExtractedNode("x", "b", {"n": 1.0, "k": "new", "m": [1]}), g.ExtractedNode("y", "a")],
        [g.ExtractedEdge("e1", "r", "x", "y"), g.ExtractedEdge("e2", "r", "x", "y"), g.ExtractedEdge("e3", "r", "x", "gone")],
    )
    graph = g.extract("t", g.GraphSpec((g.NodeType("a"),)), {"a": made}, spark=spark)
    assert graph.node("x") == g.Node("x", ("a", "b"), {"n": 1.0, "k": "new", "m": [1]})
    assert [tuple(r) for r in graph.reports["attribute_conflicts"].collect()] == [("x", "k", '"old"', '"new"')]  # 1 and 1.0 agree
    assert [tuple(r) for r in graph.reports["skipped_edges"].collect()] == [("e3", "r", "x", "gone", "missing-endpoint")]
    assert graph.edges_between("x", "y").count() == 2 and graph.edges_between("y", "x").count() == 0
    assert graph.has_node("y") and not graph.has_edge("e3")
    with pytest.raises(KeyError):
        graph.node("z")
    with pytest.raises(ValueError, match="'e1'"):
        g.Graph.of(spark, [g.Node("x", ("a",))], [g.Edge("e1", "x", "x", "r"), g.Edge("e1", "x", "x", "r")])
    with pytest.raises(ValueError, match="'n'"):
        g.Graph.of(spark, [], [g.Edge("e1", "n", "m", "r")])


def test_optional_groups(spark):
    spec = g.GraphSpec((g.NodeType("w"),), (g.EdgeType("e"),))
    nodes = {"w": ("regex_node", {"pattern": r"(?P<word>[a-z]+)(?P<digits>\d+)?", "id_attribute": "digits"})}
    graph = g.extract("ab1 cd", spec, nodes, spark=spark, on_missing_binding="skip")
    assert graph.node("w:1").attributes == {"word": "ab", "digits": "1"} and graph.node("w:none").attributes == {"word": "cd"}
    with pytest.raises(KeyError, match="'no'"):
        g.extract("x", spec, {"e": ("regex_edge", {"pattern": "(?P<a>x)", "source_id_template": "{a}", "target_id_template": "{no}"})}, spark=spark, on_missing_binding="skip")
    with pytest.raises(Exception, match="did not take part"):
        g.extract("ab1 cd", spec, {"e": ("regex_edge", {"pattern": nodes["w"][1]["pattern"], "source_id_template": "w:{word}", "target_id_template": "w:{digits}"})}, spark=spark, on_missing_binding="skip").edges.collect()


def test_sql_strategy(spark):
    rows = [{"code": "A b", "amt": "10"}, {"code": "C", "amt": "7"}, {"code": "D", "amt": None}]
    spec = g.GraphSpec((g.NodeType("n"),))
    run = lambda sql, params=(), source=rows, **m: g.extract({"s": g.Source("s", source, "table")}, spec, {"n": ("sql", {"records_source": "s", "sql": sql, "params": list(params), "id_from": "code", "attributes": ["amt"], **m})}, spark=spark)
    assert [(n.id, n.attributes) for n in run('SELECT "code", amt FROM t WHERE cast(amt AS int) > ?', [8]).collect_nodes()] == [("n:a-b", {"amt": "10"})]
    assert run("SELECT code, amt FROM t", source=[]).nodes.isEmpty()
    with pytest.raises(ValueError, match="query"):
        run("DROP TABLE t")
    with pytest.raises(KeyError, match="code"):
        run("SELECT amt FROM t")
    assert g.extract({"s": g.Source("s", rows, "table")}, spec, {"n": ("table_map", {"records_source": "other"})}, spark=spark).nodes.isEmpty()
    with pytest.raises(ValueError, match="source_template"):
        g.extract({"s": g.Source("s", rows, "table")}, spec, {"n": ("table_map", {"records_source": "s", "kind": "edge"})}, spark=spark)


def test_json_strategy(spark):
    doc = {"items": [{"id": "a", "v": 1}, {"id": "b", "v": 3}, {"id": "c", "v": "4"}, {"id": "d"}, {"id": "e", "v": None}]}
    run = lambda where: g.extract({"j": g.Source("j", doc, "json")}, g.GraphSpec((g.NodeType("n"),)), {"n": ("json_query", {"records_source": "j", "select": "items", "where": where, "id_from": "id", "attributes": ["v"]})}, spark=spark)
    graph = run({"v": {"$gt": 2}})
    assert {n.id: n.attributes for n in graph.collect_nodes()} == {"n:b": {"v": 3}, "n:c": {"v": "4"}}
    grounding = {r["element_id"]: [s["expression"] for s in r["evidence"]["grounding"]] for r in graph.evidence.collect()}
    assert grounding == {"n:b": ["items[0]", "items[1]"], "n:c": ["items[1]", "items[2]"]}  # kept and original place
    assert {n.id for n in run({"v": {"$ne": 1, "$gte": 99}}).collect_nodes()} == {"n:b", "n:c", "n:d", "n:e"}
    assert {n.id for n in run({"v": {"$in": [1.0, 3]}}).collect_nodes()} == {"n:a", "n:b"}
    with pytest.raises(ValueError, match=r"\$in"):
        check_where({"v": {"$in": "abc"}})
    assert select_path({"a": [{"b": 1}, {"b": 2}, {}]}, "a[*].b") == [1, 2] and select_path({"a": 5}, "a") == [5] and select_path({}, "a.b") == [] and select_path({"a": [7, 8]}, "a[-1]") == [8]
    column = spark.createDataFrame([(1, '{"l": [{"k": 1, "s": "x\\"y"}, {"k": 2.5}]}')], "id int, doc string")
    items = json_records(column, "doc", "l[*]").where(where_column({"k": {"$lt": 2}}, F.col("item"))).collect()
    assert [(r["_i"], dict(r["item"])) for r in items] == [(0, {"k": "1", "s": '"x\\"y"'})]


CASTS = [("1,000", "int", 1000), ("3.7", "int", 3), ("$ 4.50", "number", 4.5), ("5e3", "int", 53), ("abc", "int", "abc"), ("2020-01-01", "int", "2020-01-01"), (7.0, "number", 7), (7.5, "int", 7), (True, "int", True), (None, "int", None), (["1", "x", 2], "int", [1, "x", 2]), ({"a": "1"}, "int", {"a": "1"}), ("-.5", "float", -0.5), ("8", "float", 8.0)]


def test_casts(spark):
    for value, to, want in CASTS:
        got = spark.createDataFrame([(json.dumps(value),)], "v string").select(cast_value(F.col("v"), to)).first()[0]
        assert json.loads(got) == want and isinstance(json.loads(got), bool) == isinstance(want, bool), (value, to, got)
    with pytest.raises(ValueError):
        cast_value(F.lit("1"), "date")


SLUGS = {"Hello, World!": "hello-world", "  A--b ": "a-b", "": "x", "!!!": "x", None: "none", "Straße ÉCOLE": "strasse-école", "ﬁn²": "fin2", "日本 語": "日本-語", "a_b": "a-b", "x\ny": "x-y"}


def test_slugs(spark):
    frame = spark.createDataFrame([(k, v) for k, v in SLUGS.items()], "t string, want string")
    for r in frame.select("t", "want", slug(F.col("t")).alias("s"), slug_fast(F.col("t")).alias("f")).collect():
        assert r["s"] == r["want"] == slug_text(r["t"])
        assert r["f"] == r["want"] or not r["t"].isascii()


def test_templates_and_names(spark):
    row = spark.createDataFrame([("Big Co", 5)], "name string, n int")
    assert row.select(fill_template("a:{name}-{n}!", {"name": F.col("name"), "n": F.col("n")})).first()[0] == "a:big-co-5!"
    with pytest.raises(KeyError, match="'z'.*name"):
        fill_template("{z}", {"name": F.col("name")})
    assert row.select(json_text(F.col("name")), json_text(F.col("n")), json_text(F.lit(None).cast("string"))).first() == ('"Big Co"', "5", "null")
    names = {"The ACME Corp.": "acme", "Dr. Who": "who", "The": "", "a_b GmbH & Co": "a_b", "Éclair SA": "éclair"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in names], "t string").select("t", normalize_entity(F.col("t"))).collect()} == names


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="'a'"):
        g.SourceBundle([g.Source("a", "1"), g.Source("a", "2")])
    assert g.coerce_sources("t").get("source").content == "t" and len(g.coerce_sources(["a", "b"])) == 2 and g.coerce_sources({"j": {"x": 1}}).get("j").kind == "json"
    files = {"a.TXT": "é text", "b.md": "# B", "c.csv": 'x,y\n1,"p\nq"\n\n2\n3,4,5\n', "d.tsv": "x\ty\n1\t2\n", "e.json": '{"k": [1]}', "f.html": "<html><head><title>no</title></head><body><nav>menu</nav><h1>Head</h1><p>One <b>two</b>.</p><ul><li>item</li></ul><script>x()</script></body></html>"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    bundle = g.ingest_paths(spark, [f"{tmp_path}/{n}" for n in files])
    got = {s.id: s.content for s in bundle}
    assert got == {"a": "é text", "b": "# B", "c": [{"x": "1", "y": "p\nq"}, {"x": "2", "y": None}, {"x": "3", "y": "4", None: ["5"]}], "d": [{"x": "1", "y": "2"}], "e": {"k": [1]}, "f": "# Head\n\nOne two.\n\n- item"}
    assert bundle.table(spark, "c").columns == ["x", "y", "_row"]
    with pytest.raises(ValueError, match=".zip"):
        g.ingest(spark, "a.zip")
    with pytest.raises(ImportError, match="openpyxl|docling"):
        g.ingest(spark, f"{tmp_path}/a.xlsx")


class Scripted:
    """A client that gives its replies in turn."""

    def __init__(self, *replies):
        self.replies, self.prompts = list(replies), []

    def complete_json(self, *, prompt, schema, system=None):
        self.prompts.append(prompt)
        return self.replies[min(len(self.prompts), len(self.replies)) - 1]


def test_language_model(spark):
    spec = g.GraphSpec((g.NodeType("p", description="a person", attributes=(g.AttrSchema("name", required=True), g.AttrSchema("age", "integer", minimum=0, maximum=120))),), (g.EdgeType("knows", subject_type="p", object_type="p"),))
    bad, good = {"items": [{"name": "Ann", "age": 300}]}, {"items": [{"name": "Ann", "age": 30}, {"name": "Nobody", "age": 5}]}
    client = Scripted(bad, good)
    bundle = {"s1": "We met Ann today.", "s2": "Bob came too."}
    graph = g.extract(bundle, spec, {"p": ("llm", {"id_attribute": "name"})}, spark=spark, services={"llm": client}, on_missing_binding="skip")
    assert {n.id for n in graph.collect_nodes()} == {"p:ann", "p:nobody"} and "above 120" in client.prompts[1] and "a person" in client.prompts[0] and "at most 120" in client.prompts[0]
    seen = {r["element_id"]: r["evidence"] for r in graph.evidence.collect()}
    assert seen["p:ann"]["grounding"][1]["start"] == 7 and seen["p:ann"]["confidence"]["review_status"] == "auto" and seen["p:nobody"]["confidence"]["review_status"] == "needs_review"
    policy = g.ExtractionPolicy(self_consistency_samples=3, max_retries=0)
    graph = g.extract(bundle, spec, {"p": ("llm", {"policy": policy})}, spark=spark, services={"llm": Scripted(good, {"items": []}, good)}, on_missing_binding="skip")
    assert abs(graph.evidence.first()["evidence"]["confidence"]["score"] - 2 / 3) < 1e-9
    both = Scripted({"p": [{"name": "Ann"}, {"name": "Bob"}], "knows": [{"_source": "p:ann", "_target": "p:bob"}, {"_source": "Ann", "_target": "Bob"}]})
    graph = g.extract(bundle, spec, {"all": {"strategy": "cluster_llm", "elements": ["p", "knows"]}}, spark=spark, services={"llm": both})
    assert graph.number_of_edges() == 1 and graph.reports["skipped_edges"].count() == 1 and len(both.prompts) == 1
    assert g.ExtractionPolicy(overrides={"p": policy}).for_element("p") is policy
    graph = g.extract(bundle, spec, None, spark=spark, services={"llm": Scripted({"items": [{"name": "Ann"}]}, {"items": []})})
    assert graph.has_node("p:ann")
