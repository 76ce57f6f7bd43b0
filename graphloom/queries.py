"""Registered queries of the graph engine over the driver's tables, each through the public API."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from .annotate import annotations_for
from .evidence import attribute_evidence, evidence
from .functions import cosine, json_text, json_value, normalize_entity, normalized, slug, slug_fast
from .graph import NODES, Graph
from .operators.assembly import attribute_conflicts, kept_edges, merge_nodes, skipped_edges
from .operators.candidates import similar_pairs
from .operators.context import ExtractionContext
from .operators.patterns import RegexEdgeExtractor, RegexNodeExtractor, find, find_plain
from .operators.records import JsonQuery, SqlExtractor, TableMap, json_records, where_column
from .operators.reify import reify, unreify
from .operators.resolution import CascadeResolver, LLMResolver, NormalizeResolver, RegistryResolver, clusters, connected, resolve_graph
from .operators.trace import TraceIndex, reanchored, spans_at, spans_overlapping
from .operators.validation import edge_issues, node_issues
from .operators.verify import Composite, ExactMatch, GraphMatch, NormalizedMatch, NumericTolerance, SemanticSimilarity, SetMatch, edge_bags, node_sets
from .plans import extract
from .plans.evaluation import CorpusCase, evaluate_corpus
from .sinks import array_document, canonical_document, cypher_rows, cytoscape_rows, dot_document, embedding_rows, graph_digest, graphml_document, jgf_document, mermaid_document, record_rows, table_document, turtle_rows, typed_view
from .sources import Source, SourceBundle
from .sources.json_ranges import JsonFile
from .sources.loaders import html_texts
from .sources.separated import Records
from .spec import AttrSchema, EdgeType, EnumDef, GraphSpec, NodeType
from .storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LINK = r'href="(?P<path>[^"]*)"'

GRAMMAR = GraphSpec(
    id="trade",
    version="1",
    node_types=(
        NodeType("region", attributes=(AttrSchema("name", required=True),)),
        NodeType("nation", attributes=(AttrSchema("name", required=True),)),
        NodeType("party", abstract=True, attributes=(AttrSchema("name", required=True),)),
        NodeType("customer", is_a="party", attributes=(AttrSchema("balance", "decimal", minimum=0), AttrSchema("segment", "Segment"), AttrSchema("key", "integer", maximum=1000))),
        NodeType("part", attributes=(AttrSchema("brand", pattern="^Brand#[1-3]"), AttrSchema("size", "integer", minimum=5, maximum=40))),
    ),
    edge_types=(EdgeType("located_in", subject_type="party", object_type="nation"), EdgeType("in_region", subject_type="nation", object_type="region")),
    enums=(EnumDef("Segment", ("AUTOMOBILE", "BUILDING", "MACHINERY")),),
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _context(spark: SparkSession, **sources) -> ExtractionContext:
    return ExtractionContext(spark, SourceBundle(Source(k, v, "table") for k, v in sources.items()), GRAMMAR)


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(id).cast("long").alias("ordinal"), F.col(id).cast("string").alias("source_id"), F.col(text).alias("text"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(_t(spark, sf, "documents"), "doc_id", "text")


def _attr(name: str):
    return json_value(F.col("attributes")[name]).alias(name)


def trade_graph(spark: SparkSession, sf: str) -> Graph:
    """Customers, nations and regions, extracted."""
    nation, region, customer = (_t(spark, sf, n) for n in ("nation", "region", "customer"))
    located = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    lies = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    sources = SourceBundle(Source(k, v, "table") for k, v in {"nation": nation, "region": region, "customer": customer, "located": located, "lies": lies}.items())
    return extract(
        sources,
        GRAMMAR,
        {
            "region": ("table_map", {"records_source": "region", "id_template": "region:{r_name}", "attributes": {"name": "r_name"}}),
            "nation": ("table_map", {"records_source": "nation", "id_template": "nation:{n_name}", "attributes": {"name": "n_name"}}),
            "customer": ("table_map", {"records_source": "customer", "id_template": "customer:{c_name}", "attributes": {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment", "key": "c_custkey"}}),
            "located_in": ("table_map", {"records_source": "located", "kind": "edge", "id_template": "located:{c_custkey}", "source_template": "customer:{c_name}", "target_template": "nation:{n_name}"}),
            "in_region": ("table_map", {"records_source": "lies", "kind": "edge", "id_template": "in:{n_name}", "source_template": "nation:{n_name}", "target_template": "region:{r_name}"}),
        },
        spark=spark,
        on_missing_binding="skip",
    )


@query
def extract_located_in(spark, sf):
    return trade_graph(spark, sf).edges_of_type("located_in").select("id", "source", "target")


@query
def graph_counts_by_type(spark, sf):
    return trade_graph(spark, sf).counts_by_type()


@query
def typed_view_customer(spark, sf):
    return typed_view(trade_graph(spark, sf), GRAMMAR, "customer").select("id", "name", "balance", "segment", "key")


@query
def table_map_nodes(spark, sf):
    out = TableMap("customer", type="customer", id_from="c_name", attributes={"segment": "c_mktsegment", "key": "c_custkey"}, casts={"key": "int"})(_context(spark, customer=_t(spark, sf, "customer")))
    return out.node_rows.select("id", _attr("segment"), _attr("key"))


@query
def table_map_edges(spark, sf):
    joined = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    out = TableMap("j", kind="edge", type="located_in", id_template="e:{c_custkey}", source_template="customer:{c_name}", target_template="nation:{n_name}")(_context(spark, j=joined))
    return out.edge_rows.select("id", "source", "target", "type")


@query
def table_map_positional_ids(spark, sf):
    out = TableMap("n", type="nation", attributes=["n_name"])(_context(spark, n=_t(spark, sf, "nation").withColumn("_row", F.col("n_nationkey"))))
    return out.node_rows.select("id", _attr("n_name"))


@query
def cell_grounding(spark, sf):
    out = TableMap("s", type="supplier", id_from="s_name", attributes=["s_name"])(_context(spark, s=_t(spark, sf, "supplier").withColumn("_row", F.col("s_suppkey"))))
    g = F.col("evidence.grounding")[0]
    return out.node_rows.select("id", g["source_id"].alias("source_id"), g["row"].alias("row"), g["column"].alias("column"), F.col("evidence.confidence.score").alias("score"))


@query
def slug_names(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"), slug_fast(F.col("p_type")).alias("type_slug"))


@query
def cast_values(spark, sf):
    out = TableMap("o", type="order", id_from="o_orderkey", attributes={"day": "o_orderpriority", "key": "k"}, casts={"day": "int", "key": "number"})(_context(spark, o=_t(spark, sf, "orders").withColumn("k", F.concat(F.lit("No "), F.col("o_orderkey").cast("string")))))
    return out.node_rows.select("id", _attr("day"), _attr("key"))


@query
def regex_nodes_email(spark, sf):
    staged = RegexNodeExtractor(f"(?P<address>{EMAIL})", "email", id_attribute="address").rows(find(_documents(spark, sf), [f"(?P<address>{EMAIL})"]), "email")
    return merge_nodes(staged.withColumn("step", F.lit(0))).select("id", F.get("types", F.lit(0)).alias("type"))


@query
def regex_edges_links(spark, sf):
    pages = _texts(_t(spark, sf, "pages"), "page_id", "html")
    pattern = r'<a href="(?P<path>[^"]*)"'
    return RegexEdgeExtractor(pattern, "page:links", "path:{path}", "links_to").rows(find(pages, [pattern]), "links_to").select("id", "target", F.col("evidence.grounding")[1]["start"].alias("start"), F.col("evidence.grounding")[1]["source_id"].alias("page"))


@query
def match_offsets(spark, sf):
    return find_plain(_documents(spark, sf), EMAIL).select(F.col("source_id").cast("long").alias("doc_id"), "m", "start", "stop", "exact")


@query
def quote_context(spark, sf):
    return find(_documents(spark, sf), [EMAIL]).select(F.col("source_id").cast("long").alias("doc_id"), "m", "exact", "prefix", "suffix")


@query
def sql_extract(spark, sf):
    sql = SqlExtractor("orders", 'SELECT "o_orderpriority" AS priority, count(*) AS n, max(o_orderkey) AS last FROM t WHERE o_orderstatus = ? GROUP BY 1', ["F"], type="priority", id_from="priority", attributes=["n", "last"])
    return sql(_context(spark, orders=_t(spark, sf, "orders"))).node_rows.select("id", _attr("n"), _attr("last"))


@query
def json_query_events(spark, sf):
    items = json_records(_t(spark, sf, "events").select("event_id", "props"), "props")
    return items.where(where_column({"k": {"$gt": 50}}, F.col("item"))).select("event_id", json_value(F.col("item")["k"]).cast("long").alias("k"))


@query
def json_where_in_ne(spark, sf):
    items = json_records(_t(spark, sf, "events").select("event_id", "props"), "props")
    return items.where(where_column({"k": {"$in": [1, 2, 3, 5, 8], "$ne": 3, "$gte": 99}}, F.col("item"))).select("event_id")


def _orders_as_customers(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders")
    attributes = F.create_map(F.lit("status"), F.to_json(F.array("o_orderstatus")).substr(F.lit(2), F.length("o_orderstatus") + 2), F.lit("priority"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    return o.select(F.concat(F.lit("customer:"), "o_custkey").alias("id"), F.array(F.lit("customer")).alias("types"), attributes.alias("attributes"), F.lit(0).alias("step"), F.col("o_orderkey").alias("seq"))


@query
def node_merge_last_wins(spark, sf):
    return merge_nodes(_orders_as_customers(spark, sf)).select("id", _attr("status"), _attr("priority"))


@query
def attribute_conflict_report(spark, sf):
    return attribute_conflicts(_orders_as_customers(spark, sf)).select("node", "attribute", json_value(F.col("old")).alias("old"), json_value(F.col("new")).alias("new"))


def _order_edges(spark, sf) -> DataFrame:
    none = F.create_map().cast("map<string,string>").alias("attributes")
    return _t(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") + 7).alias("source"), F.concat(F.lit("s"), "o_orderstatus").alias("target"), F.lit("placed").alias("type"), none)


def _order_nodes(spark, sf) -> DataFrame:
    return _t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(spark.createDataFrame([("sF",), ("sO",)], "id string"))


@query
def skipped_edge_report(spark, sf):
    return skipped_edges(_order_edges(spark, sf), _order_nodes(spark, sf))


@query
def kept_edge_rows(spark, sf):
    return kept_edges(_order_edges(spark, sf), _order_nodes(spark, sf)).select("id", "source", "target")


@query
def edges_between_two(spark, sf):
    """All orders of one customer with one status, as parallel edges."""
    none = F.create_map().cast("map<string,string>").alias("attributes")
    graph = Graph(_order_nodes(spark, sf).select("id", F.array(F.lit("party")).alias("types"), none), _order_edges(spark, sf))
    return graph.edges_between("c8", "sF").select("id", "source", "target")


def _customer_nodes(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer")
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    own = F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("segment"), text("c_mktsegment"), F.lit("key"), F.col("c_custkey").cast("string"))
    named = F.when(F.col("c_custkey") % 7 != 0, F.map_concat(own, F.create_map(F.lit("name"), text("c_name")))).otherwise(own)
    types = F.when(F.col("c_custkey") % 11 == 0, F.array(F.lit("client"))).when(F.col("c_custkey") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("customer")))
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), types.alias("types"), named.alias("attributes"))


@query
def validate_nodes(spark, sf):
    return node_issues(_customer_nodes(spark, sf), GRAMMAR).select("element_id", "code")


@query
def validate_parts(spark, sf):
    p = _t(spark, sf, "part")
    nodes = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.array(F.lit("part")).alias("types"), F.create_map(F.lit("brand"), F.concat(F.lit('"'), "p_brand", F.lit('"')), F.lit("size"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('"'), F.col("p_size"), F.lit('"'))).otherwise(F.col("p_size").cast("string"))).alias("attributes"))
    return node_issues(nodes, GRAMMAR).select("element_id", "code")


@query
def validate_edges(spark, sf):
    nodes = _customer_nodes(spark, sf).unionByName(_t(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.when(F.col("n_nationkey") % 5 == 0, "region").otherwise("nation")).alias("types"), F.create_map().cast("map<string,string>").alias("attributes")))
    edges = _t(spark, sf, "customer").select(F.concat(F.lit("e"), "c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), F.col("c_nationkey") + 1).alias("target"), F.when(F.col("c_custkey") % 17 == 0, "lives").otherwise("located_in").alias("type"), F.create_map().cast("map<string,string>").alias("attributes"))
    return edge_issues(edges, nodes, GRAMMAR).select("element_id", "code")


@query
def normalize_entity_names(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", normalize_entity(F.concat(F.lit("The "), F.col("p_name"), F.lit(", Inc."))).alias("name"))


def _part_nodes(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part")
    name = F.concat(F.lit('"'), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit(" Ltd."))), F.lit('"'))
    return p.select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), F.array(F.lit("brand")).alias("types"), F.create_map(F.lit("name"), name, F.lit("size"), F.col("p_size").cast("string")).alias("attributes"))


def _part_graph(spark, sf) -> Graph:
    pid = F.concat(F.lit("p"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    nodes = _part_nodes(spark, sf)
    # several rows share an order and a line number; each is an edge of its own
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey"))
    edges = _t(spark, sf, "lineitem").select("l_partkey", F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), place).alias("id")).select("id", pid.alias("source"), F.reverse(F.reverse(pid)).alias("target"), F.lit("self").alias("type"), F.create_map().cast("map<string,string>").alias("attributes"))
    return Graph(nodes, edges)


@query
def resolve_clusters(spark, sf):
    return clusters(_part_nodes(spark, sf), NormalizeResolver("name")).select("id", "cid")


@query
def resolve_nodes(spark, sf):
    return resolve_graph(_part_graph(spark, sf), NormalizeResolver("name")).nodes.select("id", _attr("name"), _attr("size"))


@query
def resolve_remapped_edges(spark, sf):
    return resolve_graph(_part_graph(spark, sf), NormalizeResolver("name")).edges.select("id", "source", "target")


@query
def resolve_merge_report(spark, sf):
    return resolve_graph(_part_graph(spark, sf), NormalizeResolver("name")).reports["merges"].select("canonical", F.size("members").alias("n"), F.get("members", F.lit(0)).alias("first"))


@query
def resolve_components(spark, sf):
    s = _t(spark, sf, "supplier")
    own = F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    links = s.select(own.alias("u"), F.concat(F.lit("n"), "s_nationkey").alias("v")).unionByName(s.select(own.alias("u"), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 2000)).alias("v")))
    return connected(links).select("node", "component")


def _sales_graph(spark, sf) -> Graph:
    line = _t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    o, p = F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")
    edges = line.select(F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"), o.alias("source"), p.alias("target"), F.lit("contains").alias("type"), F.create_map(F.lit("quantity"), F.col("l_quantity").cast("string")).alias("attributes"))
    nodes = line.select(o.alias("id"), F.lit("order").alias("t")).distinct().unionByName(line.select(p.alias("id"), F.lit("part").alias("t")).distinct())
    return Graph(nodes.select("id", F.array("t").alias("types"), F.create_map().cast("map<string,string>").alias("attributes")), edges)


@query
def reify_connectors(spark, sf):
    return reify(_sales_graph(spark, sf), "contains").edges.select("id", "source", "target", "type")


@query
def unreify_round_trip(spark, sf):
    return unreify(reify(_sales_graph(spark, sf), "contains"), "contains").edges.select("id", "source", "target", "type", json_value(F.col("attributes")["quantity"]).cast("double").alias("quantity"))


def _spans(spark, sf) -> DataFrame:
    return find_plain(_documents(spark, sf), EMAIL).select("source_id", F.concat("source_id", F.lit(":"), "m").alias("element_id"), "start", F.col("stop").alias("end"))


@query
def trace_stab(spark, sf):
    probes = _documents(spark, sf).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(50).cast("long"))).alias("offset"))
    return spans_at(_spans(spark, sf), probes).select("source_id", "offset", "element_id")


@query
def trace_overlap(spark, sf):
    probes = _documents(spark, sf).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"), F.lit(400).cast("long"))).alias("from")).withColumn("to", F.col("from") + 90)
    return spans_overlapping(_spans(spark, sf), probes).select("source_id", "from", "element_id")


@query
def edge_bag_counts(spark, sf):
    o = _t(spark, sf, "orders")
    made = lambda target: o.select(F.lit("x").alias("type"), F.col("o_custkey").cast("string").alias("source"), target.alias("target"))
    status = F.col("o_orderstatus")
    return edge_bags(made(status), made(F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise(status)))


@query
def node_set_counts(spark, sf):
    return node_sets(_t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")), _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")))


@query
def numeric_tolerance_scores(spark, sf):
    rule = NumericTolerance(abs_tol=0.5, rel_tol=0.01)
    line = _t(spark, sf, "lineitem")
    return line.groupBy("l_returnflag").agg(F.sum(rule.within(F.round(F.col("l_extendedprice") / 100) * 100, F.col("l_extendedprice"))).cast("long").alias("n_passed"), F.count("*").alias("n"))


@query
def text_match_scores(spark, sf):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    other = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))
    return _t(spark, sf, "part").select("p_partkey", ExactMatch().column(quoted(F.col("p_name")), quoted(other)).alias("exact"), NormalizedMatch().column(quoted(F.col("p_name")), quoted(other)).alias("normalized"), normalized(other).alias("norm"))


@query
def set_match_scores(spark, sf):
    words = F.split("p_type", " ")
    return _t(spark, sf, "part").select("p_partkey", F.round(SetMatch().column(words, F.array(F.get(words, F.lit(0)), F.lit("COPPER"))), 9).alias("f1"))


@query
def semantic_cosine(spark, sf):
    e = _t(spark, sf, "embeddings")
    probe = e.where("vec_id = 0").first()["embedding"]  # one vector
    return e.select("vec_id", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, probe))), 6).alias("cosine"))


@query
def text_join(spark, sf):
    turns = _t(spark, sf, "conversations")
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return joined.select("conv_id", F.length("text").alias("n"), F.sha2("text", 256).alias("sha"))


@query
def embedding_record_rows(spark, sf):
    return embedding_rows(trade_graph(spark, sf))


@query
def cytoscape_element_rows(spark, sf):
    return cytoscape_rows(trade_graph(spark, sf))


@query
def turtle_triples(spark, sf):
    return turtle_rows(trade_graph(spark, sf))


@query
def cypher_parameters(spark, sf):
    return cypher_rows(trade_graph(spark, sf)).select("id", "source", "target", "props")


@query
def graph_digests(spark, sf):
    return graph_digest(trade_graph(spark, sf))


@query
def element_records(spark, sf):
    return record_rows(trade_graph(spark, sf))


@query
def canonical_document_lines(spark, sf):
    return canonical_document(trade_graph(spark, sf), spec=GRAMMAR).rows


@query
def jgf_document_lines(spark, sf):
    return jgf_document(trade_graph(spark, sf)).rows


@query
def graphml_document_lines(spark, sf):
    return graphml_document(trade_graph(spark, sf)).rows


@query
def dot_document_lines(spark, sf):
    return dot_document(trade_graph(spark, sf), label_attr="name").rows


@query
def mermaid_document_lines(spark, sf):
    return mermaid_document(trade_graph(spark, sf), label_attr="segment").rows


@query
def separated_round_trip(spark, sf):
    """All documents, written as a table of separated texts and read again by ranges."""
    path = scratch(spark, "documents")
    table_document(_t(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id").write(path)
    frame = Records(spark, path).frame
    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").alias("place"), F.sha2("text", 256).alias("sha"), "lang")


@query
def json_file_items(spark, sf):
    """All documents, written as one JSON array and read again by ranges."""
    path = scratch(spark, "documents")
    array_document(_t(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id").write(path)
    item = F.from_json("item", "doc_id long, text string, lang string")
    return JsonFile(spark, path).rows("[*]").select(item.alias("x"), "_i").select("x.doc_id", F.col("_i").alias("place"), F.sha2(F.coalesce("x.text", F.lit("")), 256).alias("sha"), "x.lang")


@query
def corpus_summary(spark, sf):
    labels = _t(spark, sf, "labels")
    return labels.agg(F.round(F.avg(F.col("quality").cast("double")), 9).alias("mean_score"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 9).alias("pass_rate"), F.count("*").alias("n"))


@query
def evidence_lookup(spark, sf):
    graph = trade_graph(spark, sf)
    return graph.evidence.select("element_id", F.col("evidence.provenance.derived_from").alias("source"), F.col("evidence.provenance.generated_by").alias("strategy"), F.col("evidence.confidence.method").alias("method"))


@query
def json_query_strategy(spark, sf):
    """The strategy over a column of JSON documents: one node for each item that the predicate keeps."""
    events = _t(spark, sf, "events").select(F.col("event_id").alias("_row"), F.col("props").alias("json"))
    out = JsonQuery("events", where={"k": {"$gt": 50}}, type="mark", id_from="k", attributes=["k"])(_context(spark, events=events))
    return out.node_rows.select("id", _attr("k"), F.col("evidence.grounding")[1]["expression"].alias("place"))


@query
def graph_match_scores(spark, sf):
    """Customers and nations as extracted, against ones with other balances, names in capitals, and suppliers too."""
    c, n, s = (_t(spark, sf, x) for x in ("customer", "nation", "supplier"))
    text = lambda v: F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2)
    nodes = lambda df, key, name, balance, type: df.select(key.alias("id"), F.array(F.lit(type)).alias("types"), F.create_map(F.lit("name"), text(name), F.lit("balance"), balance.cast("string")).alias("attributes"))
    ids = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("s"), "s_suppkey")
    nations = nodes(n, ids[1], F.col("n_name"), F.col("n_nationkey"), "nation")
    edges = c.select(F.concat(F.lit("e"), "c_custkey").alias("id"), ids[0].alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.lit("located_in").alias("type"), F.create_map().cast("map<string,string>").alias("attributes"))
    actual = Graph(nodes(c, ids[0], F.col("c_name"), F.col("c_acctbal"), "customer").unionByName(nations), edges)
    wanted = nodes(c, ids[0], F.upper("c_name"), F.round("c_acctbal"), "customer").unionByName(nations).unionByName(nodes(s, ids[2], F.col("s_name"), F.col("s_acctbal"), "supplier"))
    verdict = GraphMatch(attribute_verifiers={"balance": NumericTolerance(abs_tol=0.25, rel_tol=0.0)})(actual, Graph(wanted, edges))
    d = verdict.details
    row = (round(verdict.score, 9), round(d["nodes"]["f1"], 9), round(d["edges"]["f1"], 9), round(d["attributes"]["score"], 9), d["attributes"]["compared"])
    return spark.createDataFrame([row], "score double, nodes double, edges double, attributes double, compared long")


@query
def parallel_edge_scores(spark, sf):
    """Orders as parallel edges of a customer and a priority; some statuses differ and some orders are missing."""
    orders = _t(spark, sf, "orders")

    def graph(rows, status) -> Graph:
        edges = rows.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderpriority").alias("type"), F.create_map(F.lit("status"), json_text(status)).alias("attributes"))
        return Graph(spark.createDataFrame([], NODES), edges)

    status = F.when(F.col("o_orderkey") % 3 == 0, F.lit("F")).otherwise(F.col("o_orderstatus"))
    rows = GraphMatch().attribute_rows(graph(orders, F.col("o_orderstatus")), graph(orders.where("o_orderkey % 11 <> 0"), status))
    return rows.groupBy("type").agg(F.count("*").alias("compared"), F.count_if(F.col("actual") == F.col("expected")).alias("equal"))


REGISTRY = {"Brand#11 Ltd.": "brand:one", "brand 12": "brand:two"}


@query
def resolve_by_registry(spark, sf):
    return clusters(_part_nodes(spark, sf), RegistryResolver(REGISTRY)).select("id", "cid")


@query
def resolve_by_cascade(spark, sf):
    return clusters(_part_nodes(spark, sf), CascadeResolver([RegistryResolver(REGISTRY), NormalizeResolver("name")])).select("id", "cid")


def _titles(spark, sf) -> DataFrame:
    """Each document twice: by its first words, and by the same in capitals with other punctuation."""
    head = F.regexp_extract("text", "^[^A-Za-z]*+((?:[A-Za-z]++[^A-Za-z]*+){0,4})", 1)  # so that no text is gone through to its end
    words = F.slice(F.split(F.regexp_replace(F.regexp_replace(head, "[^A-Za-z]+", " "), "^ | $", ""), " "), 1, 4)
    docs = _t(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("number"), words.alias("words"))
    sides = [("d", F.array_join("words", " ")), ("v", F.upper(F.array_join("words", " - ")))]
    rows = docs.select(F.explode(F.array(*(F.struct(F.concat(F.lit(p), "number").alias("id"), name.alias("name")) for p, name in sides))).alias("side"))
    return rows.select("side.id", F.array(F.lit("title")).alias("types"), F.create_map(F.lit("name"), json_text(F.col("side.name"))).alias("attributes"))


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalpha())


@query
def resolve_by_judge(spark, sf):
    """A judge that compares letters is asked about similar titles only."""
    return clusters(_titles(spark, sf), LLMResolver(lambda a, b: _letters(a) == _letters(b), similarity=0.8)).select("id", "cid")


@query
def similar_title_pairs(spark, sf):
    """All pairs of distinct titles whose q-grams reach a Jaccard index of 0.35."""
    titles = _titles(spark, sf).where(F.col("id").startswith("d")).select(F.to_json("types").alias("block"), json_value(F.col("attributes")["name"]).alias("value")).distinct()
    return similar_pairs(titles, 0.35).select("a", "b")


@query
def validate_lists(spark, sf):
    """A list where the grammar has one value, and one value where it has a list."""
    c = _t(spark, sf, "customer")
    spec = GraphSpec(id="lists", version="1", node_types=(NodeType("party", attributes=(AttrSchema("name"), AttrSchema("tags", multivalued=True))),))
    attributes = F.create_map(F.lit("name"), F.to_json(F.array("c_name", "c_mktsegment")), F.lit("tags"), F.when(F.col("c_acctbal") < 0, F.to_json(F.array("c_mktsegment"))).otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))))
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array(F.lit("party")).alias("types"), attributes.alias("attributes"))
    return node_issues(nodes, spec).select("element_id", "code")


@query
def annotations_of_documents(spark, sf):
    notes = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("target"), F.col("quality").alias("body"), F.lit("classifying").alias("motivation"))
    return annotations_for(notes, _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")))


@query
def attribute_evidence_rows(spark, sf):
    """An attribute's own evidence, else its element's."""
    s = _t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("element_id"))
    told = lambda attribute, source: s.select("element_id", F.lit(attribute).cast("string").alias("attribute"), evidence(F.lit(source), "query:table_map", []).alias("evidence"))
    wanted = s.select("element_id", F.explode(F.array(F.lit("name"), F.lit("balance"))).alias("attribute"))
    return attribute_evidence(wanted, told(None, "whole").unionByName(told("balance", "own"))).select("element_id", "attribute", F.col("evidence.provenance.derived_from").alias("source"))


@query
def trace_cells(spark, sf):
    supplier = _t(spark, sf, "supplier")
    out = TableMap("s", type="supplier", id_from="s_name", attributes=["s_name"])(_context(spark, s=supplier.withColumn("_row", F.col("s_suppkey"))))
    found = TraceIndex(out.node_rows.select(F.col("id").alias("element_id"), F.lit(None).cast("string").alias("attribute"), "evidence"))
    probes = supplier.select(F.lit("s").alias("source_id"), F.col("s_suppkey").alias("row"), F.lit("s_name").alias("column"))
    return found.in_cell(probes).select("row", "element_id")


@query
def corpus_evaluation(spark, sf):
    """Two cases: nations held against nations, and against nations and regions."""
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    bindings = {"nation": ("table_map", {"records_source": "nation", "id_template": "nation:{n_name}", "attributes": {"name": "n_name"}})}
    nodes = lambda df, type, name: df.select(F.concat(F.lit(f"{type}:"), slug(F.col(name))).alias("id"), F.array(F.lit(type)).alias("types"), F.create_map(F.lit("name"), F.concat(F.lit('"'), name, F.lit('"'))).alias("attributes"))
    none = spark.createDataFrame([], "id string, source string, target string, type string, attributes map<string,string>")
    own = nodes(nation, "nation", "n_name")
    sources = SourceBundle([Source("nation", nation, "table")])
    cases = [CorpusCase(name, sources, GRAMMAR, bindings, Graph(wanted, none)) for name, wanted in (("same", own), ("more", own.unionByName(nodes(region, "region", "r_name"))))]
    result = evaluate_corpus(cases)
    return spark.createDataFrame([(round(result.mean_score, 9), result.pass_rate, len(result.cases))], "mean_score double, pass_rate double, n long")


@query
def lexical_similarity(spark, sf):
    """Ratio of matching characters, as the fallback of semantic similarity has it."""
    p = _t(spark, sf, "part")
    return p.select("p_partkey", F.round(SemanticSimilarity().column(F.concat(F.lit('"'), "p_brand", F.lit('"')), F.concat(F.lit('"'), "p_brand", F.lit('~"'))), 9).alias("ratio"))


@query
def composite_scores(spark, sf):
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rule = Composite(((ExactMatch(), 1.0), (NormalizedMatch(), 3.0)))
    return _t(spark, sf, "part").select("p_partkey", rule.column(quoted(F.col("p_name")), quoted(F.upper("p_name"))).alias("score"))


@query
def nodes_of_one_type(spark, sf):
    return trade_graph(spark, sf).nodes_of_type("nation").select("id", _attr("name"))


# without SQL ---------------------------------------------------------------------


@query
def reanchor_emails(spark, sf):
    """Quotes looked for in their documents after the text was shifted and partly changed."""
    found = find(_documents(spark, sf), [EMAIL])
    rows = found.join(_documents(spark, sf).select("source_id", "text"), "source_id")
    moved = rows.select("source_id", "m", "exact", "prefix", "suffix", F.concat(F.lit("Moved. "), F.replace("text", F.col("exact"), F.concat(F.substring("exact", 1, 12), F.lit("?")))).alias("text"), F.col("start").alias("hint"))
    return reanchored(moved).select("source_id", "m", "exact", "start", "end")


@query
def reanchor_in_context(spark, sf):
    """Each e-mail address looked for in a text that has it three times, once in its own context, and in one that has it not."""
    found = find(_documents(spark, sf), [EMAIL]).select(F.col("source_id").cast("long").alias("doc_id"), "m", "exact", "prefix", "suffix", F.lit(None).cast("long").alias("hint"))
    thrice = found.withColumn("text", F.concat(F.lit("x "), "exact", F.lit(" y "), "prefix", "exact", "suffix", F.lit(" z "), "exact"))
    lost = found.withColumn("text", F.translate("exact", "@", " "))
    return reanchored(thrice.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False))), fuzzy=False).select("doc_id", "m", "kept", "start", "end")


@query
def html_markdown(spark, sf):
    return html_texts(_t(spark, sf, "pages"), "page_id", "html")


