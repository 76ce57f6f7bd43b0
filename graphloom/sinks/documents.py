"""Whole documents of a graph of any size, as ordered lines.

A document is a DataFrame of ``section, key, text``: texts in the order of section
and key, each one or more lines. Separators that depend on what follows, as the
comma of a JSON list, come from the largest key of the section, a scalar subquery.
``write`` sorts the rows by range and leaves the part files to Spark's writer: in
the order of their names, they are the document. ``parts`` tells where in the
document each begins. No task holds more than its range, the driver no element.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..spec import GraphSpec
from ..storage import numbered
from .canonical import CANONICAL_VERSION, SCHEMA_ID
from .rows import edge_fields, json_object, node_fields, quoted, with_plain


@dataclass(frozen=True)
class Document:
    """Lines in order: ``rows`` has ``section, key, text``."""

    rows: DataFrame

    def text(self) -> str:
        """The whole document on the driver, without a last line break."""
        return "\n".join(r["text"] for r in self.rows.orderBy("section", "key").toLocalIterator())

    def write(self, path: str) -> None:
        """Part files below ``path``; joined in the order of their names they are ``text()`` and a line break."""
        order = ["section", "key"]
        self.rows.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.text(path)


def parts(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Part files of a written document: path, first byte in the document, size."""
    found = spark.read.format("binaryFile").load(f"{path}/part-*").select("path", "length").orderBy("path").collect()  # one row a file
    starts = accumulate((r["length"] for r in found), initial=0)
    return [(r["path"], at, r["length"]) for r, at in zip(found, starts, strict=False)]


def read(spark: SparkSession, path: str) -> str:
    """A written document as one text on the driver, for small ones."""
    return "".join(r["value"] for r in spark.read.text(f"{path}/part-*", wholetext=True).select("value", F.col("_metadata.file_path").alias("at")).orderBy("at").collect())


def _fixed(spark: SparkSession, section: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(section, "", "\n".join(lines))], "section int, key string, text string")


def _section(rows: DataFrame, section: int, between: str = "") -> DataFrame:
    """Rows ``key, text`` of a section; all but the last are followed by ``between``."""
    text = F.col("text")
    if between:
        text = F.concat(text, F.when(F.col("key") < rows.agg(F.max("key")).scalar(), between).otherwise(""))
    return rows.select(F.lit(section).alias("section"), "key", text.alias("text"))


def _document(pieces: Iterable[DataFrame]) -> Document:
    first, *rest = pieces
    for piece in rest:
        first = first.unionByName(piece)
    return Document(first)


# JSON -------------------------------------------------------------------------


def _laid_out(depth: int):
    @F.pandas_udf(T.StringType())
    def lay(objects: pd.Series) -> pd.Series:
        indent = "\n" + " " * depth
        return objects.map(lambda x: json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False).replace("\n", indent))

    return lay


def _members(rows: DataFrame, section: int, depth: int, opening: str, brackets: str, closing: str) -> list[DataFrame]:
    """A JSON list or object of ``key, json`` rows, named members of an object by their key."""
    some = rows.agg(F.count("*").alias("n"))
    head = F.when(F.col("n") > 0, F.lit(f"{' ' * depth}{opening}{brackets[0]}")).otherwise(f"{' ' * depth}{opening}{brackets}{closing}")
    inner = " " * (depth + 2)
    name = F.concat(quoted(F.col("key")), F.lit(": ")) if brackets == "{}" else F.lit("")
    own = rows.select("key", F.concat(F.lit(inner), name, _laid_out(depth + 2)(F.col("json"))).alias("text"))
    return [
        some.select(F.lit(section).alias("section"), F.lit("").alias("key"), head.alias("text")),
        _section(own, section + 1, ","),
        some.where("n > 0").select(F.lit(section + 2).alias("section"), F.lit("").alias("key"), F.lit(f"{' ' * depth}{brackets[1]}{closing}").alias("text")),
    ]


def canonical_document(graph: Graph, *, spec: GraphSpec | None = None) -> Document:
    """The canonical JSON of a graph, the same bytes as ``to_canonical_json``; NaN and infinity are refused."""
    spark = graph.spark
    edges = graph.edges.select(F.col("id").alias("key"), json_object(edge_fields("attributes", "id", "source", "target", "type")).alias("json"))
    nodes = graph.nodes.select(F.col("id").alias("key"), json_object(node_fields("attributes", "types")).alias("json"))
    about = [] if spec is None else json.dumps({"spec": {"id": spec.id, "version": spec.version}}, sort_keys=True, ensure_ascii=False, indent=2).splitlines()[1:-1]
    about = [*about[:-1], about[-1] + ","] if about else []
    return _document(
        [
            _fixed(spark, 0, "{", f'  "$schema": {json.dumps(SCHEMA_ID)},', '  "directed": true,'),
            *_members(edges, 1, 2, '"edges": ', "[]", ","),
            *_members(nodes, 4, 2, '"nodes": ', "{}", ","),
            _fixed(spark, 9, *about, f'  "version": {json.dumps(CANONICAL_VERSION)}', "}"),
        ]
    )


def array_document(rows: DataFrame, key: str) -> Document:
    """Rows as a JSON array of objects, one a line, in the order of ``key`` as a text; nulls are given as such."""
    own = rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}).alias("text"))
    return _document([_fixed(rows.sparkSession, 0, "["), _section(own, 1, ","), _fixed(rows.sparkSession, 2, "]")])


def jgf_document(graph: Graph) -> Document:
    """JSON Graph Format, as ``to_jgf``, keys sorted."""
    spark = graph.spark
    edges = graph.edges.select(F.col("id").alias("key"), json_object({"id": quoted(F.col("id")), "metadata": edge_fields("attributes")["attributes"], "relation": quoted(F.col("type")), **edge_fields("source", "target")}).alias("json"))
    nodes = graph.nodes.select(F.col("id").alias("key"), json_object({**node_fields("label"), "metadata": json_object(node_fields("types"), F.col("attributes"))}).alias("json"))
    return _document([_fixed(spark, 0, "{", '  "graph": {', '    "directed": true,'), *_members(edges, 1, 4, '"edges": ', "[]", ","), *_members(nodes, 4, 4, '"nodes": ', "{}", ""), _fixed(spark, 9, "  }", "}")])


# XML --------------------------------------------------------------------------

#: Characters that XML texts and attribute values cannot hold bare.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def xml_text(text: Column) -> Column:
    for bare, entity in ENTITIES:
        text = F.replace(text, F.lit(bare), F.lit(entity))
    return text


def _graphml_side(elements: DataFrame, kind: str, section: int, label: str, shown: Column, ends: list[str]) -> tuple[list[str], DataFrame]:
    """Key declarations and elements of one kind; a key's number is its attribute's place in the order of names."""
    spark = elements.sparkSession
    used = elements.select(F.explode(F.map_keys("attributes")).alias("name")).distinct().collect()  # as many as a grammar has attributes
    names = sorted({label} | {r["name"] for r in used})
    escaped = spark.createDataFrame(list(enumerate(names)), "i int, name string").orderBy("i").select(xml_text(F.col("name"))).collect()
    keys = [f'  <key id="{kind[0]}{i}" for="{kind}" attr.name="{r[0]}" attr.type="string"/>' for i, r in enumerate(escaped)]
    listed = F.array(*map(F.lit, names))

    def datum(name: Column, value: Column) -> Column:
        number = (F.array_position(listed, name) - 1).cast("string")
        return F.concat(F.lit(f'\n      <data key="{kind[0]}'), number, F.lit('">'), xml_text(value), F.lit("</data>"))

    marks = [F.concat(F.lit(f' {c}="'), xml_text(F.col(c)), F.lit('"')) for c in ("id", *ends)]
    data = F.transform(F.array_sort(F.map_entries("plain")), lambda e: datum(e["key"], e["value"]))
    text = F.concat(F.lit(f"    <{kind}"), *marks, F.lit(">"), datum(F.lit(label), shown), F.array_join(data, ""), F.lit(f"\n    </{kind}>"))
    return keys, _section(with_plain(elements).select(F.col("id").alias("key"), text.alias("text")), section)


def graphml_document(graph: Graph) -> Document:
    """GraphML; every value is a text, and a key stands for each attribute name of nodes and of edges."""
    spark = graph.spark
    node_keys, nodes = _graphml_side(graph.nodes, "node", 1, "types", F.array_join("types", ","), [])
    edge_keys, edges = _graphml_side(graph.edges, "edge", 2, "type", F.col("type"), ["source", "target"])
    opening = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *node_keys, *edge_keys, '  <graph edgedefault="directed">']
    return _document([_fixed(spark, 0, *opening), nodes, edges, _fixed(spark, 3, "  </graph>", "</graphml>")])


# tables -----------------------------------------------------------------------


def table_document(rows: DataFrame, key: str, separator: str = ",") -> Document:
    """A table with a header line, in the order of ``key`` as a text; cells that need it are quoted, nulls are empty."""

    def cell(text: Column) -> Column:
        needs = text.contains('"') | text.contains(separator) | text.rlike(r"[\r\n]")
        return F.coalesce(F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))

    cells = [cell(F.col(f"`{c}`").cast("string")) for c in rows.columns]
    own = rows.select(F.lit(1).alias("section"), F.col(key).cast("string").alias("key"), F.concat_ws(separator, *cells).alias("text"))
    header = rows.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit("").alias("key"), F.concat_ws(separator, *(cell(F.lit(c)) for c in rows.columns)).alias("text"))
    return _document([header, own])


# drawings ---------------------------------------------------------------------


def _bare(text: Column) -> Column:
    """A label without what would end it."""
    return F.regexp_replace(text, '[\n"]', " ")


def _labelled(graph: Graph, attribute: str | None) -> DataFrame:
    """Nodes with ``label``: an attribute as one reads it where a node has it, else the id."""
    named = F.coalesce(F.col("plain")[attribute], F.col("id")) if attribute else F.col("id")
    return (with_plain(graph.nodes) if attribute else graph.nodes).select("id", _bare(named).alias("label"))


def dot_document(graph: Graph, *, label_attr: str | None = None, name: str = "graphloom") -> Document:
    """A directed multigraph for Graphviz."""
    nodes = _labelled(graph, label_attr).select(F.col("id").alias("key"), F.format_string('  "%s" [label="%s"];', "id", "label").alias("text"))
    edges = graph.edges.select(F.col("id").alias("key"), F.format_string('  "%s" -> "%s" [label="%s"];', "source", "target", _bare(F.col("type"))).alias("text"))
    return _document([_fixed(graph.spark, 0, f"digraph {name} {{", "  rankdir=LR;"), _section(nodes, 1), _section(edges, 2), _fixed(graph.spark, 3, "}")])


def mermaid_document(graph: Graph, *, label_attr: str | None = None) -> Document:
    """A Mermaid flowchart; nodes are numbered by id, as their ids may hold anything. Edges without both ends are left out."""
    places = numbered(_labelled(graph, label_attr), ["id"]).select("id", "label", F.concat(F.lit("n"), F.col("i").cast("string")).alias("place"))
    nodes = places.select(F.col("id").alias("key"), F.format_string('  %s["%s"]', "place", "label").alias("text"))
    end = lambda c: places.select(F.col("id").alias(c), F.col("place").alias(f"{c}_place"))
    met = graph.edges.join(end("source"), "source").join(end("target"), "target")
    edges = met.select(F.col("id").alias("key"), F.format_string("  %s -->|%s| %s", "source_place", _bare(F.col("type")), "target_place").alias("text"))
    return _document([_fixed(graph.spark, 0, "flowchart LR"), _section(nodes, 1), _section(edges, 2)])


# triples ----------------------------------------------------------------------

PREFIX, NAMESPACE = "g", "urn:graphloom:"


def local_name(text: Column) -> Column:
    """A prefixed name: letters, digits, ``_`` and ``-`` stay, all else becomes ``_``; nothing becomes ``x``."""
    safe = F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")
    return F.concat(F.lit(f"{PREFIX}:"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("x")))


def triples(graph: Graph) -> DataFrame:
    """``kind, id, lines``: each element's triples. An edge's attributes annotate its triple; literals are JSON texts."""

    def said(subject: Column) -> Column:
        def one(e: Column) -> Column:
            bare = e["value"].startswith('"') | e["value"].rlike(r"^(true|false|-?[0-9].*)$")
            return F.concat(subject, F.lit(" "), local_name(e["key"]), F.lit(" "), F.when(bare, e["value"]).otherwise(quoted(F.col("plain")[e["key"]])), F.lit(" ."))

        return F.transform(F.array_sort(F.map_entries("attributes")), one)

    nodes, edges = with_plain(graph.nodes), with_plain(graph.edges)
    me = local_name(F.col("id"))
    typed = F.transform("types", lambda t: F.concat(me, F.lit(" rdf:type "), local_name(t), F.lit(" .")))
    link = F.concat_ws(" ", local_name(F.col("source")), local_name(F.col("type")), local_name(F.col("target")))
    of_nodes = nodes.select(F.lit("node").alias("kind"), "id", F.concat(typed, said(me)).alias("lines"))
    of_edges = edges.select(F.lit("edge").alias("kind"), "id", F.concat(F.array(F.concat(link, F.lit(" ."))), said(F.concat(F.lit("<< "), link, F.lit(" >>")))).alias("lines"))
    return of_nodes.unionByName(of_edges)


def turtle_document(graph: Graph, *, base: str = NAMESPACE) -> Document:
    """RDF-star Turtle."""
    own = triples(graph).where("size(lines) > 0").select(F.when(F.col("kind") == "node", 1).otherwise(2).alias("section"), F.col("id").alias("key"), F.array_join("lines", "\n").alias("text"))
    return _document([_fixed(graph.spark, 0, f"@prefix {PREFIX}: <{base}> .", "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .", ""), own])

