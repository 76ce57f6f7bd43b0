"""Validation of graphs against their grammar, as rows of issues."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_value
from ..graph import Graph, Node
from ..spec import PRIMITIVES, AttrSchema, GraphSpec, effective_attributes

ISSUES = "element string, element_id string, code string, message string"


@dataclass(frozen=True)
class ValidationIssue:
    element: str
    element_id: str
    code: str
    message: str


class GraphValidationError(ValueError):
    """All issues of a graph that was to be valid."""

    def __init__(self, issues: list[ValidationIssue]) -> None:
        self.issues = issues
        super().__init__(f"{len(issues)} issues: " + "; ".join(f"{i.element} {i.element_id}: {i.message}" for i in issues[:5]))


def validate_spec(spec: GraphSpec) -> list[ValidationIssue]:
    """Endpoint types of edges and parents of nodes that are not declared."""
    nodes = {t.id for t in spec.node_types}
    out = []
    for e in spec.edge_types:
        out += [ValidationIssue("spec", e.id, "unknown-endpoint-type", f"{role} type {t!r} is not declared") for role, t in (("subject", e.subject_type), ("object", e.object_type)) if t and t not in nodes]
    out += [ValidationIssue("spec", n.id, "unknown-parent-type", f"parent {n.is_a!r} is not declared") for n in spec.node_types if n.is_a and n.is_a not in nodes]
    return out


def _issue(when: Column, code: str, message: Column | str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


#: JSON texts of each value kind; dates are any text.
KINDS = {"string": r'^"', "date": r'^"', "datetime": r'^"', "integer": r"^-?\d+$", "decimal": r"^-?\d", "float": r"^-?\d", "boolean": r"^(true|false)$"}


def _value_issues(spec: GraphSpec, attr: AttrSchema, value: Column) -> list[Column]:
    """Issues of one value; null where there is none."""
    name, allowed = attr.name, spec.permissible(attr)
    present = value.isNotNull() & (value != "null")
    shown = lambda text: F.concat(F.lit(f"{name}: "), value, F.lit(text))
    if allowed is not None:
        return [_issue(present & ~F.coalesce(value.startswith('"') & json_value(value).isin(list(allowed)), F.lit(False)), "enum", shown(f" is none of {list(allowed)}"))]
    out = []
    if attr.range in PRIMITIVES:
        out.append(_issue(present & ~value.rlike(KINDS[attr.range]), "range-type", shown(f" is no {attr.range}")))
    amount = F.when(value == "true", 1.0).when(value == "false", 0.0).when(value.rlike(r"^-?\d"), value.try_cast("double"))
    if attr.minimum is not None:
        out.append(_issue(amount < float(attr.minimum), "minimum", shown(f" is below {attr.minimum}")))
    if attr.maximum is not None:
        out.append(_issue(amount > float(attr.maximum), "maximum", shown(f" is above {attr.maximum}")))
    if attr.pattern is not None:
        out.append(_issue(value.startswith('"') & ~json_value(value).rlike(attr.pattern), "pattern", shown(f" does not match {attr.pattern!r}")))
    return out


def _each_value(spec: GraphSpec, attr: AttrSchema):
    return lambda v: F.filter(F.array(*_value_issues(spec, attr, F.to_json(v))), lambda i: i.isNotNull())


def attribute_issues(spec: GraphSpec, type: str, attributes: Column) -> Column:
    """Array of ``struct<code, message>`` for one element type's attributes, a map of JSON texts."""
    lists = []
    none = F.array().cast("array<struct<code:string,message:string>>")
    for name, attr in effective_attributes(spec, type).items():
        own = []
        has = F.map_contains_key(attributes, F.lit(name))
        if attr.required:
            own.append(_issue(~has, "missing-required", f"{name} is missing"))
        value = attributes[name]
        if attr.multivalued:
            is_list = value.startswith("[")
            own.append(_issue(has & (value != "null") & ~is_list, "not-multivalued", f"{name} is no list"))
            each = F.transform(F.from_json(value, "array<variant>"), _each_value(spec, attr))
            lists.append(F.coalesce(F.when(is_list, F.flatten(each)), none) if _value_issues(spec, attr, value) else none)
        else:
            own += _value_issues(spec, attr, value)
        if own:
            lists.append(F.filter(F.array(*own), lambda i: i.isNotNull()))
    return F.concat(*lists) if lists else none


def _by_type(spec: GraphSpec, elements: DataFrame, kinds: list[str], label: str) -> DataFrame:
    """Attribute issues of elements that have a ``_type``."""
    found = None
    for t in kinds:
        found = (F.when if found is None else found.when)(F.col("_type") == t, attribute_issues(spec, t, F.col("attributes")))
    if found is None:
        return elements.sparkSession.createDataFrame([], ISSUES)
    return elements.select("id", F.explode(found).alias("i")).select(F.lit(label).alias("element"), F.col("id").alias("element_id"), "i.code", "i.message")


def node_issues(nodes: DataFrame, spec: GraphSpec) -> DataFrame:
    """Issues of nodes: a node is checked once for each of its labels."""
    known = [t.id for t in spec.node_types]
    bare = nodes.where(F.size("types") == 0).select(F.lit("node").alias("element"), F.col("id").alias("element_id"), F.lit("untyped").alias("code"), F.lit("the node has no type").alias("message"))
    labels = nodes.select("id", "attributes", F.explode("types").alias("_type"))
    unknown = labels.where(~F.col("_type").isin(known)).select(F.lit("node").alias("element"), F.col("id").alias("element_id"), F.lit("unknown-type").alias("code"), F.concat(F.lit("type "), "_type", F.lit(" is not declared")).alias("message"))
    return bare.unionByName(unknown).unionByName(_by_type(spec, labels, known, "node"))


def edge_issues(edges: DataFrame, nodes: DataFrame, spec: GraphSpec) -> DataFrame:
    """Issues of edges: undeclared type, endpoints that are absent or of a wrong type, attributes."""
    spark = edges.sparkSession
    known = [t.id for t in spec.edge_types]
    unknown = edges.where(~F.col("type").isin(known)).select(F.lit("edge").alias("element"), F.col("id").alias("element_id"), F.lit("unknown-type").alias("code"), F.concat(F.lit("type "), "type", F.lit(" is not declared")).alias("message"))
    own = edges.where(F.col("type").isin(known)).withColumn("_type", F.col("type"))
    out = unknown.unionByName(_by_type(spec, own, known, "edge"))
    closure: dict[str, list[str]] = {}
    for t, s in spec.subtype_closure():
        closure.setdefault(s, []).append(t)
    ends = [(e.id, role, t, closure.get(t, [t]) if t else None) for e in spec.edge_types for role, t in (("source", e.subject_type), ("target", e.object_type))]
    rules = F.broadcast(spark.createDataFrame(ends, "_type string, role string, expected string, allowed array<string>"))  # two rows an edge type
    long = own.select("id", "_type", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("node")) for r in ("source", "target")))).alias("e")).select("id", "_type", "e.role", "e.node")
    met = long.join(nodes.select(F.col("id").alias("node"), "types"), "node", "left").join(rules, ["_type", "role"])
    code = F.when(F.col("types").isNull(), "missing-endpoint").when(F.col("allowed").isNotNull() & ~F.arrays_overlap("types", "allowed"), "endpoint-type")
    text = F.when(F.col("types").isNull(), F.concat("role", F.lit(" "), "node", F.lit(" does not exist"))).otherwise(F.concat("role", F.lit(" "), "node", F.lit(" is no "), "expected"))
    wrong = met.select(F.lit("edge").alias("element"), F.col("id").alias("element_id"), code.alias("code"), text.alias("message")).where("code is not null")
    return out.unionByName(wrong)


def validation_issues(graph: Graph, spec: GraphSpec) -> DataFrame:
    """All issues, the grammar's own too, as a lazy DataFrame."""
    own = [(i.element, i.element_id, i.code, i.message) for i in validate_spec(spec)]
    return graph.spark.createDataFrame(own, ISSUES).unionByName(node_issues(graph.nodes, spec)).unionByName(edge_issues(graph.edges, graph.nodes, spec))


def validate_graph(graph: Graph, spec: GraphSpec, raise_on_error: bool = False) -> DataFrame:
    """Issues of the graph; raises with the first hundred of them if asked to."""
    issues = validation_issues(graph, spec)
    if raise_on_error and (found := issues.limit(100).collect()):
        raise GraphValidationError([ValidationIssue(*r) for r in found])
    return issues


def validate_attributes(spark, type: str, attributes: Mapping[str, Any], spec: GraphSpec) -> list[ValidationIssue]:
    """Issues of one element's attributes given on the driver."""
    from ..graph import attribute_map

    frame = spark.createDataFrame([("", attribute_map(attributes))], "id string, attributes map<string,string>")
    rows = frame.select(F.explode(attribute_issues(spec, type, F.col("attributes"))).alias("i")).select("i.*").collect()
    return [ValidationIssue("attributes", type, r["code"], r["message"]) for r in rows]


__all__ = ["GraphValidationError", "Node", "ValidationIssue", "validate_attributes", "validate_graph", "validate_spec", "validation_issues"]
