"""Elements of a graph as texts, one row each: what every sink is made of."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json_value
from ..graph import Graph


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def json_object(fields: Mapping[str, Column], attributes: Column | None = None) -> Column:
    """A JSON object as text, from fields that are JSON texts and then attributes by name.

    Of two members with one name the last counts, as JSON readers have it.
    """
    own = F.array(*(F.concat(F.lit(f"{json.dumps(k)}:"), v) for k, v in fields.items())).cast("array<string>")
    if attributes is not None:
        own = F.concat(own, F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])))
    return F.concat(F.lit("{"), F.array_join(own, ","), F.lit("}"))


def node_fields(*names: str) -> dict[str, Column]:
    """Fields of a node as JSON texts; ``label`` is its first type."""
    return {n: {"id": quoted(F.col("id")), "types": F.to_json("types"), "label": quoted(first_type("")), "attributes": json_object({}, F.col("attributes"))}[n] for n in names}


def edge_fields(*names: str) -> dict[str, Column]:
    return {n: json_object({}, F.col("attributes")) if n == "attributes" else quoted(F.col(n)) for n in names}


def first_type(none: str) -> Column:
    return F.coalesce(F.get("types", F.lit(0)), F.lit(none))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spelt(values: pd.Series) -> pd.Series:
    return values.map(lambda own: None if own is None else [str(json.loads(v)) for v in own])


def plain(attributes: Column) -> Column:
    """A map of attribute values as one reads them: texts bare, ``True``, ``None``, lists and objects as Python writes them.

    Only elements that have a list, an object or a number with an exponent go through Python.
    """
    values = F.map_values(attributes)
    simple = lambda v: F.when(v == "true", "True").when(v == "false", "False").when(v == "null", "None").otherwise(json_value(v))
    hard = F.exists(values, lambda v: v.rlike(r"^([\[{NI]|-I|-?[0-9.]+[eE])"))
    return F.map_from_arrays(F.map_keys(attributes), F.coalesce(_spelt(F.when(hard, values)), F.transform(values, simple)))


def with_plain(elements: DataFrame) -> DataFrame:
    return elements.withColumn("plain", plain(F.col("attributes")))


def both(graph: Graph, node: Mapping[str, Column], edge: Mapping[str, Column], plainly: bool = False) -> DataFrame:
    """Nodes and then edges with the given columns, after ``kind`` and ``id``; ``plainly`` adds the map ``plain`` for these to use."""
    sides = []
    for kind, elements, columns in (("node", graph.nodes, node), ("edge", graph.edges, edge)):
        own = with_plain(elements) if plainly else elements
        sides.append(own.select(F.lit(kind).alias("kind"), "id", *(c.alias(n) for n, c in columns.items())))
    return sides[0].unionByName(sides[1])


def in_order(rows: DataFrame, kind: str, column: str) -> list:
    """One kind's column on the driver, by id: for small graphs."""
    return [r[column] for r in rows.where(F.col("kind") == kind).select("id", column).orderBy("id").toLocalIterator()]
