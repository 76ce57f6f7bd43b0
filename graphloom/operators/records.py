"""Records into nodes and edges: tables, SQL results and JSON documents."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..evidence import evidence, selector
from ..functions import apply_casts, json_text, slug, template_fields
from ..functions.text import fill_template
from ..sources.json_ranges import PATH, JsonFile, steps, walked
from ..storage import numbered, stored
from .context import Extraction, ExtractionContext, register_extractor


def map_records(records: DataFrame, mapping: Mapping[str, Any], source_id: str, default_type: str | None, strategy: str, ground: Column | None = None) -> Extraction:
    """Records with their number ``_row`` as nodes or edges, as the mapping says.

    Keys: ``kind`` (``edge``, else a node), ``type``, ``id_template``, ``id_from``,
    ``source_template``, ``target_template``, ``attributes`` (column names, or
    attribute name to column), ``casts``. Other keys are ignored. Columns that
    do not exist give no attribute.
    """
    columns = {c: F.col(f"`{c}`") for c in records.columns if not c.startswith("_")}
    type = mapping.get("type") or default_type
    if not type:
        raise ValueError("the mapping needs a type: none is given and it is bound to no element")
    is_edge = mapping.get("kind", "node") == "edge"
    wanted = mapping.get("attributes") or ()
    pairs = wanted.items() if isinstance(wanted, Mapping) else ((c, c) for c in wanted)
    chosen = {a: json_text(columns[c]) for a, c in pairs if c in columns}
    entries = [x for a, v in apply_casts(chosen, mapping.get("casts")).items() for x in (F.lit(a), v)]
    attributes = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    index = F.col("_row")
    if ground is None:
        shown = mapping.get("id_from") or next((c for _, c in (wanted.items() if isinstance(wanted, Mapping) else ((c, c) for c in wanted))), "row")
        ground = selector("CellSelector", source_id=F.lit(source_id), row=index, column=F.lit(shown))
    common = [attributes.alias("attributes"), evidence(F.lit(source_id), strategy, [ground]).alias("evidence"), index.alias("seq")]
    if is_edge:
        ends = [mapping.get("source_template"), mapping.get("target_template")]
        if not all(ends):
            raise ValueError(f"an edge mapping needs source_template and target_template; there are {sorted(mapping)}")
        source, target = (fill_template(t, columns) for t in ends)
        fields = {**columns, "index": index}
        id = fill_template(mapping["id_template"], fields) if mapping.get("id_template") else F.concat(F.lit(f"{type}:"), index)
        return Extraction(edge_rows=records.select(id.alias("id"), source.alias("source"), target.alias("target"), F.lit(type).alias("type"), *common))
    if mapping.get("id_template"):
        id = fill_template(mapping["id_template"], columns)
    elif mapping.get("id_from"):
        if mapping["id_from"] not in columns:
            raise KeyError(f"id_from names {mapping['id_from']!r}; there are {sorted(columns)}")
        id = F.concat(F.lit(f"{type}:"), slug(columns[mapping["id_from"]]))
    else:
        id = F.concat(F.lit(f"{type}:"), index)
    return Extraction(node_rows=records.select(id.alias("id"), F.array(F.lit(type)).alias("types"), *common))


def _needs_index(mapping: Mapping[str, Any]) -> bool:
    """Whether row numbers show in ids, so that they must be gapless."""
    template = mapping.get("id_template")
    return "index" in template_fields(template) if template else not mapping.get("id_from")


def _default(context: ExtractionContext) -> str | None:
    return context.element_type.id if context.element_type else None


def _counted(records: DataFrame, mapping: Mapping[str, Any]) -> DataFrame:
    """Row numbers as the order has them; gapless where ids show them."""
    if not _needs_index(mapping):
        return records
    return numbered(records, ["_row"], "_n").withColumn("_row", F.col("_n")).drop("_n")


@register_extractor("table_map")
class TableMap:
    """Each record of a table source is a node or an edge; an unknown source gives nothing."""

    def __init__(self, records_source: str, **mapping: Any) -> None:
        self.source, self.mapping = records_source, mapping

    def __call__(self, context: ExtractionContext) -> Extraction:
        records = context.sources.table(context.spark, self.source)
        if records is None:
            return Extraction()
        return map_records(_counted(records, self.mapping), self.mapping, self.source, _default(context), "query:table_map")


QUERY = re.compile(r"\s*(\(|select\b|with\b|values\b|from\b|table\b)", re.IGNORECASE)


QUOTED = re.compile(r"""('(?:[^'\\]|\\.|'')*')|"((?:[^"]|"")*)\"""")


def columns_quoted(sql: str) -> str:
    """A query with ``"names"`` as Spark quotes them, as the standard has it; texts stay."""
    return QUOTED.sub(lambda m: m[1] or "`" + m[2].replace('""', '"').replace("`", "``") + "`", sql.rstrip().rstrip(";"))


@register_extractor("sql")
class SqlExtractor:
    """A query over a table source, seen as ``t`` with all columns as text, then mapped.

    Parameters are positional. Other views of the session can be joined. Only
    queries are taken, no statements that change anything. The result's plan
    continues in the mapping; nothing is materialised in between.
    """

    def __init__(self, records_source: str, sql: str, params: Sequence[Any] = (), **mapping: Any) -> None:
        self.source, self.sql, self.params, self.mapping = records_source, sql, list(params), mapping

    def query(self, spark: SparkSession, records: DataFrame) -> DataFrame:
        if not QUERY.match(self.sql):
            raise ValueError("the sql strategy takes a query")
        texts = records.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in records.columns if not c.startswith("_")))
        view = f"_records_{uuid.uuid4().hex}"
        texts.createOrReplaceTempView(view)
        try:  # a view named t of the session stays as it is, behind the query's own t
            return spark.sql(f"WITH t AS (SELECT * FROM {view}) SELECT * FROM ({columns_quoted(self.sql)})", args=self.params or None)
        finally:
            spark.catalog.dropTempView(view)

    def __call__(self, context: ExtractionContext) -> Extraction:
        records = context.sources.table(context.spark, self.source)
        if records is None or not [c for c in records.columns if not c.startswith("_")]:
            return Extraction()
        out = self.query(context.spark, records).withColumn("_row", F.monotonically_increasing_id())
        return map_records(_counted(out, self.mapping), self.mapping, self.source, _default(context), "query:sql")


# JSON ------------------------------------------------------------------------


def select_path(value: Any, path: str | None) -> list[Any]:
    """Items of a driver-side JSON document: keys, ``[n]``, ``[*]`` and ``[]`` steps; JMESPath beyond those where its library is there."""
    value = value.value if isinstance(value, JsonFile) else value
    if path is None or PATH.fullmatch(path):
        return walked(value, steps(path))
    try:
        import jmespath
    except ImportError as missing:
        raise ImportError(f"the path {path!r} needs the library jmespath") from missing
    found = jmespath.search(path, value)
    return [] if found is None else list(found) if isinstance(found, list) else [found]


OPERATORS = ("$gt", "$lt", "$in", "$ne")


def check_where(where: Mapping[str, Any] | None) -> None:
    for test in (where or {}).values():
        if isinstance(test, Mapping) and "$in" in test and not isinstance(test["$in"], (list, tuple, set, frozenset)):
            raise ValueError(f"$in needs a collection, not {test['$in']!r}")


def _loose(text: Column) -> Column:
    """A JSON value as a number: numbers, and texts that spell one; truth values are none."""
    from ..functions import json_value

    plain = F.trim(json_value(text))
    return F.when(~text.isin("true", "false"), F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double")))


def where_column(where: Mapping[str, Any] | None, value: Column) -> Column:
    """The predicate over ``value``, a map of JSON texts. Unknown operators hold; a missing field is unequal to all."""
    from ..functions import json_value, same_value

    check_where(where)
    holds = F.lit(True)
    for name, test in (where or {}).items():
        own = F.get(F.array(F.coalesce(value[name], F.lit("null"))), F.lit(0))
        literal = lambda v: F.lit(json.dumps(v, ensure_ascii=False))
        if not isinstance(test, Mapping):
            holds &= same_value(own, literal(test))
            continue
        for op, operand in test.items():
            if op in ("$gt", "$lt"):
                a, b = _loose(own), _loose(literal(operand))
                texts = own.startswith('"') & literal(operand).startswith('"') & (a.isNull() | b.isNull())
                x, y = json_value(own), json_value(literal(operand))
                holds &= F.coalesce(F.when(texts, x > y if op == "$gt" else x < y).otherwise(a > b if op == "$gt" else a < b), F.lit(False))
            elif op == "$in":
                any_of = F.lit(False)
                for v in operand:
                    any_of |= same_value(own, literal(v))
                holds &= any_of
            elif op == "$ne":
                holds &= ~same_value(own, literal(operand))
    return holds


def json_records(documents: DataFrame, json: str, path: str | None = None) -> DataFrame:
    """Items of JSON documents in a column, distributed: other columns, ``_i``, ``item`` as a map of JSON texts.

    ``path`` has keys and at most one ``[*]`` at its end.
    """
    steps = [] if path in (None, "", "$") else [s for s in path.removesuffix("[*]").split(".") if s]
    own = F.col(json)
    for s in steps:
        own = F.get_json_object(own, f"$['{s}']")
    if path and path.endswith("[*]"):
        keep = [c for c in documents.columns if c != json]
        listed = documents.select(*keep, F.posexplode(F.from_json(own, "array<string>")).alias("_i", "_item"))
        return listed.withColumn("item", raw_map(F.col("_item"))).drop("_item")
    return documents.withColumn("_i", F.lit(0)).withColumn("item", raw_map(own)).drop(json)


def raw_map(text: Column) -> Column:
    """The fields of a JSON object as JSON texts."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _members(items: pd.Series) -> pd.Series:
    """The fields of JSON objects as JSON texts, as the driver would write them."""
    return items.map(lambda text: {k: json.dumps(v, ensure_ascii=False) for k, v in json.loads(text).items()})


@register_extractor("json_query")
class JsonQuery:
    """Items of a JSON source that a path selects and a predicate keeps, then mapped.

    The source is one JSON value, or a DataFrame with a document in ``column`` of each row, whose items are
    numbered through in the order of ``_row``.
    """

    def __init__(self, records_source: str, select: str | None = None, where: Mapping[str, Any] | None = None, column: str = "json", **mapping: Any) -> None:
        check_where(where)
        self.source, self.select, self.where, self.column, self.mapping = records_source, select, where, column, mapping

    def _fields(self) -> set[str]:
        """The fields of an item that the mapping needs."""
        wanted = self.mapping.get("attributes") or ()
        out = set(wanted.values() if isinstance(wanted, Mapping) else wanted)
        for name, given in self.mapping.items():
            if name.endswith("_template") and given:
                out |= set(template_fields(given))
        return out | ({self.mapping["id_from"]} if self.mapping.get("id_from") else set())

    def _spread(self, content: Any) -> DataFrame | None:
        """Selected values of a file, in Spark; None where only the driver can select."""
        plain = self.select is None or PATH.fullmatch(self.select)
        return content.rows(self.select) if isinstance(content, JsonFile) and plain else None

    def __call__(self, context: ExtractionContext) -> Extraction:
        found = context.sources.get(self.source)
        if found is None:
            return Extraction()
        if isinstance(found.content, DataFrame):
            own = found.content if "_row" in found.content.columns else stored(found.content.withColumn("_row", F.monotonically_increasing_id()), "documents")
            items = json_records(own.select("_row", F.col(self.column).alias("_json")), "_json", self.select)
            frame = numbered(items.select("_row", "_i", F.col("item").alias("_item")), ["_row", "_i"], "_original").drop("_row", "_i")
            names = sorted(self._fields())
        elif (rows := self._spread(found.content)) is not None:
            items = rows.where(F.col("item").startswith("{")).select("_i", "_j", _members(F.col("item")).alias("_item"))
            frame = numbered(items, ["_i", "_j"], "_original").drop("_i", "_j")
            names = sorted(self._fields())
        else:
            items = [x for x in select_path(found.content, self.select) if isinstance(x, Mapping)]
            names = sorted({k for x in items for k in x})
            rows = [(i, {k: json.dumps(v, ensure_ascii=False) for k, v in x.items()}) for i, x in enumerate(items)]
            frame = context.spark.createDataFrame(rows, "_original long, _item map<string,string>")
        kept = numbered(frame.where(where_column(self.where, F.col("_item"))), ["_original"], "_row")
        path = selector("JsonPathSelector", source_id=F.lit(self.source), expression=F.concat(F.lit(f"{self.select or '$'}["), F.col("_row"), F.lit("]")))
        original = selector("JsonPathSelector", source_id=F.lit(self.source), expression=F.concat(F.lit(f"{self.select or '$'}["), F.col("_original"), F.lit("]")))
        return _mapped_items(kept, names, self.mapping, self.source, _default(context), path, original)


def _mapped_items(kept: DataFrame, names: list[str], mapping: Mapping[str, Any], source: str, default: str | None, *grounds: Column) -> Extraction:
    """Items as records whose columns are plain texts for ids, with attributes taken from the JSON texts."""
    from ..functions import json_value

    flat = kept.select("_row", "_original", "_item", *(json_value(F.col("_item")[n]).alias(n) for n in names if not n.startswith("_")))
    made = map_records(flat, {**mapping, "attributes": ()}, source, default, "query:json_query", grounds[0])
    wanted = mapping.get("attributes") or ()
    pairs = list(wanted.items()) if isinstance(wanted, Mapping) else [(c, c) for c in wanted]
    entries = [F.when(F.map_contains_key("_item", F.lit(c)), F.struct(F.lit(a).alias("key"), apply_casts({a: F.col("_item")[c]}, mapping.get("casts"))[a].alias("value"))) for a, c in pairs]
    attributes = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else F.create_map().cast("map<string,string>")
    rows = made.node_rows if made.node_rows is not None else made.edge_rows
    own = flat.select(F.col("_row").alias("seq"), attributes.alias("attributes"), evidence(F.lit(source), "query:json_query", list(grounds)).alias("evidence"))
    joined = rows.drop("attributes", "evidence").join(own, "seq")
    return Extraction(node_rows=joined) if made.node_rows is not None else Extraction(edge_rows=joined)

