"""Regular expressions over text sources.

Patterns are Python's, for their semantics, and run in Arrow batches: a task
sends matches, not texts, onwards. ``find`` takes several patterns at once, so
strategies over the same texts can share one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..evidence import evidence, selector
from ..functions import apply_casts, json_text, slug, template_fields
from ..functions.text import fill_template
from ..storage import numbered
from .context import Extraction, ExtractionContext, register_extractor

#: Characters kept on both sides of a match.
CONTEXT = 24
MATCHES = "ordinal long, source_id string, p int, m int, start long, stop long, exact string, prefix string, suffix string, groups map<string,string>"


def find(texts: DataFrame, patterns: Sequence[str], flags: int = 0) -> DataFrame:
    """All matches of all patterns, as ``MATCHES``; groups that did not take part are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p, flags) for p in patterns]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        names = [x.split()[0] for x in MATCHES.split(", ")]
        for batch in batches:
            rows = []
            for ordinal, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for p, pattern in enumerate(compiled):
                    for m, found in enumerate(pattern.finditer(text or "")):
                        a, b = found.span()
                        groups = [(k, v) for k, v in found.groupdict().items() if v is not None]
                        rows.append((ordinal, source, p, m, a, b, found[0], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], groups))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for p in patterns:
        re.compile(p, flags)  # a bad pattern fails here
    return texts.select("ordinal", "source_id", "text").mapInArrow(run, MATCHES)


def find_plain(texts: DataFrame, pattern: str) -> DataFrame:
    """Matches of a Java pattern without groups, with offsets, in SQL only: ``ordinal, source_id, m, start, stop, exact``."""
    matches, around = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    found = texts.where(F.col("text").rlike(pattern)).select("ordinal", "source_id", F.posexplode(F.arrays_zip(matches.alias("exact"), around.alias("before"))).alias("m", "x"))
    own = Window.partitionBy("ordinal", "source_id").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("x.before") + F.length("x.exact")
    start = F.coalesce(F.sum(size).over(own), F.lit(0)) + F.length("x.before")
    return found.withColumn("start", start).where("x.exact is not null").select("ordinal", "source_id", "m", "start", (F.col("start") + F.length("x.exact")).alias("stop"), F.col("x.exact").alias("exact"))


def _grounding() -> list[Column]:
    quote = selector("TextQuoteSelector", exact=F.col("exact"), prefix=F.col("prefix"), suffix=F.col("suffix"))
    return [quote, selector("TextPositionSelector", start=F.col("start"), end=F.col("stop"), source_id=F.col("source_id"))]


def _cast_groups(names: Sequence[str], casts: Mapping[str, str] | None) -> Column:
    """Matched groups as an attribute map; an absent group is an absent key."""
    given = {n: json_text(F.col("groups")[n]) for n in names}
    entries = [F.when(F.col("groups")[n].isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in apply_casts(given, casts).items()]
    listed = F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(listed)


def _type(given: str | None, context: ExtractionContext) -> str:
    if given or context.element_type:
        return given or context.element_type.id
    raise ValueError("the strategy needs a type: none is given and it is bound to no element")


def _names(pattern: str, flags: int) -> list[str]:
    return list(re.compile(pattern, flags).groupindex)




@register_extractor("regex_node")
class RegexNodeExtractor:
    """A node for each match; named groups become attributes, cast before the id is made."""

    def __init__(self, pattern: str, node_type: str | None = None, flags: int = 0, id_attribute: str | None = None, casts: Mapping[str, str] | None = None) -> None:
        self.pattern, self.node_type, self.flags, self.id_attribute, self.casts = pattern, node_type, flags, id_attribute, casts

    def rows(self, matches: DataFrame, type: str) -> DataFrame:
        from ..functions import json_value

        attributes = _cast_groups(_names(self.pattern, self.flags), self.casts)
        made = numbered(matches, ["ordinal", "source_id", "m"]).withColumn("attributes", attributes)
        key = json_value(F.col("attributes")[self.id_attribute]) if self.id_attribute else F.col("exact")
        return made.select(
            F.concat(F.lit(f"{type}:"), slug(key)).alias("id"),
            F.array(F.lit(type)).alias("types"),
            "attributes",
            evidence(F.col("source_id"), "pattern:RegexNodeExtractor", _grounding()).alias("evidence"),
            F.col("i").alias("seq"),
        )

    def __call__(self, context: ExtractionContext) -> Extraction:
        texts = context.sources.texts(context.spark)
        return Extraction(node_rows=self.rows(find(texts, [self.pattern], self.flags), _type(self.node_type, context)))


@register_extractor("regex_edge")
class RegexEdgeExtractor:
    """An edge for each match, numbered from 0 over all sources in order.

    Templates see every group; a template that meets a group which did not take
    part is an error at run time, one that names no group is an error at once.
    """

    def __init__(self, pattern: str, source_id_template: str, target_id_template: str, edge_type: str | None = None, flags: int = 0, casts: Mapping[str, str] | None = None, exclude_groups: Sequence[str] = ()) -> None:
        self.pattern, self.templates, self.edge_type, self.flags, self.casts, self.exclude = pattern, (source_id_template, target_id_template), edge_type, flags, casts, tuple(exclude_groups)

    def rows(self, matches: DataFrame, type: str) -> DataFrame:
        names = _names(self.pattern, self.flags)
        needed = {n: F.coalesce(F.col("groups")[n], F.raise_error(F.lit(f"group {n!r} of a template did not take part in a match"))) for n in names}
        source, target = (fill_template(t, needed) for t in self.templates)
        attributes = _cast_groups([n for n in names if n not in self.exclude], self.casts)
        order = numbered(matches.select("ordinal", "source_id", "m", "start", "stop", "exact", "prefix", "suffix", source.alias("source"), target.alias("target"), attributes.alias("attributes")), ["ordinal", "source_id", "m"])
        return order.select(
            F.concat(F.lit(f"{type}:"), slug(F.col("source")), F.lit("->"), slug(F.col("target")), F.lit(":"), F.col("i")).alias("id"),
            "source",
            "target",
            F.lit(type).alias("type"),
            "attributes",
            evidence(F.col("source_id"), "pattern:RegexEdgeExtractor", _grounding()).alias("evidence"),
            F.col("i").alias("seq"),
        )

    def __call__(self, context: ExtractionContext) -> Extraction:
        for t in self.templates:
            for n in template_fields(t):
                if n not in _names(self.pattern, self.flags):
                    raise KeyError(f"template {t!r} needs the group {n!r}; the pattern has {_names(self.pattern, self.flags)}")
        texts = context.sources.texts(context.spark)
        return Extraction(edge_rows=self.rows(find(texts, [self.pattern], self.flags), _type(self.edge_type, context)))


@register_extractor("function")
def function_extractor(func: Callable[[ExtractionContext], Extraction]) -> Callable[[ExtractionContext], Extraction]:
    """A callable as a strategy."""
    return func
