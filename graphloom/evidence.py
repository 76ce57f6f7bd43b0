"""Audit records of extracted elements: provenance, grounding and confidence, as Spark structs and driver-side values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SELECTOR = "struct<kind:string,source_id:string,exact:string,prefix:string,suffix:string,start:long,end:long,row:long,column:string,expression:string,page:long,bbox:array<double>,normalized:boolean>"
PROVENANCE = "struct<derived_from:string,generated_by:string,attributed_to:string,attributed_kind:string,coded_by:string,was_revision_of:string,generated_at:string,version:string>"
CONFIDENCE = "struct<method:string,score:double,verified:boolean,review_status:string>"
EVIDENCE = f"struct<provenance:{PROVENANCE},grounding:array<{SELECTOR}>,confidence:{CONFIDENCE}>"
EVIDENCE_TABLE = f"element_id string, attribute string, evidence {EVIDENCE}"

AUTO, NEEDS_REVIEW, CONFIRMED, REJECTED, CORRECTED = "auto", "needs_review", "confirmed", "rejected", "corrected"
DETERMINISTIC, VERBALIZED, SELF_CONSISTENCY = "deterministic", "verbalized", "self_consistency"
SOFTWARE_AGENT, PERSON = "software_agent", "person"


class _Selector:
    """Fields in order become the dict; ``names`` renames, empty optional ones are left out."""

    names: ClassVar[dict[str, str]] = {"source_id": "source"}

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": type(self).__name__}
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None:
                out[self.names.get(f.name, f.name)] = list(value) if isinstance(value, tuple) else value
        return out


@dataclass(frozen=True)
class TextQuoteSelector(_Selector):
    exact: str
    prefix: str = ""
    suffix: str = ""


@dataclass(frozen=True)
class TextPositionSelector(_Selector):
    start: int
    end: int
    source_id: str | None = None


@dataclass(frozen=True)
class CellSelector(_Selector):
    source_id: str
    row: int
    column: str


@dataclass(frozen=True)
class JsonPathSelector(_Selector):
    expression: str
    source_id: str | None = None


@dataclass(frozen=True)
class PageSelector(_Selector):
    source_id: str
    page: int


@dataclass(frozen=True)
class BoundingBoxSelector(_Selector):
    source_id: str
    page: int
    bbox: tuple
    normalized: bool = True


@dataclass(frozen=True)
class Provenance:
    derived_from: str
    generated_by: str
    attributed_to: str | None = None
    attributed_kind: str | None = None
    coded_by: str | None = None
    was_revision_of: str | None = None
    generated_at: str | None = None
    version: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    is_machine = property(lambda self: self.attributed_kind == SOFTWARE_AGENT and self.was_revision_of is None)
    is_manual = property(lambda self: self.attributed_kind == PERSON and self.was_revision_of is None)
    is_corrected = property(lambda self: self.attributed_kind == PERSON and self.was_revision_of is not None)


@dataclass(frozen=True)
class Confidence:
    method: str
    score: float
    verified: bool | None = None
    review_status: str = AUTO

    def to_dict(self) -> dict[str, Any]:
        out = {"method": self.method, "score": self.score, "review_status": self.review_status}
        return out if self.verified is None else out | {"verified": self.verified}


@dataclass(frozen=True)
class Evidence:
    provenance: Provenance
    grounding: Sequence[Any] = ()
    confidence: Confidence | None = None

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"provenance": self.provenance.to_dict(), "grounding": [g.to_dict() for g in self.grounding]}
        return out if self.confidence is None else out | {"confidence": self.confidence.to_dict()}

    def to_row(self) -> dict[str, Any]:
        """For a column of type ``EVIDENCE``."""
        grounding = [{"kind": type(g).__name__, **{f.name: list(v) if isinstance(v := getattr(g, f.name), tuple) else v for f in fields(g)}} for g in self.grounding]
        confidence = None if self.confidence is None else {f.name: getattr(self.confidence, f.name) for f in fields(Confidence)}
        return {"provenance": {f.name: getattr(self.provenance, f.name) for f in fields(Provenance)}, "grounding": grounding, "confidence": confidence}


def deterministic_evidence(*, source_id: str, generated_by: str, grounding: Sequence[Any] = ()) -> Evidence:
    return Evidence(Provenance(source_id, generated_by), tuple(grounding), Confidence(DETERMINISTIC, 1.0, True))


# as columns --------------------------------------------------------------------


def _struct(shape: str, /, **given: Column) -> Column:
    """A struct of the given type; fields that are not given are null."""
    names = [x.split(":", 1)[0] for x in _split(shape.removeprefix("struct<").removesuffix(">"))]
    return F.struct(*(given.get(n, F.lit(None)).alias(n) for n in names)).cast(shape)


def _split(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def selector(kind: str, /, **given: Column) -> Column:
    return _struct(SELECTOR, kind=F.lit(kind), **given)


def evidence(source_id: Column, generated_by: str, grounding: list[Column]) -> Column:
    """Evidence of a deterministic strategy."""
    return F.struct(
        _struct(PROVENANCE, derived_from=source_id, generated_by=F.lit(generated_by)).alias("provenance"),
        F.array(*grounding).cast(f"array<{SELECTOR}>").alias("grounding"),
        _struct(CONFIDENCE, method=F.lit(DETERMINISTIC), score=F.lit(1.0), verified=F.lit(True), review_status=F.lit(AUTO)).alias("confidence"),
    ).cast(EVIDENCE)


def is_machine(provenance: Column) -> Column:
    return provenance["attributed_kind"].eqNullSafe(SOFTWARE_AGENT) & provenance["was_revision_of"].isNull()


def is_manual(provenance: Column) -> Column:
    return provenance["attributed_kind"].eqNullSafe(PERSON) & provenance["was_revision_of"].isNull()


def is_corrected(provenance: Column) -> Column:
    return provenance["attributed_kind"].eqNullSafe(PERSON) & provenance["was_revision_of"].isNotNull()


def set_attribute_evidence(table: DataFrame, element_id: str, attribute: str, record: Evidence) -> DataFrame:
    """The evidence table with one attribute's record replaced or added."""
    spark = table.sparkSession
    own = spark.createDataFrame([(element_id, attribute, record.to_row())], EVIDENCE_TABLE)
    return table.where(~(F.col("element_id").eqNullSafe(element_id) & F.col("attribute").eqNullSafe(attribute))).unionByName(own)


def attribute_evidence(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """Evidence for each ``element_id, attribute`` wanted: the attribute's own, else the element's."""
    own = table.where("attribute is not null").select("element_id", "attribute", F.col("evidence").alias("own"))
    whole = table.where("attribute is null").select("element_id", F.col("evidence").alias("whole"))
    found = wanted.join(own, ["element_id", "attribute"], "left").join(whole, "element_id", "left")
    return found.select("element_id", "attribute", F.coalesce("own", "whole").alias("evidence"))
