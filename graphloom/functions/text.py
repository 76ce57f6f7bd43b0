"""Slugs, casts, templates, normalisation and similarity.

Attribute values travel as JSON text, one value in each map entry.
"""

from __future__ import annotations

import difflib
import re
import string
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that do not tell entities apart.
LEGAL_FORMS = ["inc", "ltd", "llc", "corp", "co", "company", "gmbh", "plc", "sa", "ag", "srl", "bv"]
HONORIFICS = ["dr", "mr", "mrs", "ms", "prof", "mme", "m", "the"]


def slug_text(value: str | None) -> str:
    """Lower-case letters and digits of any script, other runs as one dash; null is ``none``, nothing left is ``x``."""
    if value is None:
        return "none"
    folded = unicodedata.normalize("NFKC", value).strip().casefold()
    return "-".join("".join(c if c.isalnum() else " " for c in folded).split()) or "x"


@F.pandas_udf(T.StringType())
def _slug(values: pd.Series) -> pd.Series:
    return values.map(lambda v: slug_text(None if v is None or v != v else v))


def slug(value: Column) -> Column:
    """Slug of a text column: a plain expression for ASCII, Unicode folding in Arrow batches for the rest."""
    text = value.cast("string")
    return F.when(text.isNull(), "none").when(F.length(text) == F.octet_length(text), slug_fast(text)).otherwise(_slug(text))


def slug_fast(value: Column) -> Column:
    """Slug without Python; exact for ASCII and composed Latin letters other than those that case-fold to several."""
    text = value.cast("string")
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.when(text.isNull(), "none").otherwise(F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit("x")))


def json_text(value: Column) -> Column:
    """A value of any Spark type as JSON text."""
    boxed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def json_value(text: Column) -> Column:
    """The plain text of a JSON value: strings unquoted, others as written, ``null`` as null."""
    return F.when(text != "null", F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0)))


def number(text: Column) -> Column:
    """A JSON value as a number where it equals one; true is 1."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).when(text.rlike(r"^-?[0-9.]"), text.try_cast("double"))


def same_value(a: Column, b: Column) -> Column:
    """Whether two JSON values are equal, with 1, 1.0 and true the same."""
    return a.eqNullSafe(b) | F.coalesce(number(a) == number(b), F.lit(False))


def cast_value(text: Column, to: str) -> Column:
    """JSON text of a value cast to ``int``, ``float`` or ``number``.

    Texts lose all but digits, points and minus signs first; what is no number
    then stays as it was. Lists are cast element by element; booleans, nulls and
    objects do not change. ``int`` cuts fractions off. Numbers of 2**95 and beyond
    have no integer form here and stay as they were.
    """
    if to not in ("int", "float", "number"):
        raise ValueError(f"cannot cast to {to!r}; known: int, float, number")

    def one(value: Column, plain: Column) -> Column:
        kept = F.regexp_replace(plain, r"[^0-9.\-]", "")
        is_text = value.startswith('"')
        found = F.when(is_text, F.when(kept.rlike(r"^(-?\d+(\.\d+)?|-?\.\d+)$"), kept.cast("double"))).otherwise(number(value))
        # a double's integer part is two exact halves, whose product and sum a decimal holds
        high = F.floor(F.when(F.abs(found) < 2.0**95, found) / 2.0**32)
        low = found - high.cast("double") * 2.0**32
        large = high.cast("decimal(38,0)") * F.lit(2**32).cast("decimal(10,0)") + low.try_cast("long").cast("decimal(20,0)")
        whole = F.when(F.abs(found) < 2.0**63, found.try_cast("long").cast("string")).otherwise(large.cast("decimal(38,0)").cast("string"))
        shown = {"int": whole, "float": found.cast("string"), "number": F.when(found == F.floor(found), whole).otherwise(found.cast("string"))}[to]
        return F.coalesce(F.when(value.isin("true", "false", "null"), value), shown, value)

    listed = F.from_json(text, "array<string>")
    elements = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: one(json_text(x), x)), ", "), F.lit("]"))
    return F.when(text.startswith("["), elements).when(text.startswith("{"), text).otherwise(one(text, json_value(text)))


def apply_casts(attributes: Mapping[str, Column], casts: Mapping[str, str] | None) -> dict[str, Column]:
    """Cast the named attributes, given as JSON text."""
    return {k: cast_value(v, casts[k]) if casts and k in casts else v for k, v in attributes.items()}


def template_fields(template: str) -> list[str]:
    return [field for _, field, _, _ in string.Formatter().parse(template) if field is not None]


def fill_template(template: str, fields: Mapping[str, Column]) -> Column:
    """A template whose ``{fields}`` are replaced by slugs. Unknown fields are refused at once."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in fields:
                raise KeyError(f"template {template!r} needs {field!r}; there are {sorted(fields)}")
            parts.append(slug(fields[field]))
    return F.concat(*parts) if parts else F.lit("")


def normalize_entity(text: Column) -> Column:
    """An entity's name without case, punctuation, legal forms and honorifics."""
    words = F.split(F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}_\s]", " "), r"\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(LEGAL_FORMS + HONORIFICS)), " ")


def normalized_text(value: str) -> str:
    """Text without outer white space and case, inner white space as one space."""
    return re.sub(r"\s+", " ", value.strip()).casefold()


@F.pandas_udf(T.StringType())
def _normalized(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else normalized_text(v))


def normalized(text: Column) -> Column:
    """The same of a column: a plain expression for ASCII, Unicode folding in Arrow batches for the rest."""
    blank = F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
    plain = F.lower(F.regexp_replace(F.btrim(text, blank), r"[\s\x1c-\x1f]+", " "))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, plain).otherwise(_normalized(F.when(~ascii_only, text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut to the shorter; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    x, y = double(a), double(b)
    dot = total(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p * q))
    norms = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    return F.when(n == 0, 0.0).otherwise(F.coalesce(F.try_divide(dot, norms), F.lit(0.0)))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Lexical similarity of two texts by matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
