"""Scalar functions, as SQL expressions where those are exact and as Arrow UDFs where not."""

from .text import (
    apply_casts,
    cast_value,
    cosine,
    fill_template,
    json_text,
    json_value,
    normalized,
    normalized_text,
    normalize_entity,
    number,
    same_value,
    sequence_ratio,
    slug,
    slug_fast,
    slug_text,
    template_fields,
)

__all__ = [
    "apply_casts",
    "cast_value",
    "cosine",
    "fill_template",
    "json_text",
    "json_value",
    "normalized",
    "normalized_text",
    "normalize_entity",
    "number",
    "same_value",
    "sequence_ratio",
    "slug",
    "slug_fast",
    "slug_text",
    "template_fields",
]
