"""Column helpers for model replies: JSON inside loose text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import col, strip

QUOTES = "\"'"


def unfence(c: Column | str) -> Column:
    """Reply text without Markdown code fences."""
    text = strip(c)
    plain = strip(F.regexp_replace(text, r"(?dm)^```(?:json)?\s*|\s*```$", ""))
    return F.when(F.contains(text, F.lit("```")), plain).otherwise(text)


def braces(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; empty when there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(c: Column) -> Column:
    """The text as one JSON value, or null: nothing may follow the value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    only = lambda w: F.when(
        F.try_variant_get(w, "$[1]", "variant").isNull(), F.try_variant_get(w, "$[0]", "variant")
    )
    return F.when(c != "", let(wrapped, only))


def kind(v: Column) -> Column:
    """``object``, ``array``, ``string``, ``null`` or another scalar kind of a variant."""
    named = lambda s: (
        F.when(s.isNull(), F.lit("missing"))
        .when(F.startswith(s, F.lit("OBJECT")), "object")
        .when(F.startswith(s, F.lit("ARRAY")), "array")
        .when(s == "STRING", "string")
        .when(s == "VOID", "null")
        .otherwise("scalar")
    )
    return let(F.schema_of_variant(v), named)


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def list_at(v: Column, path: str) -> Column:
    """Variant elements of an array member; anything else is an empty list."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), empty)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def clean_id(c: Column) -> Column:
    return strip(strip(c), QUOTES)


def unpad(c: Column) -> Column:
    """Without leading zeros; all zeros become ``0``."""
    bare = F.ltrim(c, F.lit("0"))
    return F.when((bare == "") & (c != ""), F.lit("0")).otherwise(bare)
