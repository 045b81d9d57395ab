"""Strict JSON reading on top of VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_pair(text: Column) -> Column:
    """Parse ``[text, digest]``; feed the result to :func:`strict_value`.

    The JSON reader ignores what follows a complete value. Wrapping the text
    in an array that must end with a digest of that same text makes trailing
    characters, joined values and unclosed brackets visible.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def strict_value(pair: Column, text: Column) -> Column:
    """The parsed value when ``text`` was exactly one JSON value, else NULL."""
    exact = (F.try_variant_get(pair, "$[1]", "string") == F.md5(text)) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    return F.when(exact, F.try_variant_get(pair, "$[0]", "variant"))


def kind_of(value: Column) -> Column:
    """Type name of a variant; NULL when there is no value at all."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("OBJECT"), F.lit(False))


def fields_of(value: Column) -> Column:
    """Object members as MAP<STRING, VARIANT>; NULL for anything but an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def truthy(value: Column) -> Column:
    """Python truth of a JSON value; NULL when the value is absent."""
    kind = kind_of(value)
    return (
        F.when(kind.isNull(), F.lit(None).cast("boolean"))
        .when(kind == "VOID", False)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), F.size(fields_of(value)) > 0)
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )
