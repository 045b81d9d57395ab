"""Keeping costly expressions single."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row, whatever is built on top of them.

    The optimizer moves filters below projections and copies the projected
    expressions into them, parsing and regular expressions included, once per
    mention. It does not look through a generator, so the columns are produced
    by one that yields a single row. It stays inside code generation.
    """
    fields = [column.alias(name) for name, column in columns.items()]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))
