"""Several checks of one data set in one pass over it.

A check is a function of the frame and a prefix for its column names. It gives what to
aggregate per group of rows and how to put groups together, so that checks of any kind
share a scan: with a duplicate check the rows are grouped by its keys first, and every
other check rides along as a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.operators.profile import null_or_empty


@dataclass(frozen=True)
class Part:
    """One check as aggregates: ``partial`` per group, ``merged`` over groups, then verdict and detail."""

    name: str
    passed: Column
    detail: Column
    partial: Mapping[str, Column] = field(default_factory=dict)
    merged: Mapping[str, Column] = field(default_factory=dict)
    keys: tuple[str, ...] = ()


Check = Callable[[DataFrame, str], Part]


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("long")


def required_fields(required: Sequence[str]) -> Check:
    """Are all required columns there? Read off the schema."""

    def build(df: DataFrame, prefix: str) -> Part:
        missing = [f for f in required if f not in df.columns]
        return Part("required_fields", F.lit(not missing), F.struct(_texts(missing).alias("missing_fields")))

    return build


def schema(target: Mapping[str, object]) -> Check:
    """Are all columns of the target there? Columns it does not name are listed, unless it names none."""

    def build(df: DataFrame, prefix: str) -> Part:
        missing = [f for f in target if f not in df.columns]
        extra = [c for c in df.columns if c not in target] if target else []
        detail = F.struct(_texts(missing).alias("missing_fields"), _texts(extra).alias("extra_fields"))
        return Part("schema", F.lit(not missing), detail)

    return build


def types(target: Mapping[str, str]) -> Check:
    """Is the expected type name part of the column's, whatever the case? Absent columns are not judged."""

    def build(df: DataFrame, prefix: str) -> Part:
        observed = dict(df.dtypes)
        wrong = [
            (f, t, observed[f]) for f, t in target.items() if f in observed and t.lower() not in observed[f].lower()
        ]
        rows = [
            F.struct(F.lit(f).alias("field"), F.lit(t).alias("expected"), F.lit(o).alias("observed")) for f, t, o in wrong
        ]
        listed = F.array(*rows).cast("array<struct<field:string,expected:string,observed:string>>")
        return Part("types", F.lit(not wrong), F.struct(listed.alias("mismatches")))

    return build


def row_count(minimum: int = 1, maximum: int | None = None) -> Check:
    """Is the number of rows within inclusive bounds?"""

    def build(df: DataFrame, prefix: str) -> Part:
        n, top = F.col(f"{prefix}n"), F.lit(maximum).cast("long")
        return Part(
            "row_count",
            (n >= minimum) & (top.isNull() | (n <= top)),
            F.struct(n.alias("row_count"), F.lit(minimum).cast("long").alias("minimum"), top.alias("maximum")),
            {f"{prefix}n": F.count(F.lit(1))},
            {f"{prefix}n": _total(f"{prefix}n")},
        )

    return build


def duplicates(keys: Sequence[str]) -> Check:
    """Does a key occur more than once? Number of such keys, rows beyond the first of each, first and last key."""

    def build(df: DataFrame, prefix: str) -> Part:
        again = F.col(f"{prefix}n") > 1
        key = F.when(again, F.struct(*[F.col(f"{prefix}k{i}").alias(k) for i, k in enumerate(keys)]))
        return Part(
            "duplicates",
            F.col(f"{prefix}keys") == 0,
            F.struct(
                F.col(f"{prefix}keys").alias("duplicate_keys"),
                F.col(f"{prefix}rows").alias("surplus_rows"),
                F.col(f"{prefix}first").alias("first"),
                F.col(f"{prefix}last").alias("last"),
            ),
            {f"{prefix}n": F.count(F.lit(1))},
            {
                f"{prefix}keys": F.count_if(again),
                f"{prefix}rows": F.coalesce(F.sum(F.when(again, F.col(f"{prefix}n") - 1)), F.lit(0)).cast("long"),
                f"{prefix}first": F.min(key),
                f"{prefix}last": F.max(key),
            },
            tuple(keys),
        )

    return build


def date_range(date_field: str, min_date: str | None = None, max_date: str | None = None, mode: str = "string") -> Check:
    """Do all dates lie within inclusive bounds? Compared as in :func:`checks.check_date_range`."""
    if mode not in ("string", "date"):
        raise ValueError("mode must be 'string' or 'date'")

    def build(df: DataFrame, prefix: str) -> Part:
        value = F.col(f"`{date_field}`").cast("string")
        shown = value if mode == "string" else F.col(f"`{date_field}`").try_cast("date")
        below = F.coalesce(shown < F.lit(min_date).cast(mode), F.lit(False)) if min_date else F.lit(False)
        above = F.coalesce(shown > F.lit(max_date).cast(mode), F.lit(False)) & ~below if max_date else F.lit(False)
        outside = F.when(below | above, value)
        names = {name: f"{prefix}{name}" for name in ("below", "above", "lowest", "highest")}
        return Part(
            "date_range",
            F.col(names["below"]) + F.col(names["above"]) == 0,
            F.struct(*[F.col(c).alias(name) for name, c in names.items()]),
            {
                names["below"]: F.count_if(below),
                names["above"]: F.count_if(above),
                names["lowest"]: F.min(outside),
                names["highest"]: F.max(outside),
            },
            {
                names["below"]: _total(names["below"]),
                names["above"]: _total(names["above"]),
                names["lowest"]: F.min(names["lowest"]),
                names["highest"]: F.max(names["highest"]),
            },
        )

    return build


def nulls(fields: Sequence[str]) -> Check:
    """Are the fields never NULL or empty? A column the data set lacks counts as null on every row."""

    def build(df: DataFrame, prefix: str) -> Part:
        named = {f: f"{prefix}f{i}" for i, f in enumerate(sorted(set(fields)))}
        bad = F.array_compact(
            F.array(*[F.when(F.col(c) > 0, F.lit(f)) for f, c in named.items()]).cast("array<string>")
        )
        return Part(
            "nulls",
            F.size(bad) == 0,
            F.struct(bad.alias("fields_with_nulls")),
            {c: F.count_if(null_or_empty(f) if f in df.columns else F.lit(True)) for f, c in named.items()},
            {c: _total(c) for c in named.values()},
        )

    return build


def report(df: DataFrame, dataset: str, *checks: Check) -> DataFrame:
    """One row (dataset, check, passed, detail_json) per check, in one scan of ``df``.

    At most one check may look for duplicates: its keys group the rows, counted map-side
    first, and the only shuffle is that of the groups. An empty data set has no
    violations; only its row count can fail.
    """
    if not checks:
        raise ValueError("a report needs a check")
    parts = [build(df, f"_c{i}_") for i, build in enumerate(checks)]
    grouping = [(f"_c{i}_k{j}", k) for i, part in enumerate(parts) for j, k in enumerate(part.keys)]
    if sum(1 for part in parts if part.keys) > 1:
        raise ValueError("one report can look for duplicates of one key only")
    partial = [column.alias(name) for part in parts for name, column in part.partial.items()]
    merged = [column.alias(name) for part in parts for name, column in part.merged.items()]
    keys = [F.col(f"`{k}`").alias(name) for name, k in grouping]
    if not any(part.partial for part in parts):
        whole = df.sparkSession.range(1)
    else:
        whole = df.groupBy(*keys).agg(*partial).agg(*merged)
    rows = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(part.name).alias("check"),
            part.passed.alias("passed"),
            F.to_json(part.detail, {"ignoreNullFields": "false"}).alias("detail_json"),
        )
        for part in parts
    ]
    return whole.select(F.inline(F.array(*rows)))
