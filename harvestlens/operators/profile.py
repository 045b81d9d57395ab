"""Shape, columns and samples of a data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_or_empty(name: str) -> Column:
    """SQL NULL or the empty string. A NaN is a value."""
    return F.col(f"`{name}`").isNull() | (F.col(f"`{name}`").cast("string") == "")


def profile_shape(df: DataFrame, dataset: str) -> DataFrame:
    """One row: dataset, rows, columns. Counts without reading any column."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset).alias("dataset"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
    )


def profile_columns(df: DataFrame, dataset: str) -> DataFrame:
    """One row per column: dataset, ordinal, column, dtype, n_null.

    A single aggregation pass counts the NULLs of all columns; the one-row
    result is then turned into rows. Several profiles unioned make a column
    catalog, the input of the schema checks.
    """
    counts = df.agg(
        *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]
    )
    described = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("ordinal"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"n{i}").alias("n_null"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.lit(dataset).alias("dataset"), F.inline(described))


def profile_sample(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by an explicit order (a distributed top-n, no full sort)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.orderBy(*order_by).limit(n)


def summarize(df: DataFrame, dataset: str, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """Shape, columns, types and sample of a data set in one row.

    The sample is bounded by ``n``; it meets the one-row shape on the data set name.
    """
    sample = (
        profile_sample(df, order_by, n)
        .agg(F.array_sort(F.collect_list(F.struct(*order_by, F.to_json(F.struct("*")).alias("_row")))).alias("s"))
        .select(F.lit(dataset).alias("dataset"), F.col("s._row").alias("sample_rows"))
    )
    dtypes = [F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]
    return (
        profile_shape(df, dataset)
        .join(sample, "dataset")
        .select(
            "dataset",
            F.struct("rows", "columns").alias("shape"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
            F.create_map(*dtypes).alias("dtypes"),
            "sample_rows",
        )
    )
