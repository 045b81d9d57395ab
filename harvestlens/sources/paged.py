"""Previews of paged documents and summaries of tables found on pages, over already decoded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAGE_TEXT = 500
SAMPLE_ROWS = 5


def preview_pages(
    pages: DataFrame, doc: str, page: str, text: str, max_pages: int = 3
) -> DataFrame:
    """First pages per document: doc, page, text_sample, total_pages, pages_previewed.

    Every map task keeps at most ``max_pages`` rows per document before the
    shuffle; the totals come from a separate map-side count, since a count in
    the same window would undo that limit.
    """
    if max_pages < 1:
        raise ValueError("max_pages must be at least 1")
    order = Window.partitionBy(doc).orderBy(page)
    first = (
        pages.select(doc, page, F.left(F.coalesce(text, F.lit("")), F.lit(PAGE_TEXT)).alias("text_sample"))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= max_pages)
        .drop("_n")
    )
    totals = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("total_pages"))
    return first.join(totals, doc).withColumn(
        "pages_previewed", F.least("total_pages", F.lit(max_pages).cast("long"))
    )


def check_page_numbers(requests: DataFrame, pages: DataFrame, doc: str, page_number: str) -> DataFrame:
    """Add ``total_pages`` and ``error_type`` (``InvalidPageNumber``) to requested pages."""
    totals = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("total_pages"))
    joined = requests.join(totals, doc, "left").withColumn(
        "total_pages", F.coalesce("total_pages", F.lit(0).cast("long"))
    )
    n = F.col(page_number)
    outside = n.isNull() | (n < 1) | (n > F.col("total_pages"))
    return joined.withColumn("error_type", F.when(outside, "InvalidPageNumber")).withColumn(
        "message",
        F.when(outside, F.concat(F.lit("page_number "), n.cast("string"), F.lit(" out of range (1-"),
                                 F.col("total_pages").cast("string"), F.lit(")"))),
    )


def summarize_grids(
    rows: DataFrame,
    table: Sequence[str],
    order_by: Sequence[str],
    cells: Column,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Per table: row_count, col_count (width of the first row) and the first rows in order.

    The sample is cut per map task before the shuffle and counts are partial,
    so one huge table does not gather in one task.
    """
    order = Window.partitionBy(*table).orderBy(*order_by)
    counts = rows.groupBy(*table).agg(F.count(F.lit(1)).alias("row_count"))
    first = (
        rows.select(*table, *order_by, cells.alias("_cells"))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= sample_rows)
        .groupBy(*table)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_cells"))), lambda r: r["_cells"]).alias("sample"))
    )
    return counts.join(first, list(table)).select(
        *table,
        "row_count",
        F.size(F.col("sample")[0]).cast("long").alias("col_count"),
        F.col("sample").alias("sample_rows"),
    )


def count_tables(summaries: DataFrame, page: Sequence[str]) -> DataFrame:
    """Number of tables per page."""
    return summaries.groupBy(*page).agg(F.count(F.lit(1)).alias("table_count"))
