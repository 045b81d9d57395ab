"""Helpers shared by the operators: written tables, numbering, words, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.session import scratch_dir

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting by which the shuffle files of a query go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no recomputation before it.

    Once it is written, no one reads the shuffles that made it, so their files go at once.
    """
    conf, path = df.sparkSession.conf, scratch_dir(df.sparkSession, label)
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, rows: Callable[[list[dict]], dict], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch: a dict of columns as Python lists or arrays in, the same out."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                columns = rows(dict(zip(part.schema.names, part.columns, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)


def numbered_rows(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(row, number) of every row, written, and what makes the rows' own columns of a table with ``row`` again.

    A written number names a row for sure: rows may be equal, and doc_id may be missing or repeated.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = saved(docs.select(row, F.monotonically_increasing_id().alias("number")), "rows")
    return rows, lambda kept: kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def text_key(text: Column) -> Column:
    """Hash of a text; with the document number it names a row. NULL has a value of its own."""
    return F.xxhash64(text)


def numbered(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Number rows from 0 in ascending order of ``by`` (NULL first).

    Rows are range-partitioned once and written. Each partition numbers its own
    rows; the only table that is gathered has one row per partition.
    """
    ranged = saved(
        keys.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in by]))
    return (
        ranged.withColumn("_inside", inside)
        .join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_inside") - 1)
        .drop("_part", "_before", "_inside")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge (a, b).

    Alternates large-star and small-star steps, which at least halve the depth and
    keep no more edges than before, until the edges form stars. Each round is written.
    """
    now = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = saved(
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct(),
            "edges",
        )
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


#: Bits of a membership filter. It stays this size whatever the data: beyond, it only passes more rows.
FILTER_BITS = 2**24


def membership(hashes: DataFrame) -> DataFrame:
    """(_word, _bits): a bitmap of the one column of hashes, at most FILTER_BITS / 64 rows, so safe to broadcast."""
    (name,) = hashes.columns
    at = hashes.select(F.pmod(F.col(name), F.lit(FILTER_BITS)).alias("_at"))
    return saved(
        at.groupBy(F.expr("_at div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))").alias("_bits")),
        "filter",
    )


def flagged(df: DataFrame, hashed: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column: False where the hash certainly is not in the bitmap. Rows stay where they are."""
    at = F.pmod(hashed, F.lit(FILTER_BITS))
    return (
        df.withColumn("_at", at)
        .withColumn("_word", F.expr("_at div 64"))
        .join(F.broadcast(bitmap), "_word", "left")
        .withColumn(name, F.expr("coalesce(shiftright(_bits, cast(_at % 64 as int)) & 1, 0) = 1"))
        .drop("_at", "_word", "_bits")
    )
