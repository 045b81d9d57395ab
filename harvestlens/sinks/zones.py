"""The raw and the processed zone."""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from harvestlens.functions.text import path_of
from harvestlens.operators.fetch import RAW_ROOT, check_fetch_requests

# Parts of a source that a landing rewrites on their own.
SLOTS = 64


def accepted_fetches(fetches: DataFrame) -> DataFrame:
    """Fetches whose source and file name may become a path."""
    return (
        check_fetch_requests(fetches)
        .filter("error_type IS NULL")
        .drop("error_type", "message", "recoverable")
    )


def _append(df: DataFrame, root: str, by: str) -> None:
    # The rebalance step puts the rows of a source together, so that a task does not open a
    # file per source, and lets AQE split a source that holds much of the data.
    df.hint("rebalance", by).write.partitionBy(by).mode("append").parquet(root)


def _slot() -> Column:
    # A landing rewrites only the slots of a source it brings files for.
    return F.pmod(F.xxhash64("filename"), F.lit(SLOTS)).cast("int")


def _latest(fetches: DataFrame, order_by: str | None) -> DataFrame:
    """One row per file: the last by ``order_by``, of equal ones that with the largest digest."""
    rest = [c for c in fetches.columns if c not in ("source_id", "filename")]
    if not rest:
        return fetches.distinct()
    place = [F.sha2("content", 256)] if "content" in rest else [F.sha2(F.to_json(F.struct(*rest)), 256)]
    if order_by:
        place.insert(0, F.col(f"`{order_by}`"))
    return (
        fetches.groupBy("source_id", "filename")
        .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*place)).alias("_row"))
        .select("source_id", "filename", "_row.*")
        .select(*[F.col(f"`{c}`") for c in fetches.columns])
    )


def _exists(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.format("binaryFile").load(root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def land_raw(fetches: DataFrame, raw_root: str, order_by: str | None = None) -> DataFrame:
    """Land fetched bytes (source_id, filename, content, ...) below ``raw_root`` and return their manifest.

    A file is named by (source_id, filename) and its last write wins, as on a file
    system: within ``fetches`` the last by ``order_by``, and any of them over what lies
    there. So landing the same fetches again changes nothing, and a landing that broke
    off is repeated. ``fetches`` is read three times, twice for its names only.

    The zone is partitioned by source and a slot of the file name. Slots that get files
    are written anew with the files they keep; the others are not read. They are
    replaced at the end of the job one after the other: readers wait for it.
    """
    spark = fetches.sparkSession
    accepted = accepted_fetches(fetches)
    names = accepted.select("source_id", "filename").distinct()
    rows = _latest(accepted, order_by).withColumn("slot", _slot())
    if _exists(spark, raw_root):
        touched = names.select("source_id", _slot().alias("slot")).distinct()
        lying = (
            spark.read.schema(_zone_schema(accepted)).parquet(raw_root)
            .join(touched, ["source_id", "slot"], "left_semi")
            .join(names, ["source_id", "filename"], "left_anti")
        )
        rows = rows.unionByName(lying.select(*rows.columns))
    (
        rows.hint("rebalance", "source_id", "slot")
        .write.partitionBy("source_id", "slot")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(raw_root)
    )
    return written_manifest(fetches, raw_root)


def _zone_schema(fetches: DataFrame) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in fetches.schema] + [StructField("slot", IntegerType())])


def _manifest_columns(raw_root: str) -> list[Column]:
    return [
        F.lit(True).alias("success"),
        F.col("url"),
        F.col("source_id"),
        F.col("filename"),
        path_of(raw_root, F.col("source_id"), F.col("filename")).alias("file_path"),
        F.octet_length("content").cast("long").alias("bytes"),
        F.coalesce("content_type", F.lit("unknown")).alias("content_type"),
    ]


def written_manifest(fetches: DataFrame, raw_root: str, named_root: str = RAW_ROOT) -> DataFrame:
    """What lies below ``raw_root`` of the files named in ``fetches``, as :func:`landing_manifest` lists it."""
    accepted = accepted_fetches(fetches)
    names = accepted.select("source_id", "filename", _slot().alias("slot")).distinct()
    lying = fetches.sparkSession.read.schema(_zone_schema(accepted)).parquet(raw_root)
    return lying.join(names, ["source_id", "slot", "filename"], "left_semi").select(*_manifest_columns(named_root))


def landing_manifest(fetches: DataFrame, raw_root: str = RAW_ROOT, order_by: str | None = None) -> DataFrame:
    """What :func:`land_raw` would land: success, url, source_id, filename, file_path, bytes, content_type."""
    return _latest(accepted_fetches(fetches), order_by).select(*_manifest_columns(raw_root))


def read_zone(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Read a zone with a given schema, so that folder names are not guessed to be numbers."""
    return spark.read.schema(schema).parquet(root).select(*StructType.fromDDL(schema).names)


def _inside(path: str, root: str) -> bool:
    path, root = (posixpath.normpath(p.split("://", 1)[-1]) for p in (path, root))
    return path == root or path.startswith(root.rstrip("/") + "/")


def write_processed(df: DataFrame, processed_root: str, raw_root: str, by: str = "source_id") -> None:
    """Append processed rows below ``processed_root``; a target that overlaps the raw zone is refused."""
    if _inside(processed_root, raw_root) or _inside(raw_root, processed_root):
        raise ValueError("processed output must not be written into the raw zone")
    _append(df, processed_root, by)
