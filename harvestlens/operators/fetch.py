"""Fetch bookkeeping: request guard, outcome classes and storage paths. All are plain projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.staging import pinned
from harvestlens.functions.text import is_blank, path_of
from harvestlens.functions.urls import normalize_url, url_problem

RAW_ROOT = "storage/raw"
PROCESSED_ROOT = "storage/processed"


def normalize_urls(df: DataFrame, raw_url: str = "raw_url") -> DataFrame:
    """Add ``url_norm``."""
    return pinned(df, url_norm=normalize_url(F.col(raw_url)))


def validate_urls(df: DataFrame, raw_url: str = "raw_url") -> DataFrame:
    """Add ``url_norm``, ``valid``, ``error_type``, ``message``; a rejected URL is not recoverable."""
    return (
        pinned(normalize_urls(df, raw_url), message=url_problem(F.col("url_norm")))
        .withColumn("valid", F.col("message").isNull())
        .withColumn("error_type", F.when(~F.col("valid"), "InvalidURL"))
        .withColumn("recoverable", F.when(~F.col("valid"), False))
    )


def check_fetch_requests(df: DataFrame, source_id: str = "source_id", filename: str = "filename") -> DataFrame:
    """Add ``error_type``, ``message``, ``recoverable`` for unusable requests; the first failing rule wins.

    A source name may not leave its root either: it becomes a directory.
    """
    src, name = F.col(source_id), F.col(filename)

    def leaves_root(value):
        return F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\")) | value.isin(".", "..")

    problem = (
        F.when(is_blank(src), F.struct(F.lit("InvalidSourceId").alias("t"),
                                       F.lit("source_id cannot be empty.").alias("m")))
        .when(leaves_root(src), F.struct(F.lit("InvalidSourceId").alias("t"),
                                         F.lit("source_id must be a name, not a path.").alias("m")))
        .when(is_blank(name), F.struct(F.lit("InvalidFilename").alias("t"),
                                       F.lit("filename cannot be empty.").alias("m")))
        .when(leaves_root(name), F.struct(
            F.lit("InvalidFilename").alias("t"),
            F.lit("filename must contain only a filename, not a directory path.").alias("m")))
    )
    return (
        pinned(df, _problem=problem)
        .withColumn("error_type", F.col("_problem.t"))
        .withColumn("message", F.col("_problem.m"))
        .withColumn("recoverable", F.when(F.col("error_type").isNotNull(), False))
        .drop("_problem")
    )


def classify_fetch_outcomes(
    df: DataFrame, status_code: str = "status_code", exception_class: str = "exception_class"
) -> DataFrame:
    """Add ``success``, ``error_type``, ``recoverable`` from a status code and a transport error.

    A timeout is judged before the status, the status before other transport errors.
    """
    status, exc = F.col(status_code), F.col(exception_class)
    timeouts = ("Timeout", "ConnectTimeout", "ReadTimeout")
    return (
        df.withColumn(
            "error_type",
            F.when(exc.isin(*timeouts), "Timeout")
            .when((status >= 400) | (exc == "HTTPError"), "HTTPError")
            .when(exc.isNotNull(), "RequestException"),
        )
        .withColumn("success", F.col("error_type").isNull())
        .withColumn(
            "recoverable",
            F.when(F.col("error_type") == "HTTPError", F.coalesce(status >= 500, F.lit(False)))
            .when(F.col("error_type").isNotNull(), True),
        )
    )


def storage_paths(
    df: DataFrame,
    source_id: str = "source_id",
    filename: str = "filename",
    raw_root: str = RAW_ROOT,
    processed_root: str = PROCESSED_ROOT,
) -> DataFrame:
    """Add ``raw_path`` and ``processed_path``."""
    parts = (F.col(source_id), F.col(filename))
    return df.withColumn("raw_path", path_of(raw_root, *parts)).withColumn(
        "processed_path", path_of(processed_root, *parts)
    )
