"""File listings: size, extension, media type, sheet names."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.text import literal_map
from harvestlens.sources.workbooks import read_workbooks

# The standard library's own table; system files are not consulted, so all executors agree.
_KNOWN = mimetypes.MimeTypes()
_OFFICE = "application/vnd.openxmlformats-officedocument."
MEDIA_TYPES = {
    **_KNOWN.types_map[True],
    # Usually known from system files. Fixed values.
    ".docx": _OFFICE + "wordprocessingml.document",
    ".pptx": _OFFICE + "presentationml.presentation",
    ".xlsx": _OFFICE + "spreadsheetml.sheet",
}
COMPRESSED = r"(?i)(" + "|".join(sorted(re.escape(e) for e in _KNOWN.encodings_map)) + r")$"
EXTENSION = r"[^/.][^/]*?(\.[^./]+)$"


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size_bytes of every file below ``path``; contents are never read.

    Spark's file sources skip files of zero bytes, so those are not listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size_bytes"))


def describe_files(listing: DataFrame) -> DataFrame:
    """Add ``extension`` and ``guessed_mime_type`` (``unknown`` when the extension is)."""
    # A compressed file has the type of what is inside: a.csv.gz is a CSV file.
    inner = extension_of(F.regexp_replace("path", COMPRESSED, ""))
    return listing.withColumn("extension", extension_of(F.col("path"))).withColumn(
        "guessed_mime_type", F.coalesce(F.element_at(literal_map(MEDIA_TYPES), inner), F.lit("unknown"))
    )


def sheet_lists(cells: DataFrame) -> DataFrame:
    """One row per workbook: path, sheet_names or sheet_read_error."""
    return cells.filter("sheet_names IS NOT NULL OR sheet_read_error IS NOT NULL").select(
        "path", "sheet_names", "sheet_read_error"
    )


def inventory_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Describe every file below ``path``; workbooks also list their sheets or the reason they cannot."""
    described = describe_files(list_files(spark, path, glob))
    return described.join(sheet_lists(read_workbooks(spark, path)), "path", "left")


def missing_files(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Requested paths that are no file: ``FileNotFoundError``, or ``NotAFileError`` for a directory.

    A path is a directory when listed files lie below it.
    """
    plain = listing.select(_plain_path(F.col("path")).alias("path"))
    asked = requested.select(_plain_path(F.col("path")).alias("path")).distinct()
    absent = asked.join(plain, "path", "left_anti")
    # All ancestors of listed files, so that the match is an equality on paths.
    levels = F.split("path", "/")
    parents = plain.select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(levels) - 1), lambda i: F.array_join(F.slice(levels, 1, i), "/"))
        ).alias("path")
    ).distinct()
    return absent.join(parents.withColumn("_dir", F.lit(True)), "path", "left").select(
        "path",
        F.when(F.col("_dir"), "NotAFileError").otherwise("FileNotFoundError").alias("error_type"),
        F.concat(
            F.when(F.col("_dir"), "Path is not a file: ").otherwise("File not found: "), F.col("path")
        ).alias("message"),
        F.lit(False).alias("recoverable"),
    )


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"/+$", "")
