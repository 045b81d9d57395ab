"""CSV files with a header line, each with its own.

One pass over the lines gives each file's header and whether it must be read whole.
Files are read by groups of one header and put together by column name. Short rows
are padded with NULLs and long rows are rejected with all their cells. Every column
is first read as text; types are then decided from the whole data in one
aggregation pass.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Texts that stand for a missing value. Fixed values.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
BOOLEAN = r"^(True|False|TRUE|FALSE|true|false)$"
# Holds the text of a row with more or fewer cells than its header.
RECORD = "_record"
# One cell and the comma before it: quoted, with doubled quotes inside, or plain.
CELL = r'(?s),("(?:[^"]|"")*"[^,]*|[^,]*)'


@dataclass(frozen=True)
class CsvScan:
    """Result of a scan: typed rows, and rejected long rows with their file and ``CsvReadError``."""

    rows: DataFrame
    rejects: DataFrame

    def failed_files(self) -> DataFrame:
        """Files a strict reader would refuse as a whole."""
        return self.rejects.groupBy("file_path").agg(
            F.first("error_type").alias("error_type"), F.count(F.lit(1)).alias("n_rejected")
        )


def header_names(raw: list[str | None]) -> list[str]:
    """Column names of a header line: repeats become ``b.1``, blanks ``Unnamed: 0``."""
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    names = []
    for position, label in enumerate(raw):
        base = label if label else f"Unnamed: {position}"
        name = base
        while name in taken:
            repeats[base] = repeats.get(base, 0) + 1
            name = f"{base}.{repeats[base]}"
        taken.add(name)
        names.append(name)
    return names


def _odd_quotes(line: Column) -> Column:
    """A line with an odd number of quotes begins or ends a quoted field of several lines."""
    return F.contains(line, F.lit('"')) & (F.length(F.regexp_replace(line, '[^"]', "")) % 2 == 1)


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """Per file its first line that is not blank and whether quoted fields hold line breaks. One pass.

    Lines of a file are numbered within its first split, where the header is.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("value"),
        F.monotonically_increasing_id().alias("_at"),
    )
    heading = (F.col("_start") == 0) & (F.trim("value") != "")
    return lines.groupBy("file_path").agg(
        F.min_by("value", F.when(heading, F.col("_at"))).alias("header"),
        F.coalesce(F.bool_or(_odd_quotes(F.col("value"))), F.lit(False)).alias("spans_lines"),
    )


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether any quoted field holds a line break. Such files must be read whole; all others can be split."""
    return not spark.read.text(path).filter(_odd_quotes(F.col("value"))).isEmpty()


def _as_path(file_path: str) -> str:
    """A file's URI as a path for a reader, to be taken as it is and not as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file_path))


@dataclass(frozen=True)
class FileGroup:
    """Files of one header that are read in the same way, as text columns ``c0``, ... and ``_record``."""

    names: tuple[str, ...]
    rows: DataFrame

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.names))]

    def cells(self) -> Column:
        """All cells of a row that does not fit its header, surplus ones included."""
        # Spark refuses to read the record alone, so that the first column is named as well.
        record = F.concat_ws("", F.lit(","), F.col(RECORD), F.substring("c0", 1, 0))
        found = F.regexp_extract_all(record, F.lit(CELL), F.lit(1))
        plain = F.transform(
            found,
            lambda cell: F.when(
                cell.startswith('"'), F.replace(F.regexp_replace(cell, '^"|"$', ""), F.lit('""'), F.lit('"'))
            ).otherwise(F.when(cell != "", cell)),
        )
        return plain

    def long_row(self) -> Column:
        return F.coalesce(F.col(RECORD).isNotNull() & (F.size(self.cells()) > len(self.names)), F.lit(False))


def file_groups(spark: SparkSession, path: str, multi_line: bool | None = None) -> list[FileGroup]:
    """The files of ``path`` by header and way of reading, in order of their first file.

    The driver holds a header line and a flag per file, as it holds the list of files itself.
    """
    files = sorted(file_headers(spark, path).filter("header IS NOT NULL").collect(), key=lambda r: r["file_path"])
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file in files:
        whole = file["spans_lines"] if multi_line is None else multi_line
        options = _options(whole)
        if whole and file["header"].count('"') % 2:
            first = spark.read.options(**options).option("header", "false").csv(_as_path(file["file_path"])).first()
            raw = list(first) if first else [file["header"]]
        else:
            raw = next(csv.reader([file["header"].lstrip("\ufeff")]))
        groups.setdefault((tuple(header_names(raw)), whole), []).append(_as_path(file["file_path"]))
    out = []
    for (names, whole), paths in groups.items():
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))]).add(RECORD, StringType())
        # Only a row whose cells are all parsed shows whether it fits its header.
        reader = spark.read.options(**_options(whole)).option("header", "true").option("columnPruning", "false")
        rows = reader.option("columnNameOfCorruptRecord", RECORD).schema(schema).csv(paths)
        out.append(FileGroup(names, rows.withColumn("file_path", F.col("_metadata.file_path"))))
    return out


def _options(multi_line: bool) -> dict[str, str]:
    return {"escape": '"', "multiLine": str(multi_line).lower(), "encoding": "UTF-8"}


def _known(column: Column) -> Column:
    return F.when(~column.isin(*MISSING), column)


def infer_types(text_rows: DataFrame, columns: list[str]) -> dict[str, str]:
    """Type per text column from all its values: bigint, double, boolean or string. One pass, one row."""
    checks = []
    for i, name in enumerate(columns):
        value = _known(F.col(name))
        whole = value.rlike(INTEGER) & F.trim(value).try_cast("bigint").isNotNull()
        checks += [
            F.bool_and(F.when(value.isNotNull(), whole)).alias(f"i{i}"),
            F.bool_and(value.rlike(DECIMAL)).alias(f"d{i}"),
            F.bool_and(value.rlike(BOOLEAN)).alias(f"b{i}"),
            F.count(value).alias(f"n{i}"),
        ]
    seen = text_rows.agg(*checks).first()
    types = {}
    for i, name in enumerate(columns):
        if seen[f"n{i}"] == 0:
            types[name] = "double"
        elif seen[f"i{i}"]:
            types[name] = "bigint"
        elif seen[f"d{i}"]:
            types[name] = "double"
        elif seen[f"b{i}"]:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def scan_csv(
    spark: SparkSession, path: str, multi_line: bool | None = None, types: dict[str, str] | None = None
) -> CsvScan:
    """Read a CSV file, or a folder of CSV files, as typed rows.

    Files may have different headers: a column is known by its name, wherever it stands,
    and NULL in files without it. ``multi_line`` and ``types`` (by column name) are found
    out from the data unless given; ``types`` saves a pass over the files. Files without
    any line hold nothing; if all are such, there is no header and that is an error.
    """
    groups = file_groups(spark, path, multi_line)
    if not groups:
        raise ValueError(f"no header line in {path}")
    names = list(dict.fromkeys(name for group in groups for name in group.names))
    aligned = []
    for group in groups:
        place = dict(zip(group.names, group.columns))
        cells = [F.col(place[n]) if n in place else F.lit(None).cast("string") for n in names]
        aligned.append(group.rows.filter(~group.long_row()).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)]))
    columns = [f"c{i}" for i in range(len(names))]
    good = reduce(DataFrame.union, aligned)
    if types is None:
        kinds = infer_types(good, columns)
    else:
        kinds = {column: types.get(name, "string") for column, name in zip(columns, names)}
    typed = []
    for column, name in zip(columns, names):
        value = _known(F.col(column))
        if kinds[column] != "string":
            value = F.trim(value).try_cast(kinds[column])
        typed.append(value.alias(name))
    rejects = [
        group.rows.filter(group.long_row()).select(
            "file_path",
            F.lit("CsvReadError").alias("error_type"),
            F.concat(F.lit(f"Expected {len(group.names)} fields, saw "), F.size(group.cells())).alias("message"),
            F.lit(False).alias("recoverable"),
            group.cells().alias("cells"),
        )
        for group in groups
    ]
    return CsvScan(good.select(*typed), reduce(DataFrame.union, rejects))
