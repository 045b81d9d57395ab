"""Workbooks (.xlsx) as long tables of cells.

A workbook is a zip of XML parts and can only be decoded whole, one file per
row; Spark spreads the files over tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = (
    "path string, sheet_names array<string>, sheet_index int, sheet_name string, row_idx int, "
    "header array<string>, cells array<string>, sheet_read_error string"
)
MAX_UNPACKED_BYTES = 1024**3

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = set(range(14, 23)) | set(range(45, 48))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _local(e.tag) == name]


def _text(element: ET.Element) -> str:
    """Joined text runs, phonetic hints left out."""
    out = []
    for child in element:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out.append(_text(child))
    return "".join(out)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference.upper()).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Indexes of cell styles that show a number as a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ET.fromstring(archive.read("xl/styles.xml"))
    custom = {}
    for fmt in _parts(root, "numFmt"):
        pattern = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", ""))
        custom[int(fmt.get("numFmtId"))] = bool(re.search(r"[dmyhs]", pattern, re.I))
    styles = [x for block in _parts(root, "cellXfs") for x in block]
    ids = [int(x.get("numFmtId", "0")) for x in styles]
    return {i for i, n in enumerate(ids) if custom.get(n, n in _DATE_FORMATS)}


def _value(cell: ET.Element, shared: list[str], dates: set[int], epoch: datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(e) for e in cell if _local(e.tag) == "is")
    raw = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "true" if raw == "1" else "false"
    if kind == "n" and int(cell.get("s", "0")) in dates:
        moment = epoch + timedelta(days=float(raw))
        return moment.replace(microsecond=0).isoformat(sep=" ")
    return raw


def decode_workbook(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """Yield (sheet_index, sheet_name, row_idx, cells); an empty sheet yields one row with no cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if sum(i.file_size for i in archive.infolist()) > MAX_UNPACKED_BYTES:
            raise ValueError("workbook unpacks to more than the allowed size")
        book = ET.fromstring(archive.read("xl/workbook.xml"))
        links = {
            r.get("Id"): r.get("Target").removeprefix("/xl/")
            for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = [_text(e) for e in _parts(ET.fromstring(archive.read("xl/sharedStrings.xml")), "si")]
        dates = _date_styles(archive)
        from_1904 = any(p.get("date1904") in ("1", "true") for p in _parts(book, "workbookPr"))
        epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
        for index, sheet in enumerate(_parts(book, "sheet")):
            name = sheet.get("name")
            rows = 0
            with archive.open(f"xl/{links[sheet.get(_REL)]}") as part:
                for _, element in ET.iterparse(part):
                    if _local(element.tag) != "row":
                        continue
                    cells: list[str | None] = []
                    for cell in element:
                        at = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                        cells.extend([None] * (at - len(cells)))
                        cells.append(_value(cell, shared, dates, epoch))
                    yield index, name, rows, cells
                    rows += 1
                    element.clear()
            if not rows:
                yield index, name, 0, []


def _rows_of(path: str, content: bytes) -> list[tuple]:
    """All rows of one workbook, or a single error row: a damaged file gives no partial data."""
    rows: list[tuple] = []
    names: list[str] = []
    header: list[str | None] = []
    try:
        for index, name, row, cells in decode_workbook(content):
            if row == 0:
                names.append(name)
                header = cells
            rows.append((path, None, index, name, row, header, cells, None))
    except Exception as exc:  # noqa: BLE001 - whatever is wrong with the file becomes its error
        return [(path, None, None, None, None, None, None, f"{type(exc).__name__}: {exc}")]
    # The first row of a workbook carries the list of its sheets.
    return [(path, names, *rows[0][2:]), *rows[1:]]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = _rows_of(path, content)
            for start in range(0, len(rows), 5_000):
                yield pd.DataFrame(rows[start : start + 5_000], columns=columns).astype(
                    {"sheet_index": "Int32", "row_idx": "Int32"}
                )


def decode_workbooks(files: DataFrame) -> DataFrame:
    """(path, content BINARY) to one row per sheet row.

    Row 0 of a sheet is its header, repeated on every row; the first row of a
    workbook also lists its sheets. A damaged file gives one row with
    ``sheet_read_error``.
    """
    return files.select("path", "content").mapInPandas(_decode, CELLS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Decode every .xls / .xlsx file below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{xlsx,xls,XLSX,XLS}")
        .load(path)
    )
    return decode_workbooks(files)


def scan_workbook(cells: DataFrame, sheet_name: str | None = None) -> DataFrame:
    """Data rows of one sheet per workbook, the first sheet unless named.

    Columns: path, sheet_name, row_idx (from 1), header, cells, error_type,
    message. A workbook that is damaged or lacks the sheet gives one row with
    ``error_type`` ``ExcelReadError``. A filter over decoded rows, no shuffle.
    """
    if sheet_name is None:
        chosen, lacks = F.col("sheet_index") == 0, F.lit(False)
    else:
        chosen = F.col("sheet_name") == sheet_name
        lacks = F.col("sheet_names").isNotNull() & ~F.array_contains("sheet_names", F.lit(sheet_name))
    damaged = F.col("sheet_read_error").isNotNull()
    message = F.when(damaged, F.col("sheet_read_error")).when(
        lacks, F.lit(f"Worksheet named '{sheet_name}' not found")
    )
    staged = cells.withColumn("message", message)
    failed = F.col("message").isNotNull()
    return staged.filter(failed | (chosen & (F.col("row_idx") > 0))).select(
        "path",
        F.when(failed, F.lit(sheet_name)).otherwise(F.col("sheet_name")).alias("sheet_name"),
        F.when(~failed, F.col("row_idx").cast("long")).alias("row_idx"),
        F.when(~failed, F.col("header")).alias("header"),
        F.when(~failed, F.col("cells")).alias("cells"),
        F.when(failed, "ExcelReadError").alias("error_type"),
        "message",
    )


def sheet_shapes(cells: DataFrame) -> DataFrame:
    """Rows (without header) and columns per sheet; counted map-side."""
    return (
        cells.filter("sheet_read_error IS NULL")
        .groupBy("path", "sheet_index", "sheet_name")
        .agg(
            F.count_if(F.col("row_idx") > 0).alias("rows"),
            F.max(F.when(F.col("row_idx") == 0, F.size("cells"))).cast("long").alias("columns"),
        )
    )
