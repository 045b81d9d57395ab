"""Workbook bytes derived from table rows, as input for the workbook scan."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f"<c><v>{value}</v></c>"


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal .xlsx file with the given sheets."""
    names = list(sheets)
    listed = "".join(
        f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)
    )
    links = "".join(
        f'<Relationship Id="rId{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(names) + 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml",
                   f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{links}</Relationships>')
        for i, name in enumerate(names, 1):
            rows = "".join(f"<row>{''.join(map(_cell, row))}</row>" for row in sheets[name])
            z.writestr(f"xl/worksheets/sheet{i}.xml",
                       f'<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def order_workbooks(orders: DataFrame, rows_per_file: int = 500) -> DataFrame:
    """(path, content): one workbook per range of order keys, so that no file grows with the data."""

    def encode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o_orderkey")
        body = [[int(k), s] for k, s in zip(rows["o_orderkey"], rows["o_orderstatus"])]
        sheets = {"Orders": [["key", "status"], *body], "About": [["rows"], [len(body)]]}
        return pd.DataFrame({"path": [f"w{key[0]}.xlsx"], "content": [workbook_bytes(sheets)]})

    block = F.floor(F.col("o_orderkey") / rows_per_file).cast("long").alias("block")
    # A fixed number of partitions: small shuffles would be merged, but here the work per row is large.
    spark = orders.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (
        orders.select("o_orderkey", "o_orderstatus", block)
        .repartition(parts, "block")
        .groupBy("block")
        .applyInPandas(encode, "path string, content binary")
    )
