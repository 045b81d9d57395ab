import os

import pytest
from pyspark.sql import functions as F

from harvestlens.operators.runs import audit_records, kept_turns
from harvestlens.plans.workbook_files import workbook_bytes
from harvestlens.sinks import audit, zones
from harvestlens.sources import configs, csv_files, inventory, paged, workbooks
from harvestlens.streaming import sinks


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def scanned(spark, tmp_path, text, **kw):
    return csv_files.scan_csv(spark, write(tmp_path / "a.csv", text), **kw)


def test_csv_summary(spark, tmp_path):
    rows = scanned(spark, tmp_path, "mcc,category\n5411,Grocery\n5812,Restaurant\n").rows
    assert rows.dtypes == [("mcc", "bigint"), ("category", "string")]
    assert [tuple(r) for r in rows.collect()] == [(5411, "Grocery"), (5812, "Restaurant")]


def test_csv_ragged(spark, tmp_path):
    got = scanned(spark, tmp_path, "a,b\n1,2\n1,2,3,4\n4\n")
    assert [tuple(r) for r in got.rows.collect()] == [(1, 2), (4, None)]
    bad = got.rejects.first()
    assert (bad.error_type, bad.recoverable, bad.cells) == ("CsvReadError", False, ["1", "2", "3", "4"])
    assert bad.message == "Expected 2 fields, saw 4" and got.failed_files().count() == 1


def test_csv_long_rows_keep_all_cells(spark, tmp_path):
    got = scanned(spark, tmp_path, 'a,b\n1,"x, ""y""",,"z"\n1,2,,\n5,6\n,,,\n7\n')
    assert [tuple(r) for r in got.rows.collect()] == [(5, 6), (7, None)]
    assert [r.cells for r in got.rejects.collect()] == [["1", 'x, "y"', None, "z"], ["1", "2", None, None], [None] * 4]
    assert got.rows.count() == 2 and got.rejects.count() == 3


def test_csv_files_with_different_headers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.csv", "id,name\n1,one\n2,two\n")
    write(folder / "2 [x].csv", "\nname,id\nthree,3\n")
    write(folder / "3.csv", 'name,"no\nte",id\nfour,"a\nb",4\nsurplus,1,2,3,4\n')
    write(folder / "4.csv", "id,name\n")
    write(folder / "5.csv", "\n")
    got = csv_files.scan_csv(spark, str(folder))
    assert got.rows.columns == ["id", "name", "no\nte"]
    assert sorted(tuple(r) for r in got.rows.collect()) == [
        (1, "one", None), (2, "two", None), (3, "three", None), (4, "four", "a\nb")]
    assert [r.cells for r in got.rejects.collect()] == [["surplus", "1", "2", "3", "4"]]
    assert dict(got.rows.dtypes)["id"] == "bigint"
    with pytest.raises(ValueError):
        csv_files.scan_csv(spark, write(tmp_path / "none.csv", "\n\n"))


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    text = 'a,b\n"x, ""y""","one\ntwo"\nz,"three"\n'
    path = write(tmp_path / "q.csv", text)
    assert csv_files.spans_lines(spark, path)
    assert [tuple(r) for r in csv_files.scan_csv(spark, path).rows.collect()] == [('x, "y"', "one\ntwo"), ("z", "three")]
    assert not csv_files.spans_lines(spark, write(tmp_path / "p.csv", 'a\n"x ""y"" z"\n'))


def test_csv_types_and_missing_values(spark, tmp_path):
    text = "i,d,b,s,n,big\n1,1.5,True,x,NA,1\nNA,2e3,False,1x,,99999999999999999999\n-3,,,,,2\n"
    rows = scanned(spark, tmp_path, text).rows
    assert rows.dtypes == [("i", "bigint"), ("d", "double"), ("b", "boolean"), ("s", "string"), ("n", "double"),
                           ("big", "double")]
    assert tuple(rows.collect()[1])[:5] == (None, 2000.0, False, "1x", None)


def test_csv_header_names():
    assert csv_files.header_names(["a", "b", "b", None, "b", "b.1"]) == ["a", "b", "b.1", "Unnamed: 3", "b.2", "b.1.1"]


def test_csv_row_count_is_whole(spark, tmp_path):
    rows = scanned(spark, tmp_path, "x\n" + "\n".join(map(str, range(1000))) + "\n").rows
    assert rows.count() == 1000 and rows.orderBy("x").limit(5).count() == 5


def test_workbooks(spark, tmp_path):
    book = workbook_bytes({"Sheet1": [["col1", "é"], [1, "a & b"], [2, None], [3, " x"]], "Two": [], "T": [["h"], [7]]})
    write(tmp_path / "a.xlsx", book)
    write(tmp_path / "bad.xlsx", b"not a zip")
    cells = workbooks.read_workbooks(spark, str(tmp_path)).cache()
    first = workbooks.scan_workbook(cells).filter("error_type IS NULL").orderBy("row_idx").collect()
    assert [(r.sheet_name, r.row_idx, r.header, r.cells) for r in first] == [
        ("Sheet1", 1, ["col1", "é"], ["1", "a & b"]), ("Sheet1", 2, ["col1", "é"], ["2", None]),
        ("Sheet1", 3, ["col1", "é"], ["3", " x"]),
    ]
    failed = workbooks.scan_workbook(cells).filter("error_type IS NOT NULL").collect()
    assert [(os.path.basename(r.path), r.error_type) for r in failed] == [("bad.xlsx", "ExcelReadError")]
    named = {(os.path.basename(r.path), r.error_type, tuple(r.cells or ())) for r in
             workbooks.scan_workbook(cells, "T").collect()}
    assert named == {("a.xlsx", None, ("7",)), ("bad.xlsx", "ExcelReadError", ())}
    absent = workbooks.scan_workbook(cells, "Nope").filter("path LIKE '%a.xlsx'").first()
    assert absent.error_type == "ExcelReadError"
    shapes = {(r.sheet_name, r.rows, r.columns) for r in workbooks.sheet_shapes(cells).collect()}
    assert shapes == {("Sheet1", 3, 2), ("Two", 0, 0), ("T", 1, 1)}


def test_workbook_shared_strings_dates_and_gaps():
    import io
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out, plain = io.BytesIO(), zipfile.ZipFile(io.BytesIO(workbook_bytes({"S": []})))
    with zipfile.ZipFile(out, "w") as z:
        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            z.writestr(name, plain.read(name))
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r>'
                                           "<rPh><t>hint</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml",
                   f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c>'
                   '<c r="D1" s="1"><v>45000.5</v></c><c r="E1" t="b"><v>1</v></c></row></sheetData></worksheet>')
    rows = list(workbooks.decode_workbook(out.getvalue()))
    assert rows == [(0, "S", 0, ["plain", None, "rich", "2023-03-15 12:00:00", "true"])]


def test_inventory(spark, tmp_path):
    write(tmp_path / "sample.CSV", "a,b\n1,2\n")
    write(tmp_path / "x.csv.gz", b"1")
    write(tmp_path / "noext", b"1")
    write(tmp_path / "a.xlsx", workbook_bytes({"One": [], "Two": []}))
    write(tmp_path / "old.xls", b"??")
    got = {os.path.basename(r.path): r for r in inventory.inventory_files(spark, str(tmp_path)).collect()}
    assert (got["sample.CSV"].extension, got["sample.CSV"].size_bytes, got["sample.CSV"].guessed_mime_type) == (
        ".csv", 8, "text/csv")
    assert (got["x.csv.gz"].extension, got["x.csv.gz"].guessed_mime_type) == (".gz", "text/csv")
    assert (got["noext"].extension, got["noext"].guessed_mime_type) == ("", "unknown")
    assert got["a.xlsx"].sheet_names == ["One", "Two"] and got["a.xlsx"].sheet_read_error is None
    assert got["old.xls"].sheet_names is None and got["old.xls"].sheet_read_error


def test_missing_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    there = write(tmp_path / "d" / "f.txt", "x")
    asked = spark.createDataFrame([(there,), (f"{tmp_path}/d/",), (f"{tmp_path}/nope",)], "path string")
    listing = inventory.list_files(spark, str(tmp_path))
    got = {r.path: (r.error_type, r.recoverable) for r in inventory.missing_files(asked, listing).collect()}
    assert got == {f"{tmp_path}/d": ("NotAFileError", False), f"{tmp_path}/nope": ("FileNotFoundError", False)}


def test_configs(spark, tmp_path):
    write(tmp_path / "ok.yaml", "source_id: x\ntarget_schema: {}\nwhen: 2024-01-02\n")
    write(tmp_path / "bad.yaml", "key: [unclosed")
    write(tmp_path / "list.yml", "- item1\n- item2\n")
    write(tmp_path / "empty.json", "\n")
    got = {os.path.basename(r.config_path): r for r in configs.scan_source_configs(spark, str(tmp_path)).collect()}
    assert got["ok.yaml"].cfg_json == '{"source_id": "x", "target_schema": {}, "when": "2024-01-02"}'
    assert got["ok.yaml"].parse_error is None
    assert got["bad.yaml"].parse_error.startswith("Invalid YAML")
    assert got["list.yml"].parse_error and got["empty.json"].parse_error


def test_pages_and_grids(spark):
    talk = spark.createDataFrame([("d", i, "x" * 600 if i == 1 else None) for i in range(1, 6)],
                                 "doc string, page int, text string")
    got = paged.preview_pages(talk, "doc", "page", "text", 2).orderBy("page").collect()
    assert [(r.page, len(r.text_sample), r.total_pages, r.pages_previewed) for r in got] == [(1, 500, 5, 2), (2, 0, 5, 2)]
    asked = spark.createDataFrame([("d", 0), ("d", 5), ("d", 6), ("none", 1)], "doc string, n int")
    errors = {(r.doc, r.n): r.error_type for r in paged.check_page_numbers(asked, talk, "doc", "n").collect()}
    assert errors == {("d", 0): "InvalidPageNumber", ("d", 5): None, ("d", 6): "InvalidPageNumber",
                      ("none", 1): "InvalidPageNumber"}
    grid = spark.createDataFrame([(1, 2, i, ["a", str(i)] if i else ["h"]) for i in range(9)],
                                 "page int, tab int, i int, cells array<string>")
    row = paged.summarize_grids(grid, ["page", "tab"], ["i"], F.col("cells")).first()
    assert (row.row_count, row.col_count, len(row.sample_rows), row.sample_rows[1]) == (9, 1, 5, ["a", "1"])
    assert paged.count_tables(paged.summarize_grids(grid, ["page", "tab"], ["i"], F.col("cells")), ["page"]).first()[1] == 1


FETCH = "url string, source_id string, filename string, content binary, content_type string"


def test_landing(spark, tmp_path):
    rows = [("u", "source", "f.bin", b"x" * 100, None), ("u", "007", "t.txt", b"hello", "text/plain"),
            ("u", "../up", "f", b"no", None)]
    fetches = spark.createDataFrame(rows, FETCH)
    zones.land_raw(fetches, f"{tmp_path}/raw")
    landed = zones.read_zone(spark, f"{tmp_path}/raw", FETCH)
    assert {(r.source_id, r.filename, bytes(r.content)) for r in landed.collect()} == {
        ("source", "f.bin", b"x" * 100), ("007", "t.txt", b"hello")}
    manifest = {r.source_id: (r.file_path, r.bytes, r.content_type) for r in zones.landing_manifest(fetches).collect()}
    assert manifest == {"source": ("storage/raw/source/f.bin", 100, "unknown"),
                        "007": ("storage/raw/007/t.txt", 5, "text/plain")}
    with pytest.raises(ValueError):
        zones.write_processed(fetches, f"{tmp_path}/raw/../raw/x", f"{tmp_path}/raw")
    with pytest.raises(ValueError):
        zones.write_processed(fetches, str(tmp_path), f"{tmp_path}/raw")
    zones.write_processed(fetches.limit(1), f"{tmp_path}/processed", f"{tmp_path}/raw")
    assert zones.read_zone(spark, f"{tmp_path}/processed", FETCH).count() == 1


def test_landing_twice_is_landing_once(spark, tmp_path):
    root = f"{tmp_path}/raw"
    first = spark.createDataFrame(
        [("u1", "s", "a", b"1", None), ("u2", "s", "b", b"2", None), ("u3", "007", "a", b"3", "x/y")], FETCH
    )
    for _ in range(2):
        manifest = zones.land_raw(first, root)
        assert {(r.source_id, r.filename, bytes(r.content)) for r in zones.read_zone(spark, root, FETCH).collect()} == {
            ("s", "a", b"1"), ("s", "b", b"2"), ("007", "a", b"3")}
        assert {tuple(r) for r in manifest.collect()} == {tuple(r) for r in zones.landing_manifest(first).collect()}
    # The last write of a file wins, others stay; the manifest tells what lies there.
    again = spark.createDataFrame(
        [("u4", "s", "a", b"new", "x/z", 2), ("u5", "s", "a", b"older", None, 1), ("u6", "s", "c", b"", None, 1)], FETCH + ", at int"
    )
    manifest = zones.land_raw(again.drop("at"), f"{tmp_path}/other")
    assert sorted(r.filename for r in manifest.collect()) == ["a", "c"]
    latest = zones.land_raw(again.orderBy("at"), f"{tmp_path}/ordered", order_by="at")
    assert {(r.url, r.filename, r.bytes) for r in latest.collect()} == {("u4", "a", 3), ("u6", "c", 0)}
    zones.land_raw(again.filter("at = 2").drop("at"), root)
    lying = {(r.source_id, r.filename, bytes(r.content)) for r in zones.read_zone(spark, root, FETCH).collect()}
    assert lying == {("s", "a", b"new"), ("s", "b", b"2"), ("007", "a", b"3")}
    # Nothing to land changes nothing.
    assert zones.land_raw(first.filter("false"), root).count() == 0
    assert zones.read_zone(spark, root, FETCH).count() == 3


def test_audit_lines(spark, tmp_path):
    turns = spark.createDataFrame([(1, 1, "call", False, 5, '{"a":[1]}', "boom")],
                                  "run_id int, turn_seq int, kind string, success boolean, max_steps int, arguments string, message string")
    records = audit_records(kept_turns(turns))
    audit.append_audit(records, f"{tmp_path}/log")
    audit.append_audit(records, f"{tmp_path}/log")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(lines) == 2
    assert lines[0] == ('{"timestamp":null,"source_id":"unknown_source","step":0,"tool_name":"","arguments":{"a":[1]},'
                        '"success":false,"error":"boom","duration_seconds":0.0}')
    assert audit.read_audit(spark, f"{tmp_path}/log").first().arguments == '{"a":[1]}'


def test_audit_stream_restarts_without_repeats(spark, tmp_path):
    turns = spark.range(1, 7).select(F.lit(1).alias("run_id"), F.col("id").alias("turn_seq"), F.lit("call").alias("kind"),
                                     F.lit(True).alias("success"), F.lit(50).alias("max_steps"))
    records = audit_records(kept_turns(turns))

    def run():
        arriving = sinks.read_table_stream(spark, f"{tmp_path}/in", records.schema)
        sinks.stream_audit(arriving, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return audit.read_audit(spark, f"{tmp_path}/out").count()

    records.filter("step < 4").write.parquet(f"{tmp_path}/in")
    assert run() == 4 and run() == 4
    records.filter("step >= 4").write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 6
