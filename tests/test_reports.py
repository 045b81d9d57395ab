"""Seven checks in one scan against the checks one by one."""

import json

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import checks, reports

SF = "/root/testdata/sf0.01"


def verdicts(df):
    return {r["check"]: (r["passed"], json.loads(r["detail_json"])) for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def seven():
    target = {"a": "INT", "d": "date", "gone": "string"}
    return [
        reports.required_fields(["a", "gone"]),
        reports.schema(target),
        reports.types(target),
        reports.row_count(2, 5),
        reports.duplicates(["a"]),
        reports.date_range("d", "2024-01-01", "2024-12-31"),
        reports.nulls(["b", "a", "nowhere"]),
    ]


def test_seven_checks(spark):
    rows = [(1, "x", "2023-05-01"), (1, "", "2024-05-01"), (None, "y", None), (None, "z", "2025-01-01"), (3, "w", "2024-12-31 00:00:00")]
    got = verdicts(reports.report(spark.createDataFrame(rows, "a int, b string, d string"), "t", *seven()))
    assert got == {
        "required_fields": (False, {"missing_fields": ["gone"]}),
        "schema": (False, {"missing_fields": ["gone"], "extra_fields": ["b"]}),
        "types": (False, {"mismatches": [{"field": "d", "expected": "date", "observed": "string"}]}),
        "row_count": (True, {"row_count": 5, "minimum": 2, "maximum": 5}),
        "duplicates": (False, {"duplicate_keys": 2, "surplus_rows": 2, "first": {"a": None}, "last": {"a": 1}}),
        "date_range": (False, {"below": 1, "above": 2, "lowest": "2023-05-01", "highest": "2025-01-01"}),
        "nulls": (False, {"fields_with_nulls": ["a", "b", "nowhere"]}),
    }


def test_an_empty_data_set_fails_its_row_count_only(spark):
    empty = spark.createDataFrame([], "a int, b string, d string")
    got = verdicts(reports.report(empty, "t", *seven()[3:]))
    assert {name: passed for name, (passed, _) in got.items()} == {
        "row_count": False, "duplicates": True, "date_range": True, "nulls": True
    }


def test_schema_checks_alone_read_no_rows(spark):
    df = reports.report(spark.read.parquet(f"{SF}/orders.parquet"), "o", reports.required_fields(["o_orderkey"]))
    assert verdicts(df)["required_fields"] == (True, {"missing_fields": []}) and "FileScan" not in plan(df)


def test_one_scan_and_the_same_numbers_as_single_checks(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    df = reports.report(
        items, "l", reports.row_count(), reports.duplicates(["l_orderkey", "l_linenumber"]),
        reports.date_range("l_shipdate", "1996-01-01", "1998-12-31", mode="date"), reports.nulls(["l_returnflag"]),
    )
    assert plan(df).count("FileScan") == 1
    got = verdicts(df)
    assert got["row_count"][1]["row_count"] == items.count()
    assert got["duplicates"][1]["duplicate_keys"] == checks.check_duplicates(items, ["l_orderkey", "l_linenumber"]).count()
    outside = checks.check_date_range(items, "l_shipdate", "1996-01-01", "1998-12-31", mode="date")
    sides = {r["side"]: r["count"] for r in outside.groupBy("side").count().collect()}
    assert got["date_range"][1]["below"] == sides.get("below", 0) and got["date_range"][1]["above"] == sides.get("above", 0)


def test_two_keys_in_one_report_are_refused(spark):
    with pytest.raises(ValueError):
        reports.report(spark.range(3), "t", reports.duplicates(["id"]), reports.duplicates(["id"]))


def test_duplicate_texts_are_found_by_digest_and_counted_by_value(spark):
    rows = [("a", b"1", 0.0), ("a", b"1", -0.0), (None, None, 1.0), (None, None, 1.0), ("", b"", 2.0), (None, b"", 2.0), ("b", b"2", 3.0)]
    df = spark.createDataFrame(rows, "t string, `b.c` binary, x double")
    got = {(r[0], r[1] and bytes(r[1]), r[2], r[3]) for r in checks.check_duplicates(df, ["t", "b.c", "x"]).collect()}
    assert got == {("a", b"1", 0.0, 2), (None, None, 1.0, 2)}
    assert checks.check_duplicates(df.filter("false"), ["t"]).count() == 0


def test_no_text_in_the_first_shuffle(spark):
    text = plan(checks.check_duplicates(spark.read.parquet(f"{SF}/documents.parquet"), ["text"]))
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    # By digest first; the text is a key only of what the semi join has left.
    assert any("hashpartitioning(_a0" in line for line in shuffles)
    assert text.index("hashpartitioning(text") < text.index("LeftSemi") < text.index("hashpartitioning(_a0")
    longest = spark.range(50).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    assert checks.check_duplicates(longest, ["text"]).first().n == 50
