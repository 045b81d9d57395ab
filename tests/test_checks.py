import math

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import checks, profile


def catalog(spark, *columns):
    rows = [("d", i, c, t) for i, (c, t) in enumerate(columns)]
    return spark.createDataFrame(rows, "dataset string, ordinal long, column string, dtype string")


def test_required_fields(spark):
    abc = catalog(spark, ("a", "int"), ("b", "int"), ("c", "int"))
    assert checks.missing_fields(abc, ["a", "b"]).count() == 0
    assert [tuple(r) for r in checks.missing_fields(abc, ["x", "a", "y", "x"]).orderBy("ordinal").collect()] == [
        ("d", 0, "x"), ("d", 2, "y"), ("d", 3, "x")
    ]


def test_schema(spark):
    got = checks.schema_differences(catalog(spark, ("a", "string"), ("extra", "int")), {"a": "string", "b": "int"})
    assert {tuple(r) for r in got.collect()} == {("d", "missing", "b"), ("d", "extra", "extra")}
    assert checks.schema_differences(catalog(spark, ("a", "int")), {}).count() == 0


def test_types(spark):
    got = checks.type_mismatches(
        catalog(spark, ("id", "bigint"), ("name", "string"), ("other", "date")),
        {"id": "BIGINT", "name": "int", "absent": "int"},
    )
    assert [tuple(r) for r in got.collect()] == [("d", "name", "int", "string")]


def test_record_checks_agree_with_catalog_checks(spark):
    records = spark.createDataFrame([(1, '{"id": 5, "name": "n", "x": null}'), (2, "[1]"), (3, "oops")],
                                    "k int, j string")
    missing = checks.record_missing_fields(records, "k", "j", ["id", "q"])
    assert {tuple(r) for r in missing.collect()} == {
        (1, 1, "q"), (2, 0, "id"), (2, 1, "q"), (3, 0, "id"), (3, 1, "q")
    }
    differences = checks.record_schema_differences(records, "k", "j", {"id": "x", "q": "y"}).filter("k = 1")
    assert {tuple(r)[1:] for r in differences.collect()} == {("missing", "q"), ("extra", "name"), ("extra", "x")}
    assert checks.record_schema_differences(records, "k", "j", {}).count() == 0
    types = checks.record_type_mismatches(records, "k", "j", {"id": "string", "name": "STRING", "x": "VOID"})
    assert [tuple(r) for r in types.collect()] == [(1, "id", "string", "BIGINT")]


@pytest.mark.parametrize("n, low, high, passed", [(50, 1, 100, True), (0, 1, None, False), (5, 1, 4, False),
                                                  (5, 5, None, True)])
def test_row_count(spark, n, low, high, passed):
    row = checks.check_row_count(spark.range(n), low, high).first()
    assert (row.row_count, row.passed) == (n, passed)


def test_duplicates(spark):
    rows = spark.createDataFrame([(1,), (2,), (1,), (None,), (None,)], "id int")
    assert {tuple(r) for r in checks.check_duplicates(rows, ["id"]).collect()} == {(1, 2), (None, 2)}
    again = checks.check_duplicates(rows.repartition(7), ["id"])
    assert {tuple(r) for r in again.collect()} == {(1, 2), (None, 2)}


def test_known_duplicate_counts(spark):
    at = "/root/testdata/sf0.01/"
    assert checks.check_duplicates(spark.read.parquet(at + "documents.parquet"), ["text"]).count() == 62
    items = spark.read.parquet(at + "lineitem.parquet")
    assert checks.check_duplicates(items, ["l_orderkey", "l_linenumber"]).count() == 11_785


def test_dates(spark):
    rows = spark.createDataFrame([("1995-12-31",), ("1998-12-31",), ("1998-12-31 00:00:00",), (None,)], "d string")
    got = checks.check_date_range(rows, "d", "1996-01-01", "1998-12-31")
    assert {(r.value, r.side) for r in got.collect()} == {("1995-12-31", "below"), ("1998-12-31 00:00:00", "above")}
    assert checks.check_date_range(rows, "d", "", None).count() == 0
    by_day = checks.check_date_range(rows, "d", "1996-01-01", "1998-12-31", mode="date")
    assert [r.value for r in by_day.collect()] == ["1995-12-31"]
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    assert checks.check_date_range(orders, "o_orderdate", "1996-01-01", "1998-12-31").count() == 8_271


def test_nulls(spark):
    rows = spark.createDataFrame([("a", math.nan), ("", 1.0), (None, 2.0)], "name string, x double")
    got = {r.field: r.has_null for r in checks.check_nulls(rows, ["x", "name", "absent"]).collect()}
    assert got == {"name": True, "x": False, "absent": True}
    empty = checks.check_nulls(rows.filter("false"), ["name", "absent"])
    assert not any(r.has_null for r in empty.collect())


def test_sample_mode(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 50)
    assert checks.check_duplicates(checks.sample_of(rows, ["id"], 50), ["k"]).count() == 0


def test_profile(spark):
    rows = spark.createDataFrame([(5411, "Grocery"), (5812, None)], "mcc int, category string")
    assert tuple(profile.profile_shape(rows, "d").first()) == ("d", 2, 2)
    assert [tuple(r) for r in profile.profile_columns(rows, "d").collect()] == [
        ("d", 0, "mcc", "int", 0), ("d", 1, "category", "string", 1)
    ]
    assert profile.profile_sample(rows, ["mcc"], 1).first().mcc == 5411
    whole = profile.summarize(rows, "d", ["mcc"], 1).first()
    assert (whole.shape.rows, whole.shape.columns, whole.columns) == (2, 2, ["mcc", "category"])
    assert whole.dtypes == {"mcc": "int", "category": "string"} and len(whole.sample_rows) == 1


@pytest.mark.parametrize(
    "text, error, missing",
    [
        ('{"source_id":1,"source_type":"a","title":"t","data_link":"l","raw_dir":null}', None, []),
        ('{"source_id":1,"source_type":"a"}', "MissingFields", ["title", "data_link", "raw_dir"]),
        ('["item"]', "NotAMapping", None),
        ("key: [unclosed", "InvalidConfig", None),
        (None, "InvalidConfig", None),
    ],
)
def test_source_configs(spark, text, error, missing):
    row = checks.check_source_configs(spark.createDataFrame([(text,)], "cfg_json string")).first()
    assert (row.error_type, row.valid) == (error, error is None)
    if missing is not None:
        assert row.missing_fields == missing and row.target_schema.toPython() == {}
