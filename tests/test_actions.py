import pytest
from pyspark.sql import functions as F

from harvestlens.operators import actions, contracts


def parse(spark, response, strict="native"):
    return actions.parse_actions(spark.createDataFrame([(response,)], "response string"), strict=strict).first()


GOOD = '{"action": "read_csv", "arguments": {"path": "p"}}'


@pytest.mark.parametrize("strict", ["native", "exact"])
@pytest.mark.parametrize(
    "response, error",
    [
        (GOOD, None),
        ("  " + GOOD + "\n ", None),
        ('{"action":"a","action":"b","arguments":{}}', None),
        ("", "empty"),
        (" \t ", "empty"),
        (None, "empty"),
        ("<think>x</think>" + GOOD, "thinking"),
        ("```json\n" + GOOD + "\n```", "fence"),
        ("I will call it now.", "invalid_json"),
        (GOOD + " trailing", "invalid_json"),
        (GOOD + "," + GOOD, "invalid_json"),
        (GOOD + "]", "invalid_json"),
        (GOOD[:-2], "invalid_json"),
        ("{'action': 'a', 'arguments': {}}", "invalid_json"),
        ("[1]", "not_object"),
        ('"text"', "not_object"),
        ("null", "not_object"),
        ('{"arguments": {}}', "no_action"),
        ('{"action": "finish"}', "no_arguments"),
        ('{"action": 123, "arguments": {}}', "action_not_string"),
        ('{"action": null, "arguments": {}}', "action_not_string"),
        ('{"action": "a", "arguments": "x"}', "arguments_not_object"),
        ('{"action": "a", "arguments": null}', "arguments_not_object"),
    ],
)
def test_parse(spark, response, error, strict):
    row = parse(spark, response, strict)
    assert row.error_type == error
    assert (row.action is None) == (error is not None)
    assert row.message == (None if error is None else actions.PARSE_MESSAGES[error])


def test_the_last_of_equal_keys_wins(spark):
    assert parse(spark, '{"action":"a","action":"b","arguments":{}}').action == "b"


def routed(spark, *pairs):
    calls = spark.createDataFrame(list(pairs), "action string, a string").select(
        "action", F.parse_json("a").alias("arguments")
    )
    return actions.route_actions(calls, contracts.tool_catalog(spark))


@pytest.mark.parametrize(
    "action, arguments, route, error",
    [
        ("finish", '{"reason":"Done."}', "finish", None),
        ("does_not_exist", "{}", "reject", "ToolNotFoundError"),
        ("browser_click", "{}", "reject", "ToolDisabledError"),
        ("http_download", '{"url":"u"}', "reject", "InvalidArgumentsError"),
        ("http_download", '{"url":"u","source_id":123,"filename":"f"}', "reject", "InvalidArgumentsError"),
        ("read_csv", '{"path":"p","bogus":1}', "reject", "InvalidArgumentsError"),
        ("read_csv", '["p"]', "reject", "InvalidArgumentsError"),
        ("browser_open", "{}", "reject", "InvalidArgumentsError"),
        ("browser_inspect", "{}", "dispatch", None),
        ("browser_close", "{}", "dispatch", None),
        ("read_csv", '{"path":"p","sample_rows":5.0}', "dispatch", None),
        ("read_csv", '{"path":"p","sample_rows":5.5}', "reject", "InvalidArgumentsError"),
        ("read_csv", '{"path":"p","sample_rows":true}', "reject", "InvalidArgumentsError"),
        ("read_csv", '{"path":"p","sample_rows":null}', "reject", "InvalidArgumentsError"),
        ("read_excel", '{"path":"p","sheet_name":null}', "dispatch", None),
        ("validate_row_count", '{"row_count":1e3,"maximum":null}', "dispatch", None),
        ("validate_row_count", '{"row_count":-5}', "dispatch", None),
        ("validate_required_fields", '{"columns":[],"required_fields":["a"]}', "dispatch", None),
        ("validate_required_fields", '{"columns":["a",1],"required_fields":[]}', "reject", "InvalidArgumentsError"),
        ("validate_required_fields", '{"columns":["a",null],"required_fields":[]}', "reject", "InvalidArgumentsError"),
        ("validate_required_fields", '{"columns":"a","required_fields":[]}', "reject", "InvalidArgumentsError"),
    ],
)
def test_route(spark, action, arguments, route, error):
    row = routed(spark, (action, arguments)).first()
    assert (row.route, row.error_type) == (route, error)


def test_violations(spark):
    calls = spark.createDataFrame(
        [("http_download", '{"source_id":1,"timeout":0,"more":[]}')], "action string, a string"
    ).select("action", F.parse_json("a").alias("arguments"))
    got = contracts.check_arguments(calls, contracts.tool_catalog(spark))
    assert {(r.violation, r.argument) for r in got.collect()} == {
        ("missing", "url"), ("missing", "filename"), ("wrong_type", "source_id"), ("below_minimum", "timeout"),
        ("unexpected", "more"),
    }


KINDS = {
    "string": '"x"', "integer": "5", "whole": "5.0", "number": "5.5", "boolean": "true", "array": "[1]", "object": '{"a":1}', "null": "null",
}


@pytest.mark.parametrize("declared, fitting", [
    ("string", {"string"}), ("integer", {"integer", "whole"}), ("number", {"integer", "whole", "number"}),
    ("boolean", {"boolean"}), ("array", {"array"}), ("object", {"object"}), ("null", {"null"}),
    ("string|integer|null", {"string", "integer", "whole", "null"}), ("array|object", {"array", "object"}),
])
def test_declared_types(spark, declared, fitting):
    catalog = contracts.catalog_of(spark, [
        ("t", "c", "", True, True, False, [contracts.argument("v", declared), contracts.argument("all", "array", items=declared)])
    ])
    calls = spark.createDataFrame(
        [(k, "t", f'{{"v":{v}}}') for k, v in KINDS.items()] + [(f"items {k}", "t", f'{{"all":[{v},{v}]}}') for k, v in KINDS.items()],
        "k string, action string, a string",
    ).select("k", "action", F.parse_json("a").alias("arguments"))
    got = {(r.k, r.violation, r.argument) for r in contracts.check_arguments(calls, catalog).collect()}
    wrong = set(KINDS) - fitting
    assert got == {(k, "wrong_type", "v") for k in wrong} | {(f"items {k}", "wrong_item_type", "all") for k in wrong}


def test_an_unknown_declared_type_is_refused():
    with pytest.raises(ValueError):
        contracts.argument("a", "string|decimal")


def test_catalog(spark):
    catalog = contracts.tool_catalog(spark)
    assert catalog.count() == 23 and catalog.filter("enabled").count() == 11
    assert contracts.tool_arguments(catalog).count() == 21
    calls = spark.createDataFrame([("nope",), ("read_csv",)], "action string")
    assert [r.action for r in contracts.unknown_tools(calls, catalog).collect()] == ["nope"]


def test_finish_reason(spark):
    calls = spark.createDataFrame(
        [("finish", '{"reason":"Done."}'), ("finish", "{}"), ("read_csv", "{}")], "action string, a string"
    ).select("action", F.parse_json("a").alias("arguments"))
    assert sorted(r.reason for r in actions.finish_results(calls).collect()) == ["", "Done."]


def test_results(spark):
    rows = [('{"success":null}', 1.00005), ('{"x":1}', 0.0), ("[1]", 2.0), ('{"success":false,"message":"m"}', 3.0)]
    df = spark.createDataFrame(rows, "result_json string, duration double")
    got = [(r.success, r.wrapped, r.message) for r in actions.normalize_results(df).collect()]
    assert got == [(False, False, None), (True, False, None), (True, True, None), (False, False, "m")]


def test_tool_errors(spark):
    rows = [("RuntimeError", None, "kept", None, 0.12345), ("ToolExecutionError", "CsvReadError", "m", False, 1.0),
            ("ToolExecutionError", None, None, None, 1.0)]
    df = spark.createDataFrame(
        rows, "exception_class string, error_type string, message string, recoverable boolean, duration double"
    )
    got = [(r.success, r.error_type, r.message, r.recoverable) for r in actions.tool_error_results(df).collect()]
    assert got == [(False, "RuntimeError", "kept", True), (False, "CsvReadError", "m", False),
                   (False, "ToolExecutionError", "", True)]


def test_unreadable_results_are_failures(spark):
    from harvestlens.operators.actions import normalize_results

    texts = ['{"success":false,"message":"boom"', None, '"plain"', "null", '{"a":1}']
    table = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)], "k int, result_json string, duration double")
    got = {r.k: r for r in normalize_results(table).drop("payload").collect()}
    assert [got[k].success for k in range(5)] == [False, False, True, True, True]
    assert [got[k].wrapped for k in range(5)] == [False, False, True, True, False]
    assert got[0].error_type == got[1].error_type == "UnreadableResult"
