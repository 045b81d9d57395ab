"""Physical plans: what is read, what is shuffled, what is broadcast."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from harvestlens.operators import actions, checks, contracts, pages, runs
from harvestlens.plans import inputs
from harvestlens.sources import inventory, paged

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def load(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_page_inspection_is_one_stage_that_prunes_links(spark):
    df = pages.inspect_pages(load(spark, "pages")).filter("success").select("page_id", "link_count")
    text = plan(df)
    assert "Exchange" not in text
    # Each clean-up pattern is written once: the filter was not copied below the parsing.
    assert text.count("noscript") == plan(pages.page_link_counts(load(spark, "pages"))).count("noscript")


def test_parsing_is_not_repeated_by_filters(spark):
    parsed = actions.parse_actions(inputs.derived(spark, SF, inputs.RESPONSES))
    assert plan(actions.accepted(parsed).filter("action = 'finish'")).count("parseJson") == 1


def test_tool_lookup_broadcasts_the_catalog(spark):
    calls = load(spark, "events").select(F.col("event_type").alias("action"))
    text = plan(contracts.tool_lookup(calls, contracts.tool_catalog(spark)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_argument_check_has_no_shuffle(spark):
    text = plan(entry.queries()["check_arguments"](spark, SF).select("event_id"))
    assert "hashpartitioning(action" not in text and "SortMergeJoin" not in text


def test_listing_reads_no_content(spark):
    text = plan(inventory.list_files(spark, SF))
    assert "ReadSchema: struct<path:string,length:bigint>" in text


def test_preview_limits_before_the_shuffle(spark):
    talk = load(spark, "conversations")
    assert "WindowGroupLimit" in plan(paged.preview_pages(talk, "conv_id", "turn", "text"))
    rows = inputs.derived(spark, SF, inputs.GRID_ROWS)
    assert "WindowGroupLimit" in plan(
        paged.summarize_grids(rows, ["table_id"], ["l_linenumber", "l_partkey"], F.array("c0"))
    )


def test_duplicates_read_only_their_key_and_count_before_the_shuffle(spark):
    text = plan(checks.check_duplicates(load(spark, "documents"), ["text"]))
    assert "ReadSchema: struct<text:string>" in text and "partial_count" in text


def test_row_count_reads_no_column(spark):
    assert "ReadSchema: struct<>" in plan(checks.check_row_count(load(spark, "lineitem")))


def test_record_checks_do_not_shuffle(spark):
    records = inputs.derived(spark, SF, inputs.RESULTS)
    for df in (
        checks.record_missing_fields(records, "event_id", "result_json", ["a"]),
        checks.record_schema_differences(records, "event_id", "result_json", {"a": "b"}),
        checks.record_type_mismatches(records, "event_id", "result_json", {"a": "b"}),
    ):
        assert "Exchange" not in plan(df)


def test_runs_are_ranked_in_one_scan_and_by_slice_if_cut(spark):
    turns = inputs.derived(spark, SF, inputs.TURNS)
    # The number of rows, read from the files' footers before, rules out a run to cut.
    text = plan(runs.run_state(runs.kept_turns(turns, ["ts", "event_id"])))
    assert "hashpartitioning(run_id" in text and text.count("FileScan") == 1
    text = plan(runs.run_state(runs.kept_turns(turns, ["ts", "event_id"], min_rows=20)))
    windows = [line for line in text.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("_slice" in line for line in windows)
    assert text.count("FileScan") == 2
