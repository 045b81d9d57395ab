"""One registered query per operator. Each reads the tables in ``sf_dir`` whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.operators import actions, checks, contracts, fetch, pages, profile, prompts, reports, runs
from harvestlens.operators.ordering import gathered
from harvestlens.plans import inputs
from harvestlens.plans.inputs import derived
from harvestlens.plans.workbook_files import order_workbooks
from harvestlens.session import configure, scratch_dir, spread, table
from harvestlens.sinks import audit, zones
from harvestlens.sources import configs, csv_files, inventory, paged, workbooks
from harvestlens.streaming import run_state as streamed
from harvestlens.streaming import sinks as stream_sinks
from harvestlens.streaming.ordered_runs import stream_ordered_run_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---------------------------------------------------------------- sources


@query
def scan_csv(spark, sf_dir):
    folder = scratch_dir(spark, "csv")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("string"),
        F.concat("o_orderpriority", F.lit(', "q"')).alias("note"),
    )
    # Half of the files have their columns in another order.
    for odd, columns in ((0, orders.columns), (1, orders.columns[::-1])):
        part = orders.filter(F.col("o_orderkey") % 2 == odd).select(*columns)
        part.write.mode("append").option("header", "true").option("escape", '"').csv(folder)
    return csv_files.scan_csv(spark, folder).rows.select(*orders.columns)


@query
def scan_workbook(spark, sf_dir):
    files = order_workbooks(table(spark, sf_dir, "orders"))
    rows = workbooks.scan_workbook(workbooks.decode_workbooks(files))
    return rows.select(
        "path", "sheet_name", "row_idx", F.array_join("header", ",").alias("header"),
        F.col("cells")[0].alias("order_key"), F.col("cells")[1].alias("order_status"),
    )


@query
def inventory_files(spark, sf_dir):
    found = inventory.inventory_files(spark, sf_dir, "*.parquet")
    return found.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "extension", "guessed_mime_type",
        (F.col("size_bytes") > 0).alias("has_content"), F.col("sheet_names").isNull().alias("no_sheets"),
    )


@query
def describe_files(spark, sf_dir):
    suffixes = F.array(*[F.lit(s) for s in (".csv", ".XLSX", ".csv.gz", "", ".parquet", ".pdf")])
    listing = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("storage/raw/s/f"), F.col("event_id").cast("string"),
                 suffixes[(F.col("event_id") % 6).cast("int")]).alias("path"),
        F.length("props").cast("long").alias("size_bytes"),
    )
    return inventory.describe_files(listing)


@query
def missing_files(spark, sf_dir):
    listing = table(spark, sf_dir, "events").select(
        F.concat(F.lit("raw/s"), F.col("user_id").cast("string"), F.lit("/f"), F.col("event_id").cast("string"))
        .alias("path")
    )
    asked = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("raw/s"), F.col("c_custkey").cast("string")).alias("path")
    )
    return inventory.missing_files(asked, listing)


def _talk_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("turn") + 1).alias("page_number"), "text"
    )


@query
def preview_pages(spark, sf_dir):
    return paged.preview_pages(_talk_pages(spark, sf_dir), "conv_id", "page_number", "text")


@query
def check_page_numbers(spark, sf_dir):
    talks = _talk_pages(spark, sf_dir)
    asked = talks.select("conv_id", (F.col("page_number") * 2 - 2).alias("asked_page"))
    return paged.check_page_numbers(asked, talks, "conv_id", "asked_page")


@query
def summarize_grids(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    rows = derived(spark, sf_dir, inputs.GRID_ROWS)
    return paged.summarize_grids(rows, ["table_id"], order, F.array("c0", "c1", "c2")).withColumn(
        "sample_rows", F.to_json("sample_rows")
    )


@query
def scan_source_configs(spark, sf_dir):
    texts = derived(spark, sf_dir, inputs.CONFIGS).withColumnRenamed("cfg_json", "text")
    parsed = configs.parse_source_configs(texts)
    return parsed.select(
        "s_suppkey", F.get_json_object("cfg_json", "$.source_type").alias("source_type"), "parse_error"
    )


# ---------------------------------------------------------------- sinks


def _downloads(spark, sf_dir):
    return derived(spark, sf_dir, inputs.DOWNLOADS).withColumn("content", F.encode("body", "UTF-8")).drop("body")


@query
def land_raw(spark, sf_dir):
    root = scratch_dir(spark, "raw")
    downloads = _downloads(spark, sf_dir)
    # A third of the files comes twice, with other bytes first.
    zones.land_raw(downloads.filter("event_id % 3 = 0").withColumn("content", F.lit(b"old")), root)
    zones.land_raw(downloads, root)
    schema = "event_id long, url string, source_id string, filename string, content binary, content_type string"
    landed = zones.read_zone(spark, root, schema)
    return landed.select(
        "event_id", "source_id", "filename", F.octet_length("content").cast("long").alias("bytes"),
        F.decode("content", "UTF-8").alias("body"),
    )


@query
def landing_manifest(spark, sf_dir):
    return zones.land_raw(_downloads(spark, sf_dir), scratch_dir(spark, "raw"))


@query
def write_processed(spark, sf_dir):
    base = scratch_dir(spark, "zones")
    ready = zones.accepted_fetches(_downloads(spark, sf_dir)).select(
        "event_id", "source_id",
        F.get_json_object(F.decode("content", "UTF-8"), "$.k").cast("long").alias("k"),
    )
    zones.write_processed(ready, f"{base}/processed", f"{base}/raw")
    return zones.read_zone(spark, f"{base}/processed", "event_id long, source_id string, k long")


@query
def append_audit(spark, sf_dir):
    folder = scratch_dir(spark, "audit")
    audit.append_audit(runs.audit_records(_kept(spark, sf_dir, inputs.DETAILED_TURNS)), folder)
    return audit.read_audit(spark, folder)


@query
def stream_audit(spark, sf_dir):
    base = scratch_dir(spark, "audit-stream")
    records = runs.audit_records(_kept(spark, sf_dir, inputs.DETAILED_TURNS))
    records.write.parquet(f"{base}/in")
    arriving = stream_sinks.read_table_stream(spark, f"{base}/in", records.schema)
    stream_sinks.stream_audit(arriving, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return audit.read_audit(spark, f"{base}/out")


@query
def dump_run_state(spark, sf_dir):
    folder = scratch_dir(spark, "state")
    turns = derived(spark, sf_dir, inputs.DETAILED_TURNS)
    configs = turns.groupBy("run_id").agg(F.max("source_id").alias("source_id")).select(
        "run_id", F.to_json(F.struct("source_id")).alias("source_config")
    )
    counted = checks.check_row_count(turns, minimum=60, group_by=["run_id"])
    verdicts = counted.select(
        "run_id", F.lit("row_count").alias("check"), "passed", F.to_json(F.struct("row_count")).alias("detail_json")
    )
    records = runs.run_records(_kept(spark, sf_dir, inputs.DETAILED_TURNS), configs, verdicts)
    audit.dump_run_state(records, folder)
    lines = audit.read_run_state(spark, folder, records.schema)

    def call(r):
        # Nested objects come back with sorted keys: the result is told by its parts.
        parts = [F.get_json_object(r["result"], f"$.{name}") for name in ("success", "file_path", "message", "reason")]
        return [r["step"].cast("string"), r["action"], r["arguments"], *parts]

    def verdict(r):
        return [r["check"], r["passed"].cast("string"), r["detail_json"]]

    def joined(name, fields):
        return F.array_join(F.transform(name, lambda r: F.concat_ws("|", *fields(r))), ";").alias(name)

    return lines.select(
        "run_id", "part", "source_config", "max_steps", "current_step", "status", joined("tool_history", call),
        *[F.array_join(name, ";").alias(name) for name in ("observations", "artifacts", "errors")],
        joined("validation_results", verdict), "finish_reason", "n_calls", "n_errors",
    )


# ---------------------------------------------------------------- profiles


@query
def profile_shape(spark, sf_dir):
    names = ("orders", "lineitem", "events", "documents")
    return reduce(DataFrame.unionByName, [profile.profile_shape(table(spark, sf_dir, n), n) for n in names])


@query
def profile_columns(spark, sf_dir):
    return profile.profile_columns(derived(spark, sf_dir, inputs.ROWS_WITH_NULLS), "customer").unionByName(
        profile.profile_columns(table(spark, sf_dir, "events"), "events")
    )


@query
def profile_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return profile.profile_sample(orders, ["o_orderkey"], 5)


# ---------------------------------------------------------------- pages


def _dirty_pages(spark, sf_dir):
    return derived(spark, sf_dir, inputs.DIRTY_PAGES, "page_id")


@query
def inspect_pages(spark, sf_dir):
    record = pages.inspect_pages(_dirty_pages(spark, sf_dir))
    return record.select(
        "page_id", "success", "blocked", "block_type", "empty_page", "title",
        F.length("text").cast("long").alias("text_len"), "link_count", "iframe_count", "html_length",
    )


@query
def open_results(spark, sf_dir):
    return pages.open_results(_dirty_pages(spark, sf_dir), "page_id")


@query
def normalize_urls(spark, sf_dir):
    return fetch.normalize_urls(derived(spark, sf_dir, inputs.DIRTY_URLS)).drop("raw_url")


@query
def validate_urls(spark, sf_dir):
    return fetch.validate_urls(derived(spark, sf_dir, inputs.DIRTY_URLS)).select(
        "page_id", "url_norm", "valid", "error_type", "recoverable"
    )


@query
def detect_blocked(spark, sf_dir):
    described = pages.page_texts(pages.page_titles(_dirty_pages(spark, sf_dir)))
    return pages.detect_blocked(described).select("page_id", "block_type")


@query
def page_titles(spark, sf_dir):
    return pages.page_titles(_dirty_pages(spark, sf_dir)).select("page_id", "title")


@query
def page_texts(spark, sf_dir):
    return pages.page_texts(_dirty_pages(spark, sf_dir)).select("page_id", "text")


@query
def page_links(spark, sf_dir):
    return pages.explode_links(pages.page_links(spread(table(spark, sf_dir, "pages"), "page_id")), "page_id")


@query
def page_link_counts(spark, sf_dir):
    return pages.page_link_counts(_dirty_pages(spark, sf_dir)).select("page_id", "link_count")


@query
def page_frames(spark, sf_dir):
    return pages.page_frames(_dirty_pages(spark, sf_dir)).select("page_id", "iframe_count")


@query
def page_html_stats(spark, sf_dir):
    return pages.page_html_stats(_dirty_pages(spark, sf_dir)).select("page_id", "html_length", "html_preview")


# ---------------------------------------------------------------- fetches


@query
def check_fetch_requests(spark, sf_dir):
    return fetch.check_fetch_requests(derived(spark, sf_dir, inputs.FETCHES)).select(
        "event_id", "error_type", "recoverable"
    )


@query
def classify_fetch_outcomes(spark, sf_dir):
    return fetch.classify_fetch_outcomes(derived(spark, sf_dir, inputs.FETCHES)).select(
        "event_id", "success", "error_type", "recoverable"
    )


@query
def storage_paths(spark, sf_dir):
    accepted = fetch.check_fetch_requests(derived(spark, sf_dir, inputs.FETCHES)).filter("error_type IS NULL")
    return fetch.storage_paths(accepted).select("event_id", "raw_path", "processed_path")


# ---------------------------------------------------------------- checks

RESULT_SCHEMA = {"success": "BOOLEAN", "message": "STRING", "bytes": "STRING", "shape": "OBJECT"}


@query
def check_source_configs(spark, sf_dir):
    return checks.check_source_configs(derived(spark, sf_dir, inputs.CONFIGS)).select(
        "s_suppkey", F.array_join("missing_fields", ",").alias("missing_fields"), "valid",
        F.to_json("target_schema").alias("target_schema"),
    )


@query
def check_required_fields(spark, sf_dir):
    return checks.record_missing_fields(
        derived(spark, sf_dir, inputs.RESULTS, "event_id"), "event_id", "result_json", ["success", "message"]
    )


@query
def check_schema(spark, sf_dir):
    expected = {"success": "BOOLEAN", "message": "STRING"}
    return checks.record_schema_differences(
        derived(spark, sf_dir, inputs.RESULTS, "event_id"), "event_id", "result_json", expected
    )


@query
def check_types(spark, sf_dir):
    return checks.record_type_mismatches(
        derived(spark, sf_dir, inputs.RESULTS, "event_id"), "event_id", "result_json", RESULT_SCHEMA
    )


@query
def check_row_count(spark, sf_dir):
    return checks.check_row_count(table(spark, sf_dir, "lineitem"), 10_000, 30_000, ["l_returnflag"])


@query
def check_duplicates(spark, sf_dir):
    return checks.check_duplicates(table(spark, sf_dir, "documents"), ["text"])


@query
def check_duplicates_composite(spark, sf_dir):
    return checks.check_duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def check_date_range(spark, sf_dir):
    return checks.check_date_range(
        table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1998-12-31"
    ).select("o_orderkey", "value", "side")


@query
def check_nulls(spark, sf_dir):
    return checks.check_nulls(
        derived(spark, sf_dir, inputs.ROWS_WITH_NULLS), ["c_name", "c_acctbal", "c_mktsegment", "c_phone"]
    )


@query
def check_report(spark, sf_dir):
    expected = {"o_orderkey": "INT", "o_totalprice": "decimal", "o_comment": "string"}
    orders = reports.report(
        table(spark, sf_dir, "orders"),
        "orders",
        reports.required_fields(["o_orderkey", "o_comment"]),
        reports.schema(expected),
        reports.types(expected),
        reports.row_count(),
        reports.duplicates(["o_orderkey"]),
        reports.date_range("o_orderdate", "1996-01-01", "1998-12-31"),
        reports.nulls(["o_orderstatus", "o_custkey"]),
    )
    customers = reports.report(
        derived(spark, sf_dir, inputs.ROWS_WITH_NULLS),
        "customer",
        reports.row_count(maximum=100),
        reports.duplicates(["c_mktsegment"]),
        reports.nulls(["c_name", "c_mktsegment"]),
    )
    return checks.check_report(orders, customers)


# ---------------------------------------------------------------- actions


def _parsed(spark, sf_dir):
    return actions.parse_actions(derived(spark, sf_dir, inputs.RESPONSES, "event_id"))


def _calls(spark, sf_dir):
    return actions.accepted(_parsed(spark, sf_dir)).select("event_id", "action", "arguments")


@query
def parse_actions(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "action", "error_type")


@query
def tool_lookup(spark, sf_dir):
    return contracts.tool_lookup(_calls(spark, sf_dir), contracts.tool_catalog(spark)).select(
        "event_id", "action", "category", "enabled", "error_type"
    )


@query
def check_arguments(spark, sf_dir):
    return contracts.check_arguments(_calls(spark, sf_dir), contracts.tool_catalog(spark)).select(
        "event_id", "action", "violation", "argument"
    )


@query
def check_argument_types(spark, sf_dir):
    """Contracts of every kind of type over the real JSON of the events."""
    k = contracts.argument
    declared = {
        "view": [k("k", "string")],
        "click": [k("k", "integer", minimum=50.0), k("q", "boolean", required=True)],
        "purchase": [k("k", "string|number")],
        "signup": [k("k", "array|object", nullable=True)],
    }
    catalog = contracts.catalog_of(spark, [(name, "event", "", True, True, False, c) for name, c in declared.items()])
    events = table(spark, sf_dir, "events")
    calls = events.select("event_id", F.col("event_type").alias("action"), F.try_parse_json("props").alias("arguments"))
    return contracts.check_arguments(calls, catalog).select("event_id", "action", "violation", "argument")


@query
def route_actions(spark, sf_dir):
    return actions.route_actions(_calls(spark, sf_dir), contracts.tool_catalog(spark)).select(
        "event_id", "action", "route", "error_type"
    )


@query
def finish_results(spark, sf_dir):
    return actions.finish_results(_calls(spark, sf_dir))


@query
def tool_error_results(spark, sf_dir):
    return actions.tool_error_results(derived(spark, sf_dir, inputs.FAILURES))


@query
def normalize_results(spark, sf_dir):
    return actions.normalize_results(derived(spark, sf_dir, inputs.RESULTS, "event_id")).select(
        "event_id", "success", "file_path", "message", "wrapped", "duration_seconds"
    )


# ---------------------------------------------------------------- runs


def _kept(spark, sf_dir, turns=inputs.TURNS):
    return runs.kept_turns(derived(spark, sf_dir, turns), ["ts", "event_id"])


@query
def run_state(spark, sf_dir):
    return runs.run_state(_kept(spark, sf_dir, inputs.DETAILED_TURNS))


@query
def stream_run_state(spark, sf_dir):
    base = scratch_dir(spark, "turns")
    at = F.expr("TIMESTAMP'1970-01-01 00:00:00Z' + (ts - TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    turns = derived(spark, sf_dir, inputs.DETAILED_TURNS).select(
        "run_id", at.alias("at"), "event_id", "kind", "success", "max_steps", "reason", "message"
    )
    turns.write.parquet(f"{base}/in")
    # A last heartbeat tells that nothing earlier will follow.
    heartbeat = turns.agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at")).where("at IS NOT NULL")
    heartbeat.select(
        *[(F.col("at") if c == "at" else F.lit(None).cast(t)).alias(c) for c, t in turns.dtypes]
    ).write.mode("append").parquet(f"{base}/in")
    arriving = stream_sinks.read_table_stream(spark, f"{base}/in", turns.schema)
    updates = stream_ordered_run_state(arriving, at="at")
    stream_sinks.append_updates(updates, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return streamed.latest_run_state(spark.read.schema(updates.schema).parquet(f"{base}/out"))


@query
def audit_records(spark, sf_dir):
    return runs.audit_records(_kept(spark, sf_dir, inputs.DETAILED_TURNS))


@query
def run_artifacts(spark, sf_dir):
    files = runs.run_artifacts(_kept(spark, sf_dir))
    return gathered(files, ["run_id"], "step", F.col("file_path"), "artifacts").withColumn(
        "artifacts", F.array_join("artifacts", ",")
    )


@query
def run_errors(spark, sf_dir):
    return runs.run_errors(_kept(spark, sf_dir, inputs.DETAILED_TURNS))


@query
def run_observations(spark, sf_dir):
    return runs.run_observations(_kept(spark, sf_dir, inputs.DETAILED_TURNS))


@query
def run_history(spark, sf_dir):
    history = runs.run_history(_kept(spark, sf_dir, inputs.DETAILED_TURNS))
    shown = F.transform(
        "history", lambda h: F.concat_ws("|", h["step"].cast("string"), h["action"], h["arguments"], h["result"])
    )
    return history.select("run_id", "part", F.array_join(shown, ";").alias("history"))


@query
def build_prompts(spark, sf_dir):
    kept = _kept(spark, sf_dir, inputs.DETAILED_TURNS)
    known = derived(spark, sf_dir, inputs.CONFIGS).select(F.col("s_suppkey").alias("run_id"), "cfg_json")
    everyone = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"))
    return prompts.build_prompts(everyone, kept, known, contracts.tool_catalog(spark))
