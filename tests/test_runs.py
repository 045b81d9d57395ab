"""The run fold against a plain sequential replay, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from harvestlens.operators import contracts, ordering, prompts, runs
from harvestlens.streaming import run_state as streamed
from harvestlens.streaming import sinks

TURN = "run_id long, turn_seq long, kind string, success boolean, max_steps int, file_path string, message string"


def replay(turns):
    """One run, turn by turn: status, step, calls, errors, files."""
    limit, status, step, calls, errors, files = turns[0][4], "running", 0, 0, [], []
    for _, _, kind, ok, _, path, message in turns:
        if status != "running":
            break
        if kind == "model_failure":
            status = "failed"
            errors.append(f"Model generation error: {message}")
            continue
        if kind == "parse_error":
            errors.append(f"PARSE_ERROR: {message}")
        elif kind == "action_error":
            errors.append(f"ACTION_ERROR (InvalidArgumentsError): {message}")
        else:
            calls += 1
            if kind == "call" and ok and path:
                files.append(path)
            if kind == "call" and not ok:
                errors.append(f"step={step} action=: {message}")
            if kind == "finish":
                status = "finished"
                continue
        step += 1
        if step >= limit:
            status = "max_steps_reached"
    return status, step, calls, errors, files


def random_turns(seed, n_runs=60, hot=400):
    rng, rows = random.Random(seed), []
    for run in range(n_runs):
        limit = rng.choice([0, 1, 2, 5, 20, 1000])
        for seq in range(1, (hot if run == 0 else rng.randint(1, 30)) + 1):
            kind = rng.choices(
                ["call", "parse_error", "action_error", "finish", "model_failure"],
                [60, 10, 10, 0 if run == 0 and seq < 390 else 3, 0 if run == 0 else 2],
            )[0]
            path = rng.choice([None, "", f"f{seq}"])
            rows.append((run, seq, kind, rng.random() < 0.6, 1000 if run == 0 else limit, path, f"m{seq}"))
    return rows


def expected(rows):
    grouped = {}
    for row in sorted(rows):
        grouped.setdefault(row[0], []).append(row)
    return {run: replay(turns) for run, turns in grouped.items()}


@pytest.mark.parametrize("min_rows", [1_000_000, 20])
def test_fold_equals_replay(spark, min_rows):
    rows = random_turns(7)
    want = expected(rows)
    shuffled = spark.createDataFrame(rows, TURN).repartition(5)
    kept = runs.kept_turns(shuffled, min_rows=min_rows).cache()
    states = {r.run_id: r for r in runs.run_state(kept).collect()}
    errors, files = {}, {}
    for r in runs.run_errors(kept).orderBy("run_id", "step").collect():
        errors.setdefault(r.run_id, []).append(r.error)
    for r in runs.run_artifacts(kept).orderBy("run_id", "step").collect():
        files.setdefault(r.run_id, []).append(r.file_path)
    for run, (status, step, calls, errs, paths) in want.items():
        got = states[run]
        assert (got.status, got.current_step, got.n_calls, got.n_errors) == (status, step, calls, len(errs)), run
        assert errors.get(run, []) == errs and files.get(run, []) == paths


@pytest.mark.parametrize(
    "kinds, limit, state",
    [
        (["call", "call"], 2, ("max_steps_reached", 2, 2)),
        (["call"], 2, ("running", 1, 1)),
        (["call", "finish"], 10, ("finished", 1, 2)),
        (["call", "finish"], 2, ("finished", 1, 2)),
        (["parse_error", "finish"], 10, ("finished", 1, 1)),
        (["action_error"] * 10, 3, ("max_steps_reached", 3, 0)),
        (["model_failure", "call"], 3, ("failed", 0, 0)),
        (["call", "call"], 0, ("max_steps_reached", 1, 1)),
        (["call"] * 25, None, ("max_steps_reached", 20, 20)),
    ],
)
def test_boundaries(spark, kinds, limit, state):
    rows = [(1, i, kind, True, limit, None, "m") for i, kind in enumerate(kinds, 1)]
    row = runs.run_state(runs.kept_turns(spark.createDataFrame(rows, TURN))).first()
    assert (row.status, row.current_step, row.n_calls) == state


def test_finish_reason_and_failure_text(spark):
    rows = [(1, 1, "finish", None, 5, None, None), (2, 1, "model_failure", None, 5, None, "boom")]
    states = runs.run_state(runs.kept_turns(spark.createDataFrame(rows, TURN)))
    assert {r.run_id: r.finish_reason for r in states.collect()} == {1: "", 2: "Model generation error: boom"}


@pytest.mark.parametrize("min_rows", [10, 1_000_000])
def test_ranks_survive_a_hot_group_and_outliers(spark, min_rows):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.random() * 100, 1e9]), i) for i in range(3_000)]
    rows += [(f"g{i % 50}", float(rng.randint(0, 5)), 10_000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, at double, id long").repartition(6)
    got = ordering.ranked(df, ["g"], ["at", "id"], min_rows=min_rows,
                          before={"seen": F.col("id") % 700 == 0})
    got = {(r.g, r.id): (r["rank"], r.seen) for r in got.collect()}
    groups = {}
    for g, at, i in rows:
        groups.setdefault(g, []).append((at, i))
    for g, members in groups.items():
        seen = False
        for rank, (_, i) in enumerate(sorted(members)):
            assert got[g, i] == (rank, seen)
            seen = seen or i % 700 == 0


def test_cut_groups_are_many_slices(spark):
    df = spark.range(1_000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("at"))
    assert len(ordering.quantile_cuts(df, ["g"], ["at"], min_rows=50).first()._cuts) == 19
    assert ordering.quantile_cuts(df, ["g"], ["at"], min_rows=1_000) is None


def test_a_burst_is_cut_evenly(spark):
    # 990 of 1 000 rows fall into one instant; the second order column tells them apart.
    df = spark.range(1_000).select(
        F.lit("g").alias("g"), F.when(F.col("id") < 990, 500).otherwise(F.col("id")).alias("at"), F.col("id")
    ).repartition(4)
    cuts = ordering.quantile_cuts(df, ["g"], ["at", "id"], min_rows=10)
    place = ordering.slice_of(F.struct("at", "id"), F.col("_cuts"))
    sizes = [r["count"] for r in df.join(cuts, "g").groupBy(place.alias("s")).count().collect()]
    assert len(sizes) == 100 and max(sizes) <= 11
    cut, uncut = (
        sorted(map(tuple, ordering.ranked(df, ["g"], ["at", "id"], min_rows=n, before={"odd": F.col("id") == 600}).collect()))
        for n in (10, 10_000)
    )
    assert cut == uncut


def test_a_large_group_without_a_key_is_cut(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "k").alias("g"), F.col("id").alias("at"))
    got = ordering.ranked(df, ["g"], ["at"], min_rows=20).collect()
    assert {(r.g, r.at): r["rank"] for r in got} == {
        (("k" if i % 3 == 0 else None), i): (i // 3 if i % 3 == 0 else i - i // 3 - 1) for i in range(300)
    }


def test_long_groups_continue_in_parts(spark):
    df = spark.range(25).select(F.lit("g").alias("g"), F.col("id").alias("rank"))
    parts = ordering.gathered(df, ["g"], "rank", F.col("rank"), "ids", part_rows=10).orderBy("part").collect()
    assert [len(p.ids) for p in parts] == [10, 10, 5]
    assert [i for p in parts for i in p.ids] == list(range(25))


def test_history_and_audit(spark):
    rows = [
        (1, 1, "call", True, 5, "f", None), (1, 2, "parse_error", None, 5, None, "bad"),
        (1, 3, "call", False, 5, None, "boom"), (1, 4, "finish", None, 5, None, None),
    ]
    turns = spark.createDataFrame(rows, TURN).withColumn("action", F.lit("http_download")).withColumn(
        "duration_seconds", F.lit(0.12345)
    )
    kept = runs.kept_turns(turns)
    audit = [tuple(r) for r in runs.audit_records(kept).orderBy("step").select(
        "step", "tool_name", "success", "error", "duration_seconds").collect()]
    assert audit == [(0, "http_download", True, None, 0.1235), (2, "http_download", False, "boom", 0.1235),
                     (3, "finish", True, None, 0.0)]
    history = runs.run_history(kept).first().history
    assert [(h.step, h.action) for h in history] == [(0, "http_download"), (2, "http_download"), (3, "finish")]
    seen = [r.observation for r in runs.run_observations(kept).orderBy("step").collect()]
    assert seen[1] == "PARSE_ERROR: bad" and seen[0].startswith("step=0 action=http_download result=")


def test_prompts_hold_four_sections_and_split_long_runs(spark):
    rows = [(1, i, "call", True, 50, f"f{i}", None) for i in range(1, 26)]
    kept = runs.kept_turns(spark.createDataFrame(rows, TURN))
    everyone = spark.createDataFrame([(1,), (2,)], "run_id long")
    configs = spark.createDataFrame([(1, '{"title":"é"}')], "run_id long, cfg_json string")
    got = prompts.build_prompts(everyone, kept, configs, contracts.tool_catalog(spark), part_rows=10).collect()
    by_key = {(r.run_id, r.part, r.role): r.content for r in got}
    assert set(by_key) == {(1, 0, "system"), (1, 0, "user"), (1, 1, "user"), (1, 2, "user"), (2, 0, "system"),
                           (2, 0, "user")}
    first = by_key[1, 0, "user"]
    marks = ["SOURCE CONFIGURATION", "AVAILABLE TOOLS", "PREVIOUS TOOL CALLS", "OBSERVATIONS FROM PREVIOUS STEPS"]
    assert sorted(first.index(m) for m in marks) == [first.index(m) for m in marks]
    assert '{"title":"é"}' in first and first.count('"step":') == 10 and "browser_click" not in first
    assert by_key[1, 2, "user"].count('"step":') == 5
    empty = by_key[2, 0, "user"]
    assert "PREVIOUS TOOL CALLS:\n\n[]" in empty and "SOURCE CONFIGURATION:\n\n{}" in empty


def run_stream(spark, folder, base):
    arriving = sinks.read_table_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    updates = streamed.stream_run_state(arriving)
    sinks.append_updates(updates, f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_stream_equals_batch_with_early_and_repeated_turns(spark, tmp_path):
    rows = random_turns(11, n_runs=20, hot=60)
    random.Random(1).shuffle(rows)
    folder = f"{tmp_path}/in"
    for i in range(0, len(rows), 120):
        # Each batch repeats some turns of the one before.
        spark.createDataFrame(rows[max(0, i - 20) : i + 120], TURN).coalesce(1).write.mode("append").parquet(folder)
    final = streamed.latest_run_state(run_stream(spark, folder, tmp_path))
    batch = runs.run_state(runs.kept_turns(spark.createDataFrame(rows, TURN)))
    columns = ["run_id", "status", "current_step", "n_calls", "n_errors", "finish_reason"]
    assert {tuple(r) for r in final.select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}
    n = spark.read.parquet(f"{tmp_path}/out").count()
    assert run_stream(spark, folder, tmp_path).count() == n


def test_cut_groups_rank_missing_positions_like_uncut_ones(spark):
    from harvestlens.operators.ordering import ranked

    rows = [(1, k, None if k < 5 else k) for k in range(20)] + [(2, 0, 3)]
    turns = spark.createDataFrame(rows, "run long, event long, at long")
    cut, uncut = (
        sorted(map(tuple, ranked(turns, ["run"], ["at", "event"], min_rows=n).fillna(-1, ["at"]).collect())) for n in (4, 1_000)
    )
    assert cut == uncut
    assert sorted(r[-1] for r in cut if r[0] == 1) == list(range(20))


def test_run_records_hold_all_of_a_run_in_parts(spark, tmp_path):
    import json

    from harvestlens.sinks import audit

    columns = "run_id long, turn_seq long, kind string, success boolean, max_steps int, action string, arguments string, result string, message string, file_path string, reason string"
    rows = [
        (1, 1, "call", True, 9, "read_csv", '{"path":"p"}', '{"success":true}', None, "f1", None),
        (1, 2, "parse_error", None, 9, None, None, None, "bad", None, None),
        (1, 3, "call", False, 9, "read_csv", "{}", '{"success":false}', "boom", "f3", None),
        (1, 4, "finish", True, 9, "finish", '{"reason":"end"}', "{}", None, None, "end"),
        (2, 1, "model_failure", None, None, None, None, None, "down", None, None),
    ]
    kept = runs.kept_turns(spark.createDataFrame(rows, columns))
    configs = spark.createDataFrame([(1, '{"source_id":"s"}')], "run_id long, source_config string")
    verdicts = spark.createDataFrame([(1, "nulls", False, '{"n":1}'), (1, "a", True, "{}")],
                                     "run_id long, check string, passed boolean, detail_json string")
    whole = {r.run_id: r for r in runs.run_records(kept, configs, verdicts).collect()}
    one, two = whole[1], whole[2]
    assert (one.status, one.max_steps, one.current_step, one.finish_reason) == ("finished", 9, 3, "end")
    assert [(c.step, c.action, c.arguments) for c in one.tool_history] == [
        (0, "read_csv", '{"path":"p"}'), (2, "read_csv", "{}"), (3, "finish", '{"reason":"end"}')]
    assert one.artifacts == ["f1"] and one.errors[0] == "PARSE_ERROR: bad" and len(one.errors) == 2
    assert len(one.observations) == 4 and [v["check"] for v in one.validation_results] == ["a", "nulls"]
    assert (two.status, two.max_steps, two.tool_history, two.observations, two.source_config, two.validation_results) == (
        "failed", 20, [], [], None, [])
    assert two.errors == [two.finish_reason]

    parts = runs.run_records(kept, configs, verdicts, part_rows=2)
    shuffles = [x for x in parts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    # The lists are not moved to their run's other parts.
    assert any("hashpartitioning(run_id" in x and "part" in x for x in shuffles)
    got = sorted(parts.collect(), key=lambda r: (r.run_id, r.part))
    assert [(r.run_id, r.part, len(r.tool_history)) for r in got] == [(1, 0, 1), (1, 1, 2), (2, 0, 0)]
    for name in ("tool_history", "observations", "artifacts", "errors"):
        assert [x for r in got[:2] for x in r[name]] == one[name]

    audit.dump_run_state(runs.run_records(kept, configs, verdicts), f"{tmp_path}/dump")
    lines = {json.loads(r.value)["run_id"]: json.loads(r.value) for r in spark.read.text(f"{tmp_path}/dump").collect()}
    assert lines[1]["source_config"] == {"source_id": "s"} and lines[1]["tool_history"][0]["arguments"] == {"path": "p"}
    assert lines[2]["source_config"] is None and lines[2]["validation_results"] == []
    back = audit.read_run_state(spark, f"{tmp_path}/dump", parts.schema)
    assert {r.run_id: r.tool_history for r in back.collect()} == {k: r.tool_history for k, r in whole.items()}
