"""Run histories: fold ordered turns of many runs at once.

A turn is a row with ``run_id``, order columns, ``kind`` (model_failure,
parse_error, action_error, call, finish), ``success`` and ``max_steps``, and
optionally ``action``, ``arguments``, ``result``, ``message``, ``error_type``,
``reason``, ``file_path``, ``duration_seconds``, ``timestamp``, ``source_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.text import round4
from harvestlens.operators.actions import FINISH
from harvestlens.operators.ordering import MIN_GROUP_ROWS, gathered, ranked

TERMINAL = ("finish", "model_failure")
EXECUTED = ("call", "finish")
DEFAULT_MAX_STEPS = 20


def step_limit(max_steps: Column) -> Column:
    """Turns a run may take; the limit is tested after a turn, so there is always one."""
    return F.greatest(F.coalesce(max_steps, F.lit(DEFAULT_MAX_STEPS)), F.lit(1))


def kept_turns(
    turns: DataFrame,
    order_by: Sequence[str] = ("turn_seq",),
    min_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Turns that took effect, with their 0-based ``step``: below the limit and not after a terminal one."""
    stepped = ranked(
        turns,
        ["run_id"],
        order_by,
        rank="step",
        before={"ended": F.col("kind").isin(*TERMINAL)},
        min_rows=min_rows,
    )
    return stepped.filter(~F.col("ended") & (F.col("step") < step_limit(F.col("max_steps")))).drop("ended")


def _optional(df: DataFrame, name: str, type_: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(type_)


def _failed_call() -> Column:
    return (F.col("kind") == "call") & ~F.coalesce(F.col("success"), F.lit(False))


def is_error() -> Column:
    """Turns that add an entry to the error list."""
    return F.col("kind").isin("parse_error", "action_error", "model_failure") | _failed_call()


def run_state(kept: DataFrame) -> DataFrame:
    """Final state per run: status, current_step, n_calls, n_errors, finish_reason. Map-side partial counts."""
    limit = F.col("_limit")
    reason = _optional(kept, "reason")
    message = _optional(kept, "message")
    folded = kept.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"),
        # Flags instead of a text maximum keep the aggregation hash-based.
        F.bool_or(F.col("kind") == "finish").alias("_finished"),
        F.bool_or(F.col("kind") == "model_failure").alias("_failed"),
        F.max(step_limit(F.col("max_steps"))).alias("_limit"),
        F.count_if(F.col("kind").isin(*EXECUTED)).alias("n_calls"),
        F.count_if(is_error()).alias("n_errors"),
        F.max(
            F.when(F.col("kind") == "finish", F.coalesce(reason, F.lit("")))
            .when(F.col("kind") == "model_failure", _generation_error(message))
        ).alias("finish_reason"),
    )
    return folded.select(
        "run_id",
        F.when(F.col("_finished"), "finished")
        .when(F.col("_failed"), "failed")
        .when(F.col("_n") >= limit, "max_steps_reached")
        .otherwise("running")
        .alias("status"),
        # The turn that ends a run does not advance it.
        F.when(F.col("_finished") | F.col("_failed"), F.col("_n") - 1).otherwise(F.col("_n")).alias("current_step"),
        "n_calls",
        "n_errors",
        "finish_reason",
    )


def _generation_error(message: Column) -> Column:
    return F.concat(F.lit("Model generation error: "), F.coalesce(message, F.lit("unknown error")))


def error_text(kept: DataFrame) -> Column:
    """Error entry of a turn, NULL when it adds none. The formats are fixed values."""
    message = F.coalesce(_optional(kept, "message"), F.lit("unknown error"))
    error_type = F.coalesce(_optional(kept, "error_type"), F.lit("InvalidArgumentsError"))
    action = F.coalesce(_optional(kept, "action"), F.lit(""))
    return (
        F.when(F.col("kind") == "parse_error", F.concat(F.lit("PARSE_ERROR: "), message))
        .when(F.col("kind") == "action_error", F.concat(F.lit("ACTION_ERROR ("), error_type, F.lit("): "), message))
        .when(F.col("kind") == "model_failure", _generation_error(_optional(kept, "message")))
        .when(_failed_call(), F.concat(F.lit("step="), F.col("step").cast("string"), F.lit(" action="), action,
                                       F.lit(": "), message))
    )


def run_errors(kept: DataFrame) -> DataFrame:
    """Rows (run_id, step, error)."""
    return kept.select("run_id", "step", error_text(kept).alias("error")).filter("error IS NOT NULL")


def run_artifacts(kept: DataFrame) -> DataFrame:
    """Rows (run_id, step, file_path) of successful calls that produced a file."""
    return kept.filter(
        (F.col("kind") == "call") & F.col("success") & (F.coalesce(F.col("file_path"), F.lit("")) != "")
    ).select("run_id", "step", "file_path")


def observation_text(kept: DataFrame) -> Column:
    """Observation of a turn, NULL when it leaves none. The formats are fixed values."""
    executed = F.concat(
        F.lit("step="), F.col("step").cast("string"), F.lit(" action="), _action_name(kept),
        F.lit(" result="), F.coalesce(_optional(kept, "result"), F.lit("null")),
    )
    return F.when(F.col("kind").isin(*EXECUTED), executed).when(
        F.col("kind") != "model_failure", error_text(kept)
    )


def run_observations(kept: DataFrame) -> DataFrame:
    """Rows (run_id, step, observation): the error text of a failed turn, else step, action and result as JSON.

    A failed generation leaves no observation.
    """
    return kept.select("run_id", "step", observation_text(kept).alias("observation")).filter(
        "observation IS NOT NULL"
    )


def _action_name(kept: DataFrame) -> Column:
    return F.when(F.col("kind") == "finish", FINISH).otherwise(F.coalesce(_optional(kept, "action"), F.lit("")))


def _seconds(kept: DataFrame) -> Column:
    # A finish turn is not timed.
    return F.when(F.col("kind") == "finish", 0.0).otherwise(
        F.coalesce(_optional(kept, "duration_seconds", "double"), F.lit(0.0))
    )


def call_fields(kept: DataFrame) -> list[Column]:
    """What is recorded of an executed call besides run and step."""
    return [
        _action_name(kept).alias("action"),
        _optional(kept, "arguments").alias("arguments"),
        _optional(kept, "result").alias("result"),
        _seconds(kept).alias("duration_seconds"),
        _optional(kept, "timestamp").alias("timestamp"),
    ]


def call_records(kept: DataFrame) -> DataFrame:
    """Rows (run_id, step, action, arguments, result, duration_seconds, timestamp) of executed calls."""
    return kept.filter(F.col("kind").isin(*EXECUTED)).select("run_id", "step", *call_fields(kept))


def run_history(kept: DataFrame, part_rows: int = 1_000) -> DataFrame:
    """Ordered call history per run as arrays of records; a very long run continues in further parts."""
    record = F.struct("step", "action", "arguments", "result", "duration_seconds", "timestamp")
    return gathered(call_records(kept), ["run_id"], "step", record, "history", part_rows)


def run_records(
    kept: DataFrame,
    configs: DataFrame | None = None,
    validation: DataFrame | None = None,
    part_rows: int = 1_000,
) -> DataFrame:
    """The whole record of a run: state, tool history, observations, artifacts, errors, checks.

    ``configs`` is (run_id, source_config as JSON text), ``validation`` the verdicts
    (run_id, check, passed, detail_json); a run without them has NULL and no results.
    A run of more than ``part_rows`` turns continues in further parts, which repeat what is
    one value per run. Lists are gathered by (run_id, part) and stay where they are: the
    narrow states are spread over their runs' parts and joined to them.
    """
    call = F.when(F.col("kind").isin(*EXECUTED), F.struct("step", *call_fields(kept)))
    artifact = F.when(
        (F.col("kind") == "call") & F.col("success") & (_optional(kept, "file_path") != ""), _optional(kept, "file_path")
    )
    turn = F.struct(
        "step", call.alias("call"), observation_text(kept).alias("observation"), artifact.alias("artifact"),
        error_text(kept).alias("error"),
    )
    part = F.floor(F.col("step") / part_rows).cast("long")
    lists = kept.groupBy("run_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))

    def all_of(name: str) -> Column:
        return F.transform(F.filter("_turns", lambda t: t[name].isNotNull()), lambda t: t[name])

    limits = kept.groupBy("run_id").agg(F.max(F.coalesce("max_steps", F.lit(DEFAULT_MAX_STEPS))).cast("long").alias("max_steps"))
    states = run_state(kept).join(limits, "run_id")
    if configs is not None:
        states = states.join(configs.select("run_id", "source_config"), "run_id", "left")
    else:
        states = states.withColumn("source_config", F.lit(None).cast("string"))
    verdict = "struct<check:string,passed:boolean,detail_json:string>"
    if validation is not None:
        results = validation.groupBy("run_id").agg(
            F.array_sort(F.collect_list(F.struct("check", "passed", "detail_json"))).alias("_results")
        )
        states = states.join(results, "run_id", "left")
    else:
        states = states.withColumn("_results", F.lit(None).cast(f"array<{verdict}>"))
    turns = F.col("current_step") + F.col("status").isin("finished", "failed").cast("int")
    last = F.floor((turns - 1) / part_rows).cast("long")
    spread = states.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return lists.join(spread, ["run_id", "part"]).select(
        "run_id",
        "part",
        "source_config",
        "max_steps",
        "current_step",
        "status",
        all_of("call").alias("tool_history"),
        all_of("observation").alias("observations"),
        all_of("artifact").alias("artifacts"),
        all_of("error").alias("errors"),
        F.coalesce("_results", F.array().cast(f"array<{verdict}>")).alias("validation_results"),
        "finish_reason",
        "n_calls",
        "n_errors",
    )


def audit_records(kept: DataFrame) -> DataFrame:
    """The eight audit columns of every executed call, finish included."""
    failed = _failed_call()
    return kept.filter(F.col("kind").isin(*EXECUTED)).select(
        _optional(kept, "timestamp").alias("timestamp"),
        F.coalesce(_optional(kept, "source_id"), F.lit("unknown_source")).alias("source_id"),
        "step",
        _action_name(kept).alias("tool_name"),
        _optional(kept, "arguments").alias("arguments"),
        (~failed).alias("success"),
        F.when(failed, _optional(kept, "message")).alias("error"),
        round4(_seconds(kept)).alias("duration_seconds"),
    )
