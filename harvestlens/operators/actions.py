"""From model responses to routed actions and normalised results. Narrow projections throughout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from harvestlens.functions.staging import pinned
from harvestlens.functions.text import literal_map, round4, trim_blank
from harvestlens.functions.variants import (
    fields_of,
    is_object,
    kind_of,
    strict_pair,
    strict_value,
    truthy,
)
from harvestlens.operators.contracts import with_violations

FINISH = "finish"

# Message of each parse rule, in the order the rules apply. Fixed values.
PARSE_MESSAGES = {
    "empty": "Model returned an empty response.",
    "thinking": "Model returned thinking output. Tool-selection responses must not contain <think>.",
    "fence": "Model returned markdown instead of raw JSON.",
    "invalid_json": "Model did not return valid JSON",
    "not_object": "Action must be a JSON object.",
    "no_action": "Action object is missing 'action'.",
    "no_arguments": "Action object is missing 'arguments'.",
    "action_not_string": "'action' must be a string.",
    "arguments_not_object": "'arguments' must be an object.",
}


@F.pandas_udf(BooleanType())
def _python_reads(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether Python's own JSON reader accepts each text."""
    import json

    def reads(text: str | None) -> bool:
        try:
            json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    for batch in texts:
        yield batch.map(reads)


def parse_actions(df: DataFrame, response: str = "response", strict: str = "native") -> DataFrame:
    """Add ``action``, ``arguments`` (VARIANT), ``error_type`` and ``message``; the first failing rule wins.

    ``strict="native"`` stays in Spark's JSON reader, which differs from
    Python's only in refusing bare NaN and Infinity. ``strict="exact"`` also
    asks Python's reader.
    """
    if strict not in ("native", "exact"):
        raise ValueError("strict must be 'native' or 'exact'")
    text, payload, args = F.col("_text"), F.col("_payload"), F.col("_args")
    action_kind, args_kind = F.col("_action_kind"), F.col("_args_kind")
    unreadable = payload.isNull()
    staged = (
        df.withColumn("_text", trim_blank(F.coalesce(F.col(response), F.lit(""))))
        .withColumn("_pair", strict_pair(text))
        .withColumn("_payload", strict_value(F.col("_pair"), text))
        .withColumn("_args", F.try_variant_get(payload, "$.arguments", "variant"))
        # Each type is looked up once and then read by several rules.
        .withColumn("_kind", kind_of(payload))
        .withColumn("_action_kind", kind_of(F.try_variant_get(payload, "$.action", "variant")))
        .withColumn("_args_kind", kind_of(args))
    )
    if strict == "exact":
        staged = staged.withColumn("_read", _python_reads(text))
        unreadable = unreadable | ~F.col("_read")
    judged = pinned(
        staged,
        _payload=payload,
        _args=args,
        error_type=(
            F.when(text == "", "empty")
            .when(F.contains(text, F.lit("<think>")) | F.contains(text, F.lit("</think>")), "thinking")
            .when(text.startswith("```"), "fence")
            .when(unreadable, "invalid_json")
            .when(~F.col("_kind").startswith("OBJECT"), "not_object")
            .when(action_kind.isNull(), "no_action")
            .when(args_kind.isNull(), "no_arguments")
            .when(action_kind != "STRING", "action_not_string")
            .when(~args_kind.startswith("OBJECT"), "arguments_not_object")
        ),
    )
    fine = F.col("error_type").isNull()
    return judged.select(
        *df.columns,
        F.when(fine, F.try_variant_get(payload, "$.action", "string")).alias("action"),
        F.when(fine, args).alias("arguments"),
        "error_type",
        _parse_message(F.col("error_type")).alias("message"),
    )


def _parse_message(error_type: Column) -> Column:
    return F.element_at(literal_map(PARSE_MESSAGES), error_type)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error_type IS NULL")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error_type IS NOT NULL").drop("action", "arguments")


def route_actions(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``route`` (finish, dispatch, reject), ``error_type`` and ``message`` to parsed calls.

    Precedence: finish, unknown tool, switched off, no implementation, invalid arguments.
    """
    action = F.col("action")

    def quoted(before: str, after: str) -> Column:
        return F.concat(F.lit(before), action, F.lit(after))

    bad = F.size("violations") > 0
    first = F.col("violations")[0]
    problem = (
        F.when(action == FINISH, F.lit(None))
        .when(F.col("name").isNull(), F.struct(F.lit("ToolNotFoundError").alias("t"),
                                               quoted("Unknown tool: '", "'").alias("m")))
        .when(~F.col("enabled"), F.struct(F.lit("ToolDisabledError").alias("t"),
                                          quoted("Tool '", "' is registered but not currently enabled.").alias("m")))
        .when(~F.col("implemented"), F.struct(
            F.lit("ToolDisabledError").alias("t"),
            quoted("Tool '", "' has no implementation and cannot be executed.").alias("m")))
        .when(bad, F.struct(
            F.lit("InvalidArgumentsError").alias("t"),
            F.concat(quoted("Invalid arguments for tool '", "': "), first["violation"],
                     F.coalesce(F.concat(F.lit(" "), first["argument"]), F.lit(""))).alias("m")))
    )
    return (
        pinned(with_violations(calls.drop("error_type", "message"), catalog), _problem=problem)
        .withColumn("error_type", F.col("_problem.t"))
        .withColumn("message", F.col("_problem.m"))
        .withColumn(
            "route",
            F.when(action == FINISH, FINISH).when(F.col("error_type").isNull(), "dispatch").otherwise("reject"),
        )
        .select(*[c for c in calls.columns if c not in ("error_type", "message")], "route", "error_type", "message")
    )


def finish_results(calls: DataFrame) -> DataFrame:
    """Results of finish actions: success, action, reason ('' when none is given)."""
    members = fields_of(F.col("arguments"))
    reason = F.when(
        F.coalesce(F.map_contains_key(members, F.lit("reason")), F.lit(False)),
        F.try_variant_get("arguments", "$.reason", "string"),
    ).otherwise("")
    kept = [c for c in calls.columns if c not in ("action", "arguments", "error_type", "message", "response")]
    return calls.filter(F.col("action") == FINISH).select(
        *kept, F.lit(True).alias("success"), "action", reason.alias("reason")
    )


def tool_error_results(failures: DataFrame) -> DataFrame:
    """Structured results of failed calls.

    Input: exception_class, error_type, message, recoverable, duration. A
    declared failure (``ToolExecutionError``) keeps its own type and
    recoverability, any other exception reports its class and may be retried.
    """
    declared = F.col("exception_class") == "ToolExecutionError"
    kept = [
        c for c in failures.columns
        if c not in ("exception_class", "error_type", "message", "recoverable", "duration")
    ]
    return failures.select(
        *kept,
        F.lit(False).alias("success"),
        F.when(declared, F.coalesce("error_type", F.lit("ToolExecutionError")))
        .otherwise(F.col("exception_class")).alias("error_type"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.when(declared, F.coalesce("recoverable", F.lit(True))).otherwise(True).alias("recoverable"),
        round4(F.col("duration")).alias("duration_seconds"),
    )


def normalize_results(df: DataFrame, result: str = "result_json", duration: str = "duration") -> DataFrame:
    """Unpack JSON tool results: success (true when the key is absent), message, file_path, duration, payload.

    A result that is no object is wrapped: it succeeded and ``payload`` is the bare value.
    A missing or unreadable result is a failure of type ``UnreadableResult`` without payload.
    """
    text = F.col(result)
    payload = F.col("payload")
    read = df.withColumn("_pair", strict_pair(text))
    return (
        pinned(read, payload=strict_value(F.col("_pair"), text))
        .withColumn("wrapped", payload.isNotNull() & ~F.coalesce(is_object(payload), F.lit(False)))
        .withColumn(
            "success",
            F.when(payload.isNull(), False).when(F.col("wrapped"), True).otherwise(
                F.coalesce(truthy(F.try_variant_get(payload, "$.success", "variant")), F.lit(True))
            ),
        )
        .withColumn(
            "error_type",
            F.when(payload.isNull(), "UnreadableResult").otherwise(F.try_variant_get(payload, "$.error_type", "string")),
        )
        .withColumn("message", F.try_variant_get(payload, "$.message", "string"))
        .withColumn("recoverable", F.try_variant_get(payload, "$.recoverable", "boolean"))
        .withColumn("file_path", F.try_variant_get(payload, "$.file_path", "string"))
        .withColumn("duration_seconds", round4(F.col(duration)))
        .drop("_pair", result, duration)
    )
