"""Prompt messages per run: instructions, then configuration, tools, calls and observations as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.operators.ordering import gathered
from harvestlens.operators.runs import EXECUTED, call_fields, observation_text

INSTRUCTIONS = (
    "You pick the next step of a data extraction run. Answer with one JSON object of the form "
    '{"action": "<tool name>", "arguments": {...}} and nothing else: no reasoning tags, no markdown, no prose. '
    "Use only the listed tools and their declared arguments, and plain URLs. "
    'When the work is done, answer {"action": "finish", "arguments": {"reason": "<why>"}}.'
)
CLOSING = "Answer with exactly one JSON action."


def tool_list(catalog: DataFrame) -> DataFrame:
    """One row, one column: the enabled tools as JSON, ordered by name."""
    tool = F.struct("name", "category", "description", F.col("contract").alias("arguments"))
    tools = F.transform(F.array_sort(F.collect_list(F.struct("name", tool.alias("tool")))), lambda t: t["tool"])
    return catalog.filter("enabled").agg(F.to_json(tools, {"ignoreNullFields": "false"}).alias("tools"))


def _json_list(items: Column) -> Column:
    present = F.filter(items, lambda item: item.isNotNull())
    return F.concat(F.lit("["), F.coalesce(F.array_join(present, ","), F.lit("")), F.lit("]"))


def build_prompts(
    runs: DataFrame, kept: DataFrame, configs: DataFrame, catalog: DataFrame, part_rows: int = 1_000
) -> DataFrame:
    """Rows (run_id, part, role, content): a system and a user message per run.

    ``runs`` lists the run_ids, ``configs`` holds (run_id, cfg_json). A run with
    more than ``part_rows`` turns goes on in further user parts that hold only
    the two history sections, so no message grows without bound in one task.
    """
    seconds = F.col("duration_seconds").cast("decimal(18,4)").alias("duration_seconds")
    record = F.to_json(
        F.struct("step", "action", "arguments", "result", seconds), {"ignoreNullFields": "false"}
    )
    # As a one-element JSON list without its brackets: a quoted JSON string.
    listed = F.to_json(F.array("observation"))
    quoted = F.substr(listed, F.lit(2), F.length(listed) - 2)
    turns = kept.select(
        "run_id",
        "step",
        *call_fields(kept),
        F.col("kind").isin(*EXECUTED).alias("executed"),
        observation_text(kept).alias("observation"),
    )
    entry = F.struct(
        F.when(F.col("executed"), record).alias("call"),
        F.when(F.col("observation").isNotNull(), quoted).alias("seen"),
    )
    history = gathered(turns, ["run_id"], "step", entry, "turns", part_rows)
    first = runs.select("run_id").distinct().withColumn("part", F.lit(0).cast("long"))
    parts = first.join(history, ["run_id", "part"], "full").join(
        configs.select("run_id", "cfg_json"), "run_id", "left"
    )
    opening = F.when(
        F.col("part") == 0,
        F.concat(
            F.lit("SOURCE CONFIGURATION:\n\n"), F.coalesce("cfg_json", F.lit("{}")),
            F.lit("\n\nAVAILABLE TOOLS:\n\n"), tool_list(catalog).scalar(), F.lit("\n\n"),
        ),
    ).otherwise("")
    user = F.concat(
        opening,
        F.lit("PREVIOUS TOOL CALLS:\n\n"), _json_list(F.col("turns.call")),
        F.lit("\n\nOBSERVATIONS FROM PREVIOUS STEPS:\n\n"), _json_list(F.col("turns.seen")),
        F.lit("\n\n" + CLOSING),
    )
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(INSTRUCTIONS).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    # The instructions are said once per run, before its first part.
    return parts.select(
        "run_id",
        "part",
        F.inline(F.when(F.col("part") == 0, messages).otherwise(F.slice(messages, 2, 1))),
    )
