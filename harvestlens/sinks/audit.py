"""JSON sinks: audit lines and run states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AUDIT_SCHEMA = (
    "timestamp string, source_id string, step bigint, tool_name string, arguments string, "
    "success boolean, error string, duration_seconds double"
)


def audit_lines(records: DataFrame) -> DataFrame:
    """The audit columns in order, JSON argument text as a nested value."""
    names = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
    if dict(records.dtypes)["arguments"] == "string":
        records = records.withColumn("arguments", F.try_parse_json("arguments"))
    return records.select(*names)


def append_audit(records: DataFrame, path: str) -> None:
    """Append one JSON line per executed call; NULL members are written out."""
    audit_lines(records).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit lines back as a table; arguments as JSON text."""
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def _parsed(row: Column, texts: tuple[str, ...]) -> Column:
    for text in texts:
        row = row.withField(text, F.try_parse_json(row[text]))
    return row


def _nested(states: DataFrame) -> DataFrame:
    """JSON texts within run records as nested values, the keys of an object sorted; a text that is no JSON is NULL."""
    nested = {}
    if "source_config" in states.columns:
        nested["source_config"] = F.try_parse_json("source_config")
    if "tool_history" in states.columns:
        nested["tool_history"] = F.transform("tool_history", lambda call: _parsed(call, ("arguments", "result")))
    if "validation_results" in states.columns:
        nested["validation_results"] = F.transform("validation_results", lambda row: _parsed(row, ("detail_json",)))
    return states.withColumns(nested) if nested else states


def dump_run_state(states: DataFrame, path: str) -> None:
    """Write each run state or run record as one line of JSON; NULL members are written out."""
    _nested(states).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    ).write.mode("append").text(path)


def read_run_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Dumped states back as a table of the schema they had; nested JSON as text."""
    return spark.read.text(path).select(F.from_json("value", schema).alias("s")).select("s.*")
