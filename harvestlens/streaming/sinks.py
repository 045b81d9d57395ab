"""Running a stream over everything that has arrived, with restartable file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from harvestlens.sinks.audit import audit_lines


def read_table_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """Stream the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_audit(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append audit lines as they arrive; a restart from the checkpoint writes nothing twice."""
    return (
        audit_lines(records)
        .writeStream.format("json")
        .option("ignoreNullFields", "false")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append state updates to a parquet folder, exactly once."""
    return (
        updates.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
