"""Source definitions: YAML (and so JSON) texts to one JSON column."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from harvestlens.functions.staging import pinned

_PARSED = StructType([StructField("cfg_json", StringType()), StructField("parse_error", StringType())])


@F.pandas_udf(_PARSED)
def _yaml_to_json(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    def convert(text: str | None) -> tuple[str | None, str | None]:
        try:
            return json.dumps(yaml.safe_load(text or ""), default=str, ensure_ascii=False), None
        except (yaml.YAMLError, ValueError, TypeError, RecursionError) as exc:
            return None, f"Invalid YAML: {exc}"

    for batch in texts:
        yield pd.DataFrame([convert(t) for t in batch], columns=["cfg_json", "parse_error"])


def parse_source_configs(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add ``cfg_json`` and ``parse_error`` (text that is no YAML, or no mapping)."""
    parsed = pinned(texts, _parsed=_yaml_to_json(F.col(text)))
    body = F.col("_parsed.cfg_json")
    mapping = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    return (
        parsed.withColumn("cfg_json", body)
        .withColumn(
            "parse_error",
            F.coalesce(
                F.col("_parsed.parse_error"),
                F.when(~mapping, "Source configuration must be a mapping"),
            ),
        )
        .drop("_parsed")
    )


def scan_source_configs(spark: SparkSession, path: str, glob: str = "*.{yaml,yml,json}") -> DataFrame:
    """Every config file below ``path``: config_path, text, cfg_json, parse_error."""
    files = (
        spark.read.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("config_path"), F.col("value").alias("text"))
    )
    return parse_source_configs(files)
