"""The corpus pipeline: documents become packed training sequences in five stages.

Each stage reads what the one before it wrote. All but the last return the columns of
their input; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.llm import lines, mixing, neardup, packing, quality
from harvestlens.llm.common import saved
from harvestlens.session import small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(run: Stage) -> Stage:
    """A stage whose rows travel in small batches, also when its result is written: executors keep what memory they once took."""

    @wraps(run)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, docs, sf_dir)

    return started


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs)


@stage
def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies of lines go; a document goes if no word is left of what it had."""
    done = lines.deduplicated(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\t\n\r\v\f", "     ")) == "")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


@stage
def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays."""
    return neardup.one_of_each(docs)


@stage
def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document stays as often as it is taken."""
    return mixing.mix(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("lines", unique_lines),
    ("near_duplicates", unique_documents),
    ("mix", weighted_mix),
    ("pack", packed_sequences),
]

#: No SQL: training, sampling keys and token ids cannot be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, do in STAGES:
        docs = saved(do(spark, docs, sf_dir), name)
    return docs
