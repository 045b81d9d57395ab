"""Sharding by histogram sort: shards of near-equal bytes from one exchange.

Rows are ordered by (hash of the text, doc_id), so that copies of a text stay
together and only a group that lies across a shard's end is cut. The ends are found
without sorting: every round counts the exact bytes below candidate keys on all
partitions, and the next round's candidates lie between the two that enclose each
target, until the bytes below a candidate meet the target within the tolerance or
no key lies between. Where the enclosing candidates are neighbours, one text holds
the target (a group of copies), and the search goes on among that text's doc_ids.
The driver sees the counts of a fixed number of candidates only.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import mapped, saved

#: Candidates between the enclosing keys of each end, per round.
PROBES = 256
#: Allowed distance from a target, as a share of a shard's bytes.
TOLERANCE = 1e-4
#: Rows that are numbered together, about.
SLICE_ROWS = 50_000

LOW, HIGH = -(2**63), 2**63 - 1


def size(text: Column) -> Column:
    """UTF-8 bytes and one for the separator; NULL has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with _h (hash of the text), _d (doc_id; NULL as the least number) and _size."""
    return (
        docs.withColumn("_h", F.xxhash64("text"))
        .withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)))
        .withColumn("_size", size(F.col("text")))
    )


def below(keys: DataFrame, column: str, probes: list[int]) -> list[int]:
    """Exact bytes of the rows whose key is less than each of the sorted candidates."""
    candidates = np.array(probes, np.int64)

    def count(rows: dict) -> dict:
        at = np.searchsorted(candidates, rows[column].to_numpy(), side="right")
        got = np.bincount(at, rows["_size"].to_numpy(), len(candidates) + 1)
        return {"slot": np.flatnonzero(got), "bytes": got[got > 0].astype(np.int64)}

    slots = mapped(keys.select(column, "_size"), count, "slot long, bytes long").groupBy("slot")
    got = dict(slots.agg(F.sum("bytes")).collect())  # one row per candidate at most
    return np.cumsum([got.get(k, 0) for k in range(len(probes))]).tolist()


def search(keys: DataFrame, column: str, targets: list[float], slack: float) -> list[tuple[int, int]]:
    """For each target a key and the bytes below it: within ``slack``, or else the last key below which there is less."""
    bounds = [[LOW, 0, HIGH, None] for _ in targets]  # key and bytes on either side
    done: list[tuple[int, int] | None] = [None] * len(targets)
    while not all(done):
        probes = set()
        for k, (lo, _, hi, _) in enumerate(bounds):
            if done[k] is None:
                step = max(1, (hi - lo) // (PROBES + 1))
                probes.update(range(lo + step, hi, step) if step == 1 else (lo + step * i for i in range(1, PROBES + 1)))
        probes = sorted(probes)
        counts = below(keys, column, probes) if probes else []
        for k, target in enumerate(targets):
            if done[k] is not None:
                continue
            at = bisect_left(counts, target)
            options = [(probes[i], counts[i]) for i in (at - 1, at) if 0 <= i < len(probes)]
            best = min(options, key=lambda x: abs(x[1] - target), default=None)
            if best and abs(best[1] - target) <= slack:
                done[k] = best
                continue
            lo, under, hi, over = bounds[k]
            for key, count in options:
                if count < target and key > lo:
                    lo, under = key, count
                elif count >= target and key < hi:
                    hi, over = key, count
            bounds[k] = [lo, under, hi, over]
            if hi - lo <= 1:
                done[k] = (lo, under)
    return done


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The first key (_h, _d) of each shard but the first, by ever finer counts of bytes."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    slack = tolerance * total / shards
    targets = [total * k / shards for k in range(1, shards)]
    ends = []
    for target, (h, under) in zip(targets, search(keys, "_h", targets, slack), strict=True):
        if abs(under - target) <= slack:
            ends.append((h, LOW))
        else:
            # Between under and target lies one text with all its copies: go on among their numbers.
            group = keys.where(F.col("_h") == h)
            ends.append((h, search(group, "_d", [target - under], slack)[0][0]))
    return sorted(ends)


def place(ends: list[tuple[int, int]]) -> Column:
    """The shard of a row: the number of splitters at or below its key."""
    shard = F.lit(0)
    for h, d in ends:
        shard = shard + F.when((F.col("_h") > h) | ((F.col("_h") == h) & (F.col("_d") >= d)), 1).otherwise(0)
    return shard.cast("int")


def sharded(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """All rows with ``shard`` (from 0) and ``slot`` (from 0, gapless in the shard); bytes per shard near equal.

    Other columns pass; those named size, shard or slot are replaced, and names
    starting with ``_`` are the operator's own. NULL and
    empty text have size 1. Rows equal in doc_id and text are never cut apart, nor are
    the rows of one text without a doc_id. An empty table gives an empty table.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows = keyed(docs.drop("size", "shard", "slot"))
    keys = saved(rows.select("_h", "_d", "_size"), "keys")
    ends = splitters(keys, shards, tolerance)
    slices = max(1, keys.count() // (shards * SLICE_ROWS))
    # Slots are given slice by slice: the slices' sizes tell where each begins.
    cut = F.pmod(F.xxhash64("_d", "_h"), F.lit(slices)).cast("int")
    sizes = saved(
        keys.select(place(ends).alias("shard"), cut.alias("_slice")).groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n")),
        "slices",
    )
    first = sizes.select(
        F.col("shard").alias("_shard"), F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_n").over(
            Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)).alias("_first"),
    )
    order = Window.partitionBy("shard", "_slice").orderBy("_h", "_d")
    laid = rows.withColumn("shard", place(ends)).withColumn("_slice", cut).withColumn("_row", F.row_number().over(order))
    return (
        laid.join(first, (F.col("shard") == F.col("_shard")) & (F.col("_slice") == F.col("_of")))
        .withColumn("slot", F.col("_first") + F.col("_row") - 1)
        .drop("_shard", "_of", "_first", "_row", "_slice", "_h", "_d")
        .withColumnRenamed("_size", "size")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write one folder per shard."""
    sharded(docs, shards).write.partitionBy("shard").parquet(path)
