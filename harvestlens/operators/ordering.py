"""Ranks within groups that stay parallel when one group holds much of the data.

A plain ``row_number()`` sorts a whole group in one task. Here a group above a
size limit is cut at quantiles of its whole order, which a sample gives; each slice
is ranked on its own, and a small table of prefix sums over slices completes the
rank. The sample decides on the cuts only: ranks are exact wherever they lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# A group is cut when it is larger than both limits. The share bounds the number of
# slices of cut groups by 2 * MAX_SHARES, whatever the size of the data, which makes
# the cuts safe to collect and both side tables safe to broadcast.
MIN_GROUP_ROWS = 1_000_000
MAX_SHARES = 10_000
# Sampled rows per slice; a slice differs from its share by a fifth or so.
SAMPLED = 50


def quantile_cuts(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], min_rows: int = MIN_GROUP_ROWS
) -> DataFrame | None:
    """Groups to cut: keys and ``_cuts``, the order values at which slices begin but the first; None if there are none.

    One pass for the number of rows, which reads no columns, and, above ``min_rows``,
    one over keys and order columns.
    """
    total = df.count()
    if total <= min_rows:
        return None
    limit = max(min_rows, -(-total // MAX_SHARES))
    fraction = min(1.0, SAMPLED / limit) if total > SAMPLED * MAX_SHARES else 1.0
    sample = df.select(*keys, F.struct(*order_by).alias("_at"))
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=1)
    group = Window.partitionBy(*keys)
    slices = F.ceil(F.col("_m") / F.lit(fraction) / limit)
    nth = lambda rank: F.floor(rank * F.col("_slices") / F.col("_m"))
    cuts = (
        sample.withColumn("_m", F.count(F.lit(1)).over(group))
        .withColumn("_slices", slices)
        .filter("_slices > 1")
        .withColumn("_rank", F.row_number().over(group.orderBy("_at")) - 1)
        .filter((F.col("_rank") > 0) & (nth(F.col("_rank")) > nth(F.col("_rank") - 1)))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))
    )
    rows = cuts.collect()  # at most 2 * MAX_SHARES cuts
    schema = StructType([*[df.schema[k] for k in keys], *cuts.schema.fields[len(keys):]])
    return df.sparkSession.createDataFrame(rows, schema) if rows else None


def slice_of(at: Column, cuts: Column) -> Column:
    """The number of cuts at or before a place, by halving; 0 without cuts."""
    steps = F.array(*[F.lit(2**k) for k in range((2 * MAX_SHARES).bit_length(), -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= F.size(cuts)) & (F.get(cuts, low + step - 1) <= at), low + step
        ).otherwise(low),
    )
    return F.when(cuts.isNull(), 0).otherwise(found).cast("int")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    rank: str = "rank",
    before: Mapping[str, Column] | None = None,
    min_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Add a 0-based ``rank`` per group and, for each ``before`` entry, whether it held on any earlier row.

    Rows without an order value come first; rows that tie in all order columns are in
    any order. ``before`` maps new column names to boolean conditions. The input is
    read more than once and must not change between reads (no random values): once for
    its number of rows and once for the ranks; if that number allows a group to be cut,
    keys and order columns are read once more for the cuts, and again to count the slices.
    """
    before = dict(before or {})
    flags = {f"_is_{name}": condition for name, condition in before.items()}
    base = df.withColumns(flags) if flags else df
    cuts = quantile_cuts(df, keys, order_by, min_rows)

    def numbered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        local = Window.partitionBy(*by).orderBy(*order_by)
        earlier = local.rowsBetween(Window.unboundedPreceding, -1)
        out = rows.withColumn("_local", F.row_number().over(local) - 1)
        for flag in flags:
            out = out.withColumn(f"{flag}_local", F.coalesce(F.max(flag).over(earlier), F.lit(False)))
        return out

    if cuts is None:
        return numbered(base, keys).select(
            *df.columns, F.col("_local").cast("long").alias(rank), *[F.col(f"_is_{name}_local").alias(name) for name in before]
        )

    hot = F.broadcast(cuts)
    at = F.struct(*[base[c] for c in order_by])
    sliced = base.join(hot, _same(base, hot, keys), "left").select(
        *[base[c] for c in base.columns], slice_of(at, F.col("_cuts")).alias("_slice"), F.col("_cuts").isNotNull().alias("_cut")
    )
    # Prefix sums over the slices of cut groups only: a few thousand rows at most.
    per_slice = (
        sliced.filter("_cut").groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_c"), *[F.max(f).alias(f"{f}_any") for f in flags])
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.broadcast(per_slice.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.max(f"{f}_any").over(earlier), F.lit(False)).alias(f"{f}_before") for f in flags],
    ))
    # Without this, an input already partitioned by the keys alone would keep a cut group in one task.
    local = numbered(sliced.repartition(*keys, "_slice"), [*keys, "_slice"])
    result = local.join(prefix, _same(local, prefix, [*keys, "_slice"]), "left")
    return result.select(
        *[local[c] for c in df.columns],
        (F.col("_local") + F.coalesce("_rows_before", F.lit(0))).cast("long").alias(rank),
        *[
            (F.col(f"_is_{name}_local") | F.coalesce(F.col(f"_is_{name}_before"), F.lit(False))).alias(name)
            for name in before
        ],
    )


def gathered(
    df: DataFrame, keys: Sequence[str], rank: str, value: Column, out: str, part_rows: int = 1_000
) -> DataFrame:
    """Ordered arrays per group: keys, ``part``, ``out``.

    A group is one array while it has at most ``part_rows`` ranks; a longer one
    continues in further parts, so that no array grows with the data. Parts in
    order, joined together, are the whole group.
    """
    return (
        df.groupBy(*keys, F.floor(F.col(rank) / part_rows).cast("long").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_r"), value.alias("_v")))).alias("_all"))
        .select(*keys, "part", F.transform("_all", lambda x: x["_v"]).alias(out))
    )
