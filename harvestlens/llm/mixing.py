"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key whose rate is its quality weight (the key is
a hash, so that reruns agree). Sorted by key, the first documents of a source are an
Efraimidis-Spirakis sample: heavier ones tend to come first. A source whose budget
exceeds its size is taken whole that often (epochs); what is left of the budget is
filled in key order up to the document that brings the sum nearest to it.

The order within a source is made by ranges of the key: sums per range tell what lies
before each, and rows are sorted within their range only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import numbered, saved

#: No source, and so no document, is taken more often.
MOST_EPOCHS = 3
#: Rows sorted together, about.
RANGE_ROWS = 20_000


def measured(docs: DataFrame, *others: Column) -> DataFrame:
    """doc_id, source, th, the other columns, size (words), weight and key.

    The weight is the share of letters, digits, marks of sentences and blanks in the text.
    """
    odd = bytes(b for b in range(33, 127) if not (chr(b).isalnum() or chr(b) in ".,;:?'\"-()"))

    @F.arrow_udf("size long, weight double")
    def weighed(texts: pa.Array) -> pa.Array:
        size, weight = [], []
        for text in texts:
            text = text.as_py() or b""
            size.append(len(text.split()))
            weight.append(max(0.05, len(text.translate(None, odd)) / len(text)) if text else 1.0)
        return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(weight, pa.float64())], ["size", "weight"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("th"),
        *others, weighed(F.col("text").cast("binary")).alias("_measure"),
    )
    unit = (F.pmod(F.xxhash64("doc_id", "th", F.lit("mix")), F.lit(2**52)).cast("double") + 0.5) / 2.0**52
    rows = rows.select(*[c for c in rows.columns if c != "_measure"], "_measure.size", "_measure.weight")
    return rows.withColumn("key", -F.log(unit) / F.col("weight"))


def targets(sizes: DataFrame, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, share weight -> target: total words by weight, none above ``most`` times its size.

    The level L with the sum of least(most * size, L * weight) equal to the total is
    found in rounds; each gives the excess of the sources at their limit to the rest.
    The driver sees three sums per round.
    """
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("share")
        taken, rest = sizes.agg(
            F.sum(F.when(full, F.col("source_size") * most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("share")))
        ).first()
        following = (total - taken) / rest if rest else level
        if following <= level:
            break
        level = following
    return sizes.withColumn("target", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("share")))


def mixed(
    docs: DataFrame, shares: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS, number: str | None = None
) -> DataFrame:
    """doc_id, source, th, number, size, source_size, target, copies, taken of every row.

    Sources in code-point order (NULL last) get the shares in turn. ``copies`` says how
    often a document goes into the mix, ``taken`` how many words that is. Documents
    without words fall where their key does. Rows equal in doc_id and text have equal
    keys; which of them is taken once more is arbitrary, how many are is not, unless ``number`` names a column that numbers the rows. An empty table gives an empty table.
    """
    rows = saved(measured(docs, (F.col(number) if number else F.lit(0)).cast("long").alias("number")), "measured")
    return chosen(rows, shares, most).select(
        "doc_id", "source", "th", "number", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def chosen(rows: DataFrame, shares: tuple[int, ...], most: int) -> DataFrame:
    """Measured rows with their source's source_size, target and epochs, and their own copies: epochs or one more.

    In the order of key, doc_id, th and number, those of a source with one more come first.
    """
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "sizes")
    order = numbered(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_at")
    share = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.pmod("_at", F.lit(len(shares))).cast("int"))
    plan = saved(
        targets(order.withColumn("share", share), most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("_rows") / RANGE_ROWS)))
        .select(F.col("source").alias("of"), "source_size", "target", "epochs", "left", "ranges"),
        "plan",
    )
    # 1 - exp(-key) rises with the key and is spread over 0 to 1: equal ranges of it cut the order.
    placed = rows.join(plan, rows.source.eqNullSafe(plan.of)).drop("of").withColumn(
        "range", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")), F.col("ranges") - 1).cast("long")
    )
    sums = saved(placed.groupBy("source", "range").agg(F.sum("size").alias("_sum")), "sums").select(
        F.col("source").alias("of"), F.col("range").alias("at"),
        F.coalesce(F.sum("_sum").over(
            Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "th", "number").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_to", F.sum("size").over(inside)).join(
        sums, placed.source.eqNullSafe(sums.of) & (placed.range == sums.at)
    )
    # A document is taken once more if its middle lies within what is left of the budget.
    middle = F.col("before") + F.col("_to") - F.col("size") / 2
    copies = F.col("epochs") + F.when((F.col("epochs") < most) & (middle <= F.col("left")) & (F.col("left") > 0), 1).otherwise(0)
    return filled.select(
        "doc_id", "source", "th", "number", "key", "size", "source_size", "target", "epochs", copies.cast("int").alias("copies")
    )


def mix(docs: DataFrame, shares: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """The documents in the mix, each row as often as it is taken, with all their columns, whatever their names."""
    # A written number names a row for sure: rows may be equal, and doc_id may be missing or repeated.
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = saved(measured(docs, F.monotonically_increasing_id().alias("number"), row), "rows")
    place = F.struct("key", "doc_id", "th", "number")
    found = chosen(rows.drop("row"), shares, most)
    # Where a source's order is cut says it all, so that no text is moved.
    cuts = saved(
        found.groupBy(F.col("source").alias("of")).agg(
            F.max("epochs").alias("epochs"), F.max(F.when(F.col("copies") > F.col("epochs"), place)).alias("last")
        ),
        "cuts",
    )
    once_more = F.when(place <= F.col("last"), 1).otherwise(0)
    taken = rows.join(cuts, rows.source.eqNullSafe(cuts.of)).select("row", (F.col("epochs") + once_more).alias("copies"))
    again = taken.where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")).alias("again"))
    return again.select(*[F.col("row")[c].alias(c) for c in docs.columns])
