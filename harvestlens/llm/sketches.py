"""Document fingerprints: the shingle hashes below a fixed fraction of the hash range.

The sketch of a text is the sorted set of the 64-bit hashes of its word shingles
(five lower-case words; a shorter text is one shingle) that lie below ``1 / scale``
of the hash range, and its smallest hash, so that no text with a word is without a
sketch. Sketches merge by union (of the hashes above the limit only the smallest
stays), and intersect without a common size: the share of one text's shingles that
lie in another is estimated at any difference of length.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import saved, text_key

SHINGLE_WORDS = 5
SCALE = 8


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes kept of a text; an empty array for NULL and for texts without a word."""
    limit = -(2**63) + 2**64 // scale
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]"), lambda w: w != "")
    # One step makes word hashes, the next joins the hashes of a shingle.
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def shingled(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        joined = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) > 0, joined).otherwise(F.array().cast("array<bigint>"))

    def kept(all_hashes: Column) -> Column:
        low = F.filter(all_hashes, lambda x: x < F.lit(limit))
        least = F.when(F.size(all_hashes) > 0, F.array(F.array_min(all_hashes))).otherwise(F.array().cast("array<bigint>"))
        return F.array_sort(F.array_distinct(F.concat(low, least)))

    def once(value: Column, then) -> Column:
        """Bind a costly value, so that it is computed once however often it is used."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    return once(hashes, lambda h: once(shingled(h), kept))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts taken together."""
    limit = -(2**63) + 2**64 // scale
    both = F.array_sort(F.array_union(a, b))
    return F.concat(
        F.filter(both, lambda x: x < F.lit(limit)),
        F.when(F.get(both, F.lit(0)) >= F.lit(limit), F.slice(both, 1, 1)).otherwise(F.array().cast("array<bigint>")),
    )


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of ``part`` that ``whole`` has; two texts without words: 1, one: 0."""
    share = F.size(F.array_intersect(part, whole)) / F.size(part)
    return F.when(F.size(part) > 0, share).otherwise(F.when(F.size(whole) > 0, 0.0).otherwise(1.0))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1); two texts without words: 1."""
    inter, total = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(total > 0, inter / total).otherwise(1.0)


def as_text(hashes: Column) -> Column:
    """The fingerprint as a string: hashes in hexadecimal, comma-joined."""
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x))), ",")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Columns doc_id, sketch for every row; other columns are not read."""
    return docs.select("doc_id", sketch(F.col("text"), scale=scale).alias("sketch"))


#: Stands for a missing doc_id in keys; it sorts first, as NULL does.
NO_ID = -(2**63)


def next_rows(keys: DataFrame) -> DataFrame:
    """(id, th, n_chars) -> the same with next_id, next_th: the row that follows by id, th; the first follows the last.

    The order is cut into ranges, each a partition. Only the first row of each range
    is gathered, to tell the range before it what follows.
    """
    ranged = saved(keys.repartitionByRange("id", "th").withColumn("part", F.spark_partition_id()), "ranged")
    here = F.struct("id", "th")
    heads = ranged.groupBy("part").agg(F.min(here).alias("head"))
    everywhere = Window.orderBy("part")
    whole = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        "part", F.coalesce(F.lead("head").over(everywhere), F.first("head").over(whole)).alias("after")
    )
    inside = Window.partitionBy("part").orderBy("id", "th")
    return (
        ranged.withColumn("follows", F.lead(here).over(inside))
        .join(heads, "part")
        .withColumn("follows", F.coalesce("follows", "after"))
        .select("id", "th", "n_chars", F.col("follows.id").alias("next_id"), F.col("follows.th").alias("next_th"))
    )


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprint every text and its edited text, in which the start of the next document replaces the second half.

    The next document is that with the next larger doc_id (ties: by text hash; NULL
    first; after the last comes the first). Rows equal in doc_id and text are one
    document in that order and get equal results, one per row. NULL text counts as
    empty. A single document follows itself. Other columns are not read.

    Columns: doc_id, text, n_chars, sketch, next_sketch, edited, edited_sketch.
    """
    filled = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("th", text_key(F.col("text")))
    base = filled.select("id", "th", "text", sketch(F.col("text"), scale=scale).alias("sketch"))
    keys = filled.select("id", "th", F.char_length("text").alias("n_chars")).distinct()
    # Each row sends to the row before it what that one needs: at most half as long as that one is.
    to = saved(next_rows(keys), "next").select(
        F.col("id").alias("to_id"), F.col("th").alias("to_th"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"),
        F.col("next_id").alias("id"), F.col("next_th").alias("th"),
    )
    sent = (
        base.join(to, ["id", "th"])
        .select(
            F.col("to_id").alias("id"), F.col("to_th").alias("th"),
            F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("sketch").alias("next_sketch"),
        )
        .dropDuplicates(["id", "th"])
    )
    n = F.char_length("text")
    kept = (n - F.floor(n / 2)).cast("int")
    return (
        base.join(sent, ["id", "th"])
        .select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", n.cast("long").alias("n_chars"),
            "sketch", "next_sketch", F.concat(F.substring("text", F.lit(1), kept), "head").alias("edited"),
        )
        .withColumn("edited_sketch", sketch(F.col("edited"), scale=scale))
    )
