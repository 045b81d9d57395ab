"""Links between items that share a key, without pairing all members of a key.

First every item is compared with one centre of each key it has, which joins groups of
near copies at a cost in proportion to their size. Then only members of a key that are
still in different components are compared, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.llm.common import components, flagged, membership, saved

#: Members of a key up to which its pairs are made one by one.
FEW = 8


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, center): the rows of keys (id, key) whose key has several ids, with the smallest of them."""
    centers = saved(
        keys.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").drop("last"),
        "centers",
    )
    # Most keys have one id: their rows stay where they are.
    bitmap = membership(centers.select("key"))
    rows = flagged(keys, F.col("key"), bitmap, "_maybe").where("_maybe")
    return saved(rows.join(centers, "key").select("key", "id", "center"), "shared")


def linked(
    items: DataFrame,
    shared: DataFrame,
    close: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame], DataFrame],
    families: Callable[[DataFrame], DataFrame] | None = None,
    enough: Callable[[Column, Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    few: int = FEW,
) -> DataFrame:
    """Edges (a, b) that connect all items which share a key, are ``close`` and pass ``verify``.

    ``items`` has id and the columns that ``close`` compares (it must not refuse a pair
    that verify accepts). ``shared`` comes from shared_keys. ``verify`` gets pairs
    (a, b) and returns those that are links. Pairs within one component are left out.

    ``families`` takes over the keys of more than ``few`` members that are still open: it
    gets (center, id, root) and returns links between the roots of a center.

    ``enough`` says whether a number of keys in common suffices for a pair; by default one does.
    """
    attributes = [c for c in items.columns if c != "id"]

    def side(letter: str) -> DataFrame:
        return items.select(F.col("id").alias(letter), *[F.col(c).alias(f"{letter}_{c}") for c in attributes])

    def of(letter: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{letter}_{name}")

    fits = close(of("a"), of("b"))
    if enough:
        fits = fits & enough(F.col("common"), of("a"), of("b"))
    stars = shared.where("id != center").select(F.col("center").alias("a"), F.col("id").alias("b"))
    stars = saved(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common")) if enough else stars.distinct(), "stars")
    near = saved(stars.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b"), "near")
    first = saved(verify(near).select("a", "b"), "links")

    roots = saved(components(first), "roots")
    members = saved(
        shared.join(roots, shared.id == roots.node, "left").select("key", "id", "center", F.coalesce("root", "id").alias("root")),
        "members",
    )
    open_keys = saved(
        members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
        .where("low < high").select("key", "n"),
        "open",
    )
    rest = members.join(open_keys, "key")
    small = rest.where(F.col("n") <= few) if families else rest
    small = saved(small.drop("n", "center").join(items, "id"), "rest")

    def half(letter: str) -> DataFrame:
        return small.select("key", *[F.col(c).alias(letter if c == "id" else f"{letter}_{c}") for c in ["id", "root", *attributes]])

    pairs = half("a").join(half("b"), "key").where(
        (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & close(of("a"), of("b"))
    )
    if enough:
        # A center may share more keys with a member than those that it is the center of: all count here.
        pairs = pairs.groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("common"), *[F.first(f"{x}_{c}").alias(f"{x}_{c}") for x in "ab" for c in attributes]
        ).where(fits)
    pairs = pairs.select("a", "b").distinct()
    done = near if enough else stars
    links = first.union(saved(verify(saved(pairs.join(done, ["a", "b"], "left_anti"), "near")).select("a", "b"), "links"))
    if families:
        many = rest.where(F.col("n") > few).select("center", "id", "root").distinct()
        links = links.union(saved(families(saved(many, "families")).select("a", "b"), "links"))
    return links
