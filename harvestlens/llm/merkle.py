"""Merkle manifest of a table: a tree of hashes per group, a tree over the groups' roots, a proof for every row.

A tree is a list of leaves. Every two consecutive nodes of a level become one of the
next, the hash of both; a single node at the end becomes its own hash. One node is left.

Trees are built in blocks of 4 096 nodes: a task reduces a block by twelve levels, and
its top is a leaf of the next round. Proofs are octopus multiproofs: every block of
leaves works out the coordinates of the nodes that the leaves it holds do not give, the
least union over all of them; one join fetches these; what is shared is derived once,
and each leaf's own proof is expanded in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import saved

#: Levels that one task reduces; a block has 2 ** LEVELS nodes.
LEVELS = 12
#: Name of the tree over the groups' roots. Names of groups are empty or begin with ``=``.
TOP = "top"
EMPTY_ROOT = sha256(b"").hexdigest()


def digest(nodes: Iterable[str]) -> str:
    """Lower-case hex SHA-256 of hex digests, joined."""
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return (n - 1).bit_length() if n > 0 else 0


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Hash of the fields of a row."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos``, the place from 0 in the row's ``tree`` by ``order`` (NULL first; rows that tie in any order).

    Rows are range-partitioned, so that a tree which holds most rows is spread too. What
    is gathered per tree is one row per partition.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    # A written row number splits equal rows between ranges.
    rows = saved(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ranged = saved(
        rows.repartitionByRange(F.col("tree"), *by, F.col("tie")).withColumn("part", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("tree", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*by, "tie"))
    numbered = ranged.withColumn("inside", inside).join(before, ["tree", "part"])
    return numbered.withColumn("pos", F.col("before") + F.col("inside") - 1).drop("part", "before", "inside", "tie")


def block_nodes(hashes: list[str], first: int, base: int) -> list[tuple[int, int, str]]:
    """(level, index, hash) of the nodes above a block of consecutive nodes of level ``base``.

    A block that is not full is a whole tree if it is the first one, else the end of a larger tree.
    """
    whole = first == 0 and len(hashes) < 2**LEVELS
    out, now = [], hashes
    for up in range(1, (height(len(hashes)) if whole else LEVELS) + 1):
        now = [digest(now[k : k + 2]) for k in range(0, len(now), 2)]
        out += [(base + up, (first >> up) + k, node) for k, node in enumerate(now)]
    return out


def forest(leaves: DataFrame, most: int) -> DataFrame:
    """(tree, pos, hash) -> (tree, level, idx, hash) of all nodes above the leaves; no tree has more than ``most`` leaves."""
    schema = "tree string, level int, idx long, hash string"

    def above(base: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def made(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("idx")
            nodes = block_nodes(group["hash"].tolist(), int(group["idx"].iloc[0]), base)
            out = pd.DataFrame(nodes, columns=["level", "idx", "hash"])
            out.insert(0, "tree", group["tree"].iloc[0])
            return out

        return made

    now = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash")
    rounds = []
    for base in range(0, max(1, height(most)), LEVELS):
        rounds.append(saved(now.groupBy("tree", F.expr(f"idx div {2**LEVELS}")).applyInPandas(above(base), schema), "nodes"))
        now = rounds[-1].where(F.col("level") == base + LEVELS)
    return reduce(DataFrame.union, rounds)


def roots(leaves: DataFrame, sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, n) -> (tree, n, root)."""
    lone = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash")
    levels = F.when(F.col("n") == 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    firsts = lone.union(nodes).where("idx = 0").withColumnRenamed("hash", "root")
    return sizes.withColumn("level", levels).join(firsts, ["tree", "level"]).select("tree", "n", "root")


@dataclass
class Manifest:
    """``leaves``: tree, pos, hash, kept. ``trees``: tree, n, root, at (its place in the top tree). ``nodes``: those of all trees."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    groups: int
    root: str


def group_name(group: Column) -> Column:
    """Name of a group's tree: NULL before all values, these in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, kept: dict[str, Column]) -> Manifest:
    """Trees over all rows: one per ``group``, leaves ascending by ``order``, then by their hash; NULL first.

    ``kept`` are the columns that proofs carry along. Equal rows are leaves of their own.
    No rows: no trees, and the root is the hash of nothing.
    """
    leaves = rows.select(
        group_name(group).alias("tree"), order.alias("by"), leaf.alias("hash"),
        F.struct(*[c.alias(name) for name, c in kept.items()]).alias("kept"),
    )
    leaves = saved(placed(leaves, ["by", "hash"]).drop("by"), "placed")
    sizes = saved(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    most, groups = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    nodes = forest(leaves, most)
    found = saved(roots(leaves, sizes, nodes), "roots")
    top = saved(
        placed(found.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("root").alias("hash")), ["of"]), "top"
    )
    above = forest(top, groups)
    one = roots(top, top.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), above).first()
    trees = saved(found.join(top.select(F.col("of").alias("tree"), F.col("pos").alias("at")), "tree"), "trees")
    ends = top.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash")
    return Manifest(leaves, trees, nodes.union(ends).union(above), groups, one["root"] if one else EMPTY_ROOT)


def missing(held: Iterable[int], n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) of the nodes that prove the held leaves of a tree of n and do not follow from them."""
    known, out = set(held), []
    for level in range(height(n)):
        width = (n - 1 >> level) + 1
        out += [(level, k ^ 1) for k in sorted(known) if k ^ 1 not in known and k ^ 1 < width]
        known = {k >> 1 for k in known}
    return out


def completed(held: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """Per level all nodes that the held leaves' proofs need: fetched ones and those derived, each once."""
    levels = [dict(held)]
    for level in range(height(n)):
        now = levels[-1]
        parents = {k >> 1 for k in now}
        now.update({k: node for (at, k), node in fetched.items() if at == level})
        levels.append({k: digest(now[c] for c in (2 * k, 2 * k + 1) if c in now) for k in parents})
    return levels


def siblings(k: int, levels: list[dict[int, str]]) -> list[str | None]:
    """The other node of each run on the way up from leaf k; None where a run has one node."""
    return [nodes.get(k >> level ^ 1) for level, nodes in enumerate(levels[:-1])]


PROOFS = "tree string, pos long, hash string, kept {kept}, subroot string, path long, siblings array<string>"


def proofs(m: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """tree, pos, hash, kept, subroot, root, path, siblings of each leaf, or of the ``wanted`` (tree, pos).

    ``siblings`` lists the other node per level, of the group's tree and then of the tree
    above, NULL where a run has one node; bit k of ``path`` says whether the proved node
    is the second of its run at step k. No coordinate is fetched twice by a block.
    """
    leaves = m.leaves if wanted is None else m.leaves.join(wanted.select("tree", "pos").distinct(), ["tree", "pos"])
    leaves = leaves.withColumn("block", F.expr(f"pos div {2**LEVELS}"))
    groups = m.groups
    blocks = leaves.groupBy("tree", "block").agg(F.collect_list("pos").alias("held")).join(m.trees, "tree")

    @F.udf("array<struct<own boolean, level int, idx long>>", useArrow=False)
    def coordinates(held: list[int], n: int, at: int) -> list[tuple[bool, int, int]]:
        return [(True, *c) for c in missing(held, n)] + [(False, *c) for c in missing([at], groups)]

    blocks = saved(blocks.withColumn("need", coordinates("held", "n", "at")).drop("held"), "blocks")
    needed = blocks.select(F.col("tree").alias("of"), "block", F.inline("need")).withColumn(
        "tree", F.when(F.col("own"), F.col("of")).otherwise(F.lit(TOP))
    )
    least = needed.where("own").agg(F.min("level")).first()[0]
    pool = m.nodes if least is None else m.nodes.where((F.col("level") >= least) | (F.col("tree") == TOP))
    if least == 0:
        pool = pool.union(m.leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "hash"))
    if least is None:
        pool = pool.where(F.col("tree") == TOP)
    fetched = needed.join(pool, ["tree", "level", "idx"]).groupBy(F.col("of").alias("tree"), "block").agg(
        F.collect_list(F.struct("own", "level", "idx", "hash")).alias("nodes")
    )
    parts = blocks.drop("need").join(fetched, ["tree", "block"], "left")

    def expanded(held: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        info = part.iloc[0]
        nodes = info["nodes"] if info["nodes"] is not None else []
        own = {(x["level"], x["idx"]): x["hash"] for x in nodes if x["own"]}
        above = {(x["level"], x["idx"]): x["hash"] for x in nodes if not x["own"]}
        levels = completed(dict(zip(held["pos"].tolist(), held["hash"], strict=True)), own, int(info["n"]))
        top = completed({int(info["at"]): info["root"]}, above, groups)
        if levels[-1].get(0) != info["root"]:
            raise ValueError(f"leaves of tree {info['tree']!r} do not give its root")
        shared = siblings(int(info["at"]), top)
        path = int(info["at"]) << height(int(info["n"]))
        out = held[["tree", "pos", "hash", "kept"]].copy()
        out["subroot"] = info["root"]
        out["path"] = out["pos"] | path
        out["siblings"] = [siblings(k, levels) + shared for k in held["pos"].tolist()]
        return out

    schema = PROOFS.format(kept=m.leaves.schema["kept"].dataType.simpleString())
    both = leaves.groupBy("tree", "block").cogroup(parts.groupBy("tree", "block"))
    return both.applyInPandas(expanded, schema).withColumn("root", F.lit(m.root))


def folded(leaf: Column, path: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof give."""
    steps = F.transform(
        siblings,
        lambda node, k: F.struct(
            node.alias("node"), (F.call_function("shiftright", path, k).bitwiseAND(F.lit(1)) == 1).alias("second")
        ),
    )
    joined = lambda now, step: F.when(step["node"].isNull(), now).when(
        step["second"], F.concat(step["node"], now)
    ).otherwise(F.concat(now, step["node"]))
    return F.aggregate(steps, leaf, lambda now, step: F.sha2(joined(now, step).cast("binary"), 256))


def proof_hash(siblings: Column) -> Column:
    """Hash of the siblings that there are, from the leaf to the root."""
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)
