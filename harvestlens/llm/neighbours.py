"""Approximate nearest neighbours by cross-polytope hashing.

A table turns every unit vector by a fast pseudo-rotation (three rounds of random signs
and a Hadamard transform) and hashes it to the nearest signed axis: the cells are the
corners of a cross-polytope. Every vector is indexed in one cell of each table. A query
visits, in each table, the cells of its largest signed coordinates (multiprobe), and the
vectors met there are ranked by the exact inner product of the original vectors.

The index is for vectors of one norm, where the nearest direction is the largest inner
product. If norms differ, every query is compared with every vector of its number of
components instead: the index visits TABLES * SHARE, nearly all, of the vectors per query
anyway. So are queries that meet fewer than k rows in the index.

Equal vectors are indexed once, with the numbers of the first few rows that hold them:
no more of them can be among the first k. Cells are cut into blocks of bounded size, and
so are the queries that visit one; tasks compare a block with a block and pass on the
best k of each query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.llm.common import saved

TABLES = 8
#: Share of a table's cells that a query visits.
SHARE = 0.12
#: Vectors and queries compared in one task step, at most about.
BLOCK = 4096


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, width, out = rows.shape[1], 1, rows.copy()
    while width < n:
        pairs = out.reshape(len(out), -1, 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), n)
        width *= 2
    return out / np.sqrt(n)


def rotated(rows: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation of a table: signs and a Hadamard transform, three times; rows are padded to a power of two."""
    size = 1 << (rows.shape[1] - 1).bit_length()
    rows = np.pad(rows, [(0, 0), (0, size - rows.shape[1])])
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, size))
    for row in signs:
        rows = hadamard(rows * row)
    return rows


def cells(rows: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """The signed axes nearest to each row, best first."""
    turned = rotated(rows, table, seed)
    signed = np.concatenate([turned, -turned], axis=1)
    if probes == 1:
        return signed.argmax(axis=1)[:, None]
    best = np.argpartition(-signed, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(best, np.take_along_axis(-signed, best, 1).argsort(axis=1, kind="stable"), 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id long, v array<double>: rows whose vector exists, is not zero and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where("vec_id is not null and size(v) > 0")
        .where(finite & F.exists("v", lambda x: x != 0))
        # Minus zero and zero are one number.
        .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, share: float = SHARE, seed: int = 1
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the largest inner product found for each query.

    ``vectors`` and ``queries`` have vec_id and embedding; a row never finds its own
    vec_id. Order: larger product, then smaller vec_id. Vectors that are NULL, empty,
    zero or hold NULL or non-finite components take no part, nor do rows without vec_id;
    vectors of another length than a query have no product with it and are not found.
    Rows that repeat a vec_id count as one per distinct vector. Empty tables give none.
    """
    rows = usable(vectors)
    # Of equal vectors the first k + 1 numbers can matter: k and perhaps the query's own. Counted per part first.
    digest = F.sha2(F.array_join(F.transform("v", lambda x: F.hex(F.reverse(F.format_string("%.17g", x)))), ","), 256)
    held = saved(rows.withColumn("key", digest).dropDuplicates(["vec_id", "key"]), "vectors")
    part = Window.partitionBy("key", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    first = Window.partitionBy("key").orderBy("vec_id")
    few = (
        held.select("key", "vec_id").withColumn("at", F.row_number().over(part)).where(F.col("at") <= k + 1)
        .withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    )
    members = few.groupBy("key").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    index = saved(
        held.join(members.withColumnRenamed("id", "vec_id"), ["key", "vec_id"]).select("key", F.col("vec_id").alias("id"), "v", "members"),
        "index",
    )
    asked = usable(queries).withColumn("key", digest).select("vec_id", "v", "key")
    asked = saved(asked.dropDuplicates(["vec_id", "key"]), "asked")
    distinct = asked.groupBy("key").agg(F.min("vec_id").alias("first")).join(
        asked.withColumnRenamed("vec_id", "first"), ["key", "first"]
    ).select("key", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    shortest, longest = index.agg(F.min(norm), F.max(norm)).first()
    flat = longest is None or longest - shortest <= 1e-6 * longest

    def hashed(is_query: bool):
        def run(batches):
            for pdf in batches:
                for size, same in pdf.groupby(pdf["v"].map(len)):
                    m = np.stack(same["v"].to_numpy())
                    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
                    for table in range(tables):
                        axes = 2 << (unit.shape[1] - 1).bit_length()
                        near = cells(unit, table, max(1, round(share * axes)) if is_query else 1, seed)
                        cell = (np.int64(size) * tables + table) * 2**20 + near
                        for j in range(near.shape[1]):
                            out = same[["key"]].assign(cell=cell[:, j], v=same["v"])
                            yield out[["cell", "key", "v"]]

        return run

    schema = "cell long, key string, v array<double>"

    def whole(side: DataFrame) -> DataFrame:
        """All vectors of one number of components in one cell."""
        return side.select(F.size("v").cast("long").alias("cell"), "key", "v")

    def compare(q: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(n):
            return pd.DataFrame({"query": [], "found": []})
        a, b = np.stack(q["v"].to_numpy()), np.stack(n["v"].to_numpy())
        keys, out = n["key"].to_numpy(), []
        keep = min(k + 1, len(b))
        margin = 1e-12 * np.maximum(1, np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max())
        for start in range(0, len(a), 256):
            product = a[start : start + 256] @ b.T
            best = np.argpartition(-product, keep - 1, axis=1)[:, :keep]
            # Rounding of the product depends on the shape; ties at the end of the list are kept.
            edge = np.take_along_axis(product, best, 1).min(axis=1) - margin[start : start + 256]
            for i, row in enumerate(product):
                at = np.flatnonzero(row >= edge[i]) if (row >= edge[i]).sum() > keep else best[i]
                exact = (a[start + i] * b[at]).sum(axis=1)
                out.append([{"score": s, "key": x} for s, x in zip(exact.tolist(), keys[at], strict=True)])
        return pd.DataFrame({"query": q["key"].to_numpy(), "found": out})

    def search(there: DataFrame, here: DataFrame) -> DataFrame:
        """query, score, key: the best of each cell that a query visits."""
        # Blocks: a cell with many vectors or many queries is compared piece by piece.
        sizes = saved(
            there.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(
                here.groupBy("cell").agg(F.count(F.lit(1)).alias("q")), "cell"
            ).select(
                "cell",
                F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"), F.ceil(F.col("q") / BLOCK).cast("int").alias("q_blocks"),
            ),
            "cells",
        )

        def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int")
            return side.join(sizes, "cell").withColumn("mine", mine).withColumn(
                "yours", F.explode(F.sequence(F.lit(0), F.col(other) - 1))
            )

        left = dealt(here, "q_blocks", "n_blocks").select("cell", F.col("mine").alias("qb"), F.col("yours").alias("nb"), "key", "v")
        right = dealt(there, "n_blocks", "q_blocks").select("cell", F.col("yours").alias("qb"), F.col("mine").alias("nb"), "key", "v")
        lists = left.groupBy("cell", "qb", "nb").cogroup(right.groupBy("cell", "qb", "nb")).applyInPandas(
            compare, "query string, found array<struct<score double, key string>>"
        )
        # A bounded number of short lists per visited block per query; each visits few distinct vectors twice.
        return lists.select("query", F.explode("found").alias("f")).select("query", "f.score", "f.key").distinct()

    all_here, all_there = whole(distinct), whole(index)
    if flat:
        met = saved(search(index.select("key", "v").mapInPandas(hashed(False), schema), distinct.mapInPandas(hashed(True), schema)), "met")
        # One row more than k, as the query's own may be among them.
        rows_met = met.join(index.select("key", F.size("members").alias("n")), "key").groupBy("query").agg(F.sum("n").alias("n"))
        short = distinct.join(rows_met.where(F.col("n") > k), distinct.key == F.col("query"), "left_anti")
        short = saved(short, "short")
        if not short.isEmpty():
            met = met.union(search(all_there, whole(short))).distinct()
    else:
        met = search(all_there, all_here)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ids = index.select("key", "id", "members")
    best = (
        met.join(ids, "key").withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
        .select("query", "score", "members")
    )
    final = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("own"))
        .join(best, F.col("own") == F.col("query"))
        .select("query_id", "own", "score", F.explode("members").alias("vec_id"))
        .where("query_id != vec_id")
        .withColumn("rank", F.row_number().over(final).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
