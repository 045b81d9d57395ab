"""Merkle manifests and multiproofs against plain trees."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from harvestlens.llm import merkle
from tests.llm.cases import empty, messy

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def text_of(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return merkle.digest([text_of(row[c]) for c in FIELDS])


def plain_levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([merkle.digest(now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels


def plain_proof(k, levels):
    return [x[k >> up ^ 1] if k >> up ^ 1 < len(x) else None for up, x in enumerate(levels[:-1])]


def check(spark, docs):
    rows = docs.collect()
    trees = defaultdict(list)
    for r in rows:
        trees["" if r.lang is None else f"={r.lang}"].append(((r.doc_id is not None, r.doc_id or 0, leaf_of(r))))
    order = sorted(trees, key=lambda t: t.encode())
    levels = {t: plain_levels([leaf for *_, leaf in sorted(trees[t])]) for t in order}
    top = plain_levels([levels[t][-1][0] for t in order])
    made = merkle.manifest(docs, merkle.leaf_hash(*[F.col(c) for c in FIELDS]), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")})
    assert made.root == (top[-1][0] if rows else merkle.EMPTY_ROOT)
    got = merkle.proofs(made).withColumn("folded", merkle.folded(F.col("hash"), F.col("path"), F.col("siblings"))).collect()
    assert len(got) == len(rows)
    for r in got:
        proof = plain_proof(r.pos, levels[r.tree]) + plain_proof(order.index(r.tree), top)
        assert (r.hash, r.siblings) == (levels[r.tree][0][r.pos], proof)
        assert r.folded == r.root == made.root and r.subroot == levels[r.tree][-1][0]
    return made, got


def test_messy_rows(spark):
    check(spark, messy(spark))


def test_no_rows(spark):
    made, got = check(spark, empty(spark))
    assert got == []


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 5, 8), (9000, 1, 4097)])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(k, "s", f"l{t}", k, "x") for t, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    made, _ = check(spark, docs)
    assert made.groups == len(sizes)


def test_proofs_of_some_rows(spark):
    docs = spark.createDataFrame([(k, "s", "l", k, "x") for k in range(5000)], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(docs, merkle.leaf_hash(*[F.col(c) for c in FIELDS]), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id")})
    whole = {r.pos: r.siblings for r in merkle.proofs(made).collect()}
    some = [0, 1, 6, 4095, 4096, 4999]
    wanted = spark.createDataFrame([("=l", k) for k in some], "tree string, pos long")
    assert {r.pos: r.siblings for r in merkle.proofs(made, wanted).collect()} == {k: whole[k] for k in some}


def test_multiproof_is_least():
    for n in range(1, 40):
        for held in ([0], [n - 1], list(range(n)), list(range(0, n, 3))):
            got = merkle.missing(held, n)
            assert len(got) == len(set(got))
            # A coordinate is needed if it is on no held leaf's way up and is the sibling of one that is.
            ways = {(up, k >> up) for k in held for up in range(merkle.height(n))}
            width = lambda up: (n - 1 >> up) + 1
            assert set(got) == {(up, k ^ 1) for up, k in ways if (up, k ^ 1) not in ways and k ^ 1 < width(up)}


def test_changed_row_does_not_verify(spark):
    docs = spark.createDataFrame([(k, "s", "l", k, "x") for k in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    other = merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + F.when(F.col("doc_id") == 7, 1).otherwise(0), F.col("text"))
    made = merkle.manifest(docs, merkle.leaf_hash(*[F.col(c) for c in FIELDS]), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "other": other})
    rows = merkle.proofs(made).select("kept.doc_id", (merkle.folded(F.col("kept.other"), F.col("path"), F.col("siblings")) == F.col("root")).alias("same"))
    assert {r.doc_id for r in rows.collect() if not r.same} == {7}
