"""Nearest neighbours, connected groups, the pipeline and the registry."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from harvestlens.llm import common, neighbours
from tests.llm.cases import empty, groups, messy


def test_components_equal_plain_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    both = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    assert got == groups(nodes, lambda a, b: frozenset((a, b)) in both)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    rows = table.collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = m @ m[k]
        score[k] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        mine = found[ids[k]]
        assert len(mine) == 20 and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, s in mine)
        hits, total = hits + len({v for v, _ in mine} & set(best.tolist())), total + 20
    assert hits / total >= 0.9


def test_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(0, 50)] + [(k, [4.0, -1.0, 0.5, float(k)]) for k in range(50, 60)]
    rows += [(100, None), (120, [0.0] * 4), (140, [1.0, nan, 0.0, 0.0]), (160, [inf, 0.0, 0.0, 0.0]), (180, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    rows += [(0, [1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 20, share=1.0).collect()
    usable = {i: np.array(v) for i, v in rows[:60]}
    for q in (0, 20, 40):
        wanted = sorted((-float(v @ usable[q]), i) for i, v in usable.items() if i != q)[:20]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert mine == [(k + 1, i) for k, (_, i) in enumerate(wanted)]
    assert {r.query_id for r in got} == {0, 20, 40}
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_copes_with_awkward_tables(spark):
    for docs in (messy(spark), empty(spark)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = common.saved(stage(spark, docs, ""), name)
            if name != "pack":
                assert docs.columns == names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in entry.queries()


def test_stages_send_texts_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    docs = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) text")
    made = corpus_pipeline.stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))(spark, docs, "")
    found = [r.n for r in made.collect()]
    assert sum(found) >= 30_000_000 and max(found) < 5_000_000
