"""Nearest neighbours of vectors of unequal norms, with the production parameters."""

from __future__ import annotations

import numpy as np
import pytest

from harvestlens.llm import neighbours


def test_unequal_norms_and_an_outlier(spark):
    rng = np.random.default_rng(4)
    m = rng.standard_normal((1500, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    one = m.copy()
    one[7] *= 100
    for v in (one, m * np.exp(rng.standard_normal((1500, 1)))):
        table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = neighbours.nearest(table, table.where("vec_id % 50 = 0"), 20).collect()
        found = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            found.setdefault(r.query_id, []).append(r.vec_id)
        for q in range(0, 1500, 50):
            score = v @ v[q]
            score[q] = -np.inf
            assert found[q] == np.argsort(-score, kind="stable")[:20].tolist()


@pytest.mark.parametrize("share", [0.01])
def test_few_candidates_are_made_up_for(spark, share):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 20, tables=1, share=share).collect()
    assert len(got) == 15 * 20
