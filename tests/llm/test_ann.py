"""Neighbours of clustered vectors against brute force, with many blocks of queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import ann


@pytest.mark.parametrize("block,width", [(64, np.inf), (1000, np.inf), (37, 3.0)])
def test_clusters_and_blocks_of_queries(spark, block, width):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 4
    x = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 16)) * 0.3).astype(np.float32)
    x[1000:2000] = x[0]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, [0.0] * 16), (5020, None), (5040, [float("nan")] * 16), (5060, [1.0]), (None, x[3].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("cell", "code", "vector")}).repartition(7)
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), k=20, query_block=block, pilot=300, width=width).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    wide, hit = x.astype(np.float64), 0
    for q, found in got.items():
        score = np.zeros(3000)
        for j in range(16):
            score += wide[:, j] * wide[q, j]
        score[q] = -np.inf
        want = np.lexsort((np.arange(3000), -score))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(abs(score[v] - s) < 1e-9 for _, v, s in found)
        if np.isinf(width):
            assert [v for _, v, _ in sorted(found)] == want.tolist()
        hit += len(set(want) & {v for _, v, _ in found})
    assert hit >= 0.97 * 20 * len(got)
