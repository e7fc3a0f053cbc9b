"""No query of the approximate search is left short."""

import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import ann


def searched(spark, x, is_query, k=20):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got: dict[int, list] = {}
    for r in ann.nearest(rows, is_query, k=k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def best(x, q, k):
    s = x.astype(np.float32).astype(float) @ x[q].astype(np.float32).astype(float)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)].tolist()


def test_fewer_candidates_than_k(spark):
    for seed in range(3):
        x = np.random.default_rng(seed).standard_normal((15, 64))
        got = searched(spark, x, F.col("vec_id") % 3 == 0)
        assert got == {q: best(x, q, 20) for q in range(0, 15, 3)}


def test_isolated_queries_beside_groups(spark):
    rng = np.random.default_rng(3)
    centres, lone = rng.standard_normal((10, 64)), rng.standard_normal((150, 64))
    x = np.concatenate((np.repeat(centres, 85, axis=0) + 0.01 * rng.standard_normal((850, 64)), lone))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[rng.permutation(len(x))]
    got = searched(spark, x, F.col("vec_id") % 5 == 0)
    asked = range(0, 1000, 5)
    assert all(len(got.get(q, [])) == 20 for q in asked)
    s = x @ x.T
    alone = [q for q in asked if (s[q] > 0.9).sum() < 20]
    share = lambda some: np.mean([len(set(got[q]) & set(best(x, q, 20))) / 20 for q in some])
    assert len(alone) > 10 and share(alone) >= 0.9
