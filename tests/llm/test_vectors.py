import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.llm import ann, topk
from strandworks.llm import queries as Q

from ..oracle import check

SF = "/root/testdata/sf0.001"
EDGE = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.0, 0.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 1.0]), (10, [-1.0, 0.5]), (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0])]


def edge(spark):
    return spark.createDataFrame(EDGE, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score", "3 as query_id", "'d' as dims")


def test_topk_against_sql(spark):
    check(spark, SF, Q.QUERIES["op2_topk"], Q.ORACLE_SQL["op2_topk"])


def searched(docs, q, k, query_id=-1, least=None, ids=None):
    shard = topk.Shard(np.arange(len(docs)) if ids is None else ids, docs)
    return shard.best(query_id, q, k, least), shard.touched / max(shard.possible, 1)


def wanted(docs, q, k, query_id=-1):
    s = [sum(int(a) * int(b) for a, b in zip(q.tolist(), row)) for row in docs.tolist()]
    return [(i, s[i]) for i in sorted((i for i in range(len(s)) if i != query_id), key=lambda i: (-s[i], i))][:k]


def test_max_score_against_all_products():
    rng = np.random.default_rng(1)
    for n, d, k in ((5, 3, 10), (700, 16, 10), (3000, 32, 3)):
        docs, queries = rng.integers(-9, 10, (n, d)).astype(float), rng.integers(-9, 10, (20, d)).astype(float)
        for i, q in enumerate(queries):
            want = wanted(docs, q, k, i % n)
            assert searched(docs, q, k, i % n)[0] == want
            assert searched(docs, q, k, i % n, float(want[-1][1]))[0] == want
    assert searched(np.zeros((9, 3)), np.zeros(3), 2)[0] == [(0, 0), (1, 0)]


def test_few_terms_are_enough_where_they_tell():
    """Vectors with a few large components: most postings are never probed, and nothing is lost."""
    rng = np.random.default_rng(4)
    docs = np.floor(1024 * rng.standard_normal((4000, 64)) * 0.8 ** np.arange(64))
    for i in range(10):
        got, share = searched(docs, docs[i], 10, i)
        assert got == wanted(docs, docs[i], 10, i) and share < 0.35
        again, less = searched(docs, docs[i], 10, i, float(got[-1][1]))
        assert again == got and less < share


def test_uniform_vectors_are_pruned_too():
    rng = np.random.default_rng(6)
    docs = rng.standard_normal((8000, 64))
    docs = np.floor(1024 * docs / np.linalg.norm(docs, axis=1)[:, None])
    got, _ = searched(docs, docs[0], 10, 0)
    assert searched(docs, docs[0], 10, 0, float(got[-1][1]))[1] < 0.75


def test_sums_beyond_doubles():
    """Products that a double cannot tell apart, and sums beyond a long."""
    big = 2.0**40
    docs = np.array([[big, 1.0], [big, 3.0], [big, 2.0], [-big, 5.0]])
    q = np.array([2.0**20, 1.0])
    assert searched(docs, q, 3)[0] == [(1, 2**60 + 3), (2, 2**60 + 2), (0, 2**60 + 1)]
    assert searched(docs, q, 1, least=2.0**60)[0] == [(1, 2**60 + 3)]
    assert searched(docs, np.array([big, 1.0]), 4)[0] == [(0, 2**63 - 1), (1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]


def test_topk_beyond_doubles(spark):
    rows = spark.createDataFrame([(0, [2.0**10, 1.0]), (1, [2.0**30, 1.0]), (2, [2.0**30, 2.0]), (3, [2.0**30, 3.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(rows, F.col("vec_id") == 0, k=2).orderBy("rank").collect()]
    assert got == [(3, 2**60 + 3 * 2**20), (2, 2**60 + 2 * 2**20)]


def test_one_id_with_many_rows(spark):
    rows = [(7, [1.0, float(i % 5)]) for i in range(3000)] + [(i, [1.0, i / 100]) for i in range(10, 40)] + [(0, [0.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(7, 4 << 20), (39, int(np.float32(0.39) * 1024) * 1024), (38, int(np.float32(0.38) * 1024) * 1024)]


def test_topk_edges(spark):
    got = topk.top_k(edge(spark), F.col("vec_id") % 10 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0] == [(0, 1, 7, 5 << 20), (0, 2, 8, 4 << 20), (0, 3, 6, 0)]
    assert topk.top_k(edge(spark).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(edge(spark), F.lit(False)).count() == 0


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELLS", 64 * 64)  # shards and blocks of 64
    check(spark, SF, Q.QUERIES["op2_topk"], Q.ORACLE_SQL["op2_topk"])


def exact(vectors, q, k):
    own = {i: np.array(v, float) for i, v in vectors}
    s = sorted(((-float(v @ own[q]), i) for i, v in own.items() if i != q))
    return [i for _, i in s[:k]]


@pytest.mark.parametrize("SF", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_ann_recall(spark, SF):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in rows.collect()]
    got: dict[int, list] = {}
    for r in Q.QUERIES["op3_ann"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i, _ in vectors if i % 20 == 0]
    assert set(got) == set(asked)
    hits = sum(len({v for _, v, _ in got[q]} & set(exact(vectors, q, 20))) for q in asked)
    assert hits >= 0.9 * 20 * len(asked)
    own = {i: np.array(v, float) for i, v in vectors}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert all(abs(s - own[q] @ own[v]) < 1e-12 for _, v, s in found)


def test_ann_hot_bucket_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEGMENT", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    rng = random.Random(2)
    same = [(i, [1.0, 0.0, 0.0]) for i in range(200)]
    other = [(i, [x / sum(y * y for y in v) ** 0.5 for x in v]) for i, v in ((i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200, 300))]
    rows = spark.createDataFrame(same + other, "vec_id long, embedding array<float>")
    got = ann.nearest(rows, F.col("vec_id") % 50 == 0, k=5).filter("query_id = 0").orderBy("rank").collect()
    best = exact([(i, np.float32(v).tolist()) for i, v in same + other], 0, 5)
    assert [r.vec_id for r in got] == best


def test_ann_edges(spark):
    rows = edge(spark)  # with one vector that is longer than the others
    got = ann.nearest(rows, F.col("vec_id") % 10 == 0, k=20)
    ids = {r.vec_id for r in got.collect()}
    assert ids <= {0, 7, 8, 10} and {r.query_id for r in got.collect()} == {0, 10}
    # vectors of another length are a space of their own
    both = rows.select("vec_id", "embedding").union(spark.createDataFrame([(20, [3.0, 2.0, 1.0]), (30, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"], r.vec_id): r.score for r in ann.nearest(both, F.col("vec_id") % 10 == 0, k=20).collect()}
    assert {k: v for k, v in got.items() if k[0] in (20, 30)} == {(20, 1, 11): 10.0, (20, 2, 30): 1.0, (30, 1, 11): 3.0, (30, 2, 20): 1.0}
    assert ann.nearest(rows.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert ann.nearest(rows, F.lit(False)).count() == 0


def test_probes_come_in_order_and_reach_success():
    from itertools import product
    from math import erf, sqrt

    rng = np.random.default_rng(0)
    for hashes, distance in ((1, 0.5), (4, 1.1), (5, 2.0)):
        place = rng.uniform(-3, 3, hashes)
        cell = np.floor(place / 1.6).astype(int)
        chance = lambda c: np.prod([(erf(((x + 1) * 1.6 - p) / (distance * sqrt(2))) - erf((x * 1.6 - p) / (distance * sqrt(2)))) / 2 for x, p in zip(c, place)])
        got = [chance(c) for c in ann.probes(cell, place, 1.6, distance, 0.7).tolist()]
        all_of_them = sorted((chance(cell + np.array(s)) for s in product(range(-3, 4), repeat=hashes)), reverse=True)
        assert np.allclose(got, all_of_them[: len(got)]) and 0.7 <= sum(got) < 0.7 + got[-1]


def test_repeated_ids_fill_no_places():
    """Rows that share an id with different vectors count once, in one task too."""
    import pyarrow as pa

    x = [[1.0, 0.0]] + [[0.9 - i / 1000, 0.1] for i in range(300)] + [[0.5, 0.2], [0.4, 0.3]]
    ids = [0] + [1] * 300 + [2, 3]
    vectors = pa.array(x, pa.list_(pa.float64()))
    left = pa.table([pa.array([0]), pa.array([[1.0, 0.0]], pa.list_(pa.float64())), pa.array([[5]], pa.list_(pa.int64()))], ["query_id", "embedding", "buckets"])
    right = pa.table([pa.array(ids), vectors, pa.array([5] * len(ids))], ["vec_id", "embedding", "bucket"])
    got = ann.meet(left, right, 3)
    assert got["vec_id"].to_pylist() == [1, 2, 3] and got["score"].to_pylist() == [0.9, 0.5, 0.4]


def test_groups_are_searched_without_the_rest(spark):
    """Where vectors form groups, a query visits a small share of the table and finds its neighbours."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((200, 48))
    x = np.repeat(centres, 30, axis=0) + 0.15 * rng.standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cut, distance = ann.Projections(48, 1.0), 0.22
    lifted = cut.lifted(x)
    share, found = [], []
    for q in range(0, 6000, 200):
        seen = np.zeros(len(x), bool)
        for t in range(ann.TABLES):
            place = cut.places(cut.scaled(x[q : q + 1]), t)[0]
            codes = cut.code(ann.probes(np.floor(place / cut.width).astype(int), place, cut.width, distance, ann.SUCCESS))
            seen |= np.isin(cut.code(np.floor(cut.places(lifted, t) / cut.width).astype(int)), codes)
        s = x @ x[q]
        s[q] = -9
        share.append(seen.mean())
        found.append(seen[np.argsort(-s)[:20]].mean())
    assert np.mean(share) < 0.1 and np.mean(found) >= 0.85
