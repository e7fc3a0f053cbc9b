from fractions import Fraction

import numpy as np
import pytest

from strandworks.llm import queries as Q
from strandworks.llm import whitening as H

SF = "/root/testdata/sf0.001"


def brute(vectors, components=4):
    """Rows by plain numpy; the covariance from exact whole numbers."""
    x = np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    u = n * fit.astype(object) - s.astype(object)
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in u.T @ u])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    w = (x - s / n) @ q[:, :components] / np.sqrt(e[:components])
    deviation = [int(((n * r.astype(object) - s) ** 2).sum()) for r in x]
    return n, deviation, w, e[:components] / np.trace(v)


def test_query_against_exact_covariance(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, w, explained = brute([r.embedding for r in rows])
    out = Q.QUERIES["op12_whitening"](spark, SF).collect()
    assert len(out) == 4 * len(rows) and out[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    at = {r.vec_id: k for k, r in enumerate(rows)}
    found = np.zeros((len(rows), 4))
    for r in out:
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]])
        assert abs(r.explained - explained[r.component - 1]) < 1e-9 and 0 <= r.identity_error < 1e-9
        found[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((found * w).sum(axis=0))
    assert np.abs(found * sign - w).max() < 1e-8


def test_sums_are_compensated():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (700, 7))
    x[:, 3] += 10**9
    n, s = len(x), x.sum(axis=0)
    own = H.Products(tuple(np.array(v) for v in zip(*(H.divided(int(t), n) for t in s))))
    for k in range(0, n, 90):
        own.add(x[k : k + 90].astype(np.float64))
    high, low = own.total()
    u = n * x.astype(object) - s.astype(object)
    for k, (i, j) in enumerate(zip(*own.at)):
        exact = Fraction(int((u[:, i] * u[:, j]).sum()), n * n)
        assert abs(Fraction(float(high[k])) + Fraction(float(low[k])) - exact) <= Fraction(1, 10**20) * max(1, abs(exact))


def test_error_free_steps():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-9, 9, 500), rng.normal(size=500)
    for f, exact in ((H.two_sum, lambda x, y: x + y), (H.two_product, lambda x, y: x * y)):
        for x, y, p, e in zip(a.tolist(), b.tolist(), *(v.tolist() for v in f(a, b))):
            assert Fraction(p) + Fraction(e) == exact(Fraction(x), Fraction(y))


def test_eigenvectors_of_close_and_equal_values():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    values = np.array([5, 5 - 1e-7, 3, 3, 3, 2, 1, 1e-3, 1e-9, 0, 0, 0.0])
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, x = H.eigen(v, np.zeros_like(v))
    assert np.abs(e - values).max() < 1e-14 and np.abs(x.T @ x - np.eye(12)).max() < 1e-14 and np.abs(v @ x - x * e).max() < 1e-14


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, component int, n string"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, -0.0]), (2, [1.5, -0.25, 3.0]), (3, [0.5, 0.25, 0.0]), (None, [2.0, 2.0, 1.0]), (2, [1.5, -0.25, 3.0]), (4, None), (5, [nan, 0.0, 1.0]), (6, [inf, 0.0, 1.0]), (7, [None, 0.0, 1.0]), (8, []), (9, [1.0]), (10, [2.0, 1.0]), (11, [2.5, 1.0])]
    out = H.whitened(spark.createDataFrame([(*r, 0, "x") for r in rows], schema)).collect()
    by = {}
    for r in out:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {None, 1, 2, 3, 9, 10, 11} and len(by[2]) == 6 and len(by[1]) == 3 and len(by[9]) == 1
    assert by[1][0].n == 3 and by[9][0].whitened is None and by[9][0].explained is None and by[9][0].deviation == 0
    assert [r.whitened for r in sorted(by[1], key=lambda r: r.component)] == [r.whitened for r in sorted(by[3], key=lambda r: r.component)]
    assert sorted(by[1], key=lambda r: r.component)[2].whitened is None  # three vectors have two directions
    assert abs(abs(by[10][0].whitened) - 1) < 1e-12 and all(r.identity_error < 1e-9 for r in out)
    assert H.whitened(spark.createDataFrame([], schema)).count() == 0
    n, deviation, w, explained = brute([[0.5, 0.25, 0.0], [1.5, -0.25, 3.0], [2.0, 2.0, 1.0]], 2)
    assert {r.deviation for r in by[1]} == {deviation[0]} and abs(by[1][0].explained - explained[by[1][0].component - 1]) < 1e-12


def test_hot_vector_counts_once(spark):
    rng = np.random.default_rng(6)
    few = rng.normal(size=(50, 6)).astype(np.float32).tolist()
    rows = [(i, few[i % 50] if i % 3 else few[0]) for i in range(900)]
    out = H.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(9)).collect()
    assert len(out) == 3600 and {r.n for r in out} == {50}
    n, deviation, w, _ = brute([r[1] for r in rows])
    found = np.zeros((900, 4))
    for r in out:
        found[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(found) - np.abs(w)).max() < 1e-9


@pytest.mark.parametrize("total, n", [(10, 3), (-7, 9), (2**60 + 1, 7), (0, 5)])
def test_divided(total, n):
    high, low = H.divided(total, n)
    assert abs(Fraction(high) + Fraction(low) - Fraction(total, n)) <= abs(Fraction(total, n)) / 2**100
