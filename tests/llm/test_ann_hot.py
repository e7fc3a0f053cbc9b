"""A bucket with very many equal vectors and queries takes neither memory nor places."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa

from strandworks.llm import ann


def table(ids, vectors, **more):
    return pa.table({**more, "embedding": pa.array(list(vectors.astype(np.float32)))})


def test_hot_bucket():
    rng = np.random.default_rng(1)
    one = rng.normal(size=16).astype(np.float32)
    n, m = 20_000, 5_000
    x = np.tile(one, (n, 1))
    left = pa.table({"query_id": np.arange(m), "embedding": pa.array(list(x[:m])), "buckets": pa.array([[7]] * m, pa.list_(pa.int64()))})
    right = pa.table({"vec_id": rng.permutation(n), "embedding": pa.array(list(x)), "bucket": np.full(n, 7)})
    tracemalloc.start()
    began = time.time()
    out = ann.meet(left, right, 20)
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 1 << 29
    tracemalloc.stop()
    want = {i: [v for v in range(21) if v != i][:20] for i in range(m)}
    got = {}
    for i, v in zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist()):
        got.setdefault(i, []).append(v)
    assert {i: sorted(v) for i, v in got.items()} == want


def test_blocks_and_repeated_ids(monkeypatch):
    monkeypatch.setattr(ann, "STRETCH", 32)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (900, 4)).astype(np.float32)
    ids = rng.integers(0, 300, 900)
    left = pa.table({"query_id": np.arange(50), "embedding": pa.array(list(x[:50])), "buckets": pa.array([[1, 2]] * 50, pa.list_(pa.int64()))})
    right = pa.table({"vec_id": ids, "embedding": pa.array(list(x)), "bucket": rng.integers(1, 3, 900)})
    out = ann.meet(left, right, 10).to_pylist()
    for i in range(50):
        best = {}
        for v, s in zip(ids.tolist(), (x.astype(float) @ x[i].astype(float)).tolist()):
            if v != i:
                best[v] = max(s, best.get(v, -1e9))
        want = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:10]
        assert sorted((r["vec_id"], r["score"]) for r in out if r["query_id"] == i) == sorted(want)
