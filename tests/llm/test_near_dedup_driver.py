"""What the driver holds for the join by rare shingles."""

import numpy as np

from strandworks.llm import near_dedup as N


def test_counts_come_packed(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6_000, dtype=np.uint64)
    sets = [base[:900], base[:1000], *np.split(base[1000:], 25)]  # the first two share 0.9 of their union
    df = spark.createDataFrame([(i, i, np.sort(x).tobytes()) for i, x in enumerate(sets)], "node long, component long, hashes binary").repartition(3)
    sizes, tables, kind = [], [], type(df)

    def told(name, size):
        whole = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *a, **b: (sizes.append(size(out := whole(self, *a, **b))), out)[1])

    told("collect", len)
    told("toPandas", len)
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: tables.append(x) or broadcast(self, x))
    pairs = N.by_rare_shingles(df)
    assert sizes and max(sizes) <= 4  # rows that came to the driver: one for each shuffle partition at most
    want = np.bincount((np.concatenate(sets) & np.uint64(N.CELLS - 1)).astype(np.int64), minlength=N.CELLS)
    assert np.array_equal(tables[0], want)
    assert (0, 1) in {(r.a, r.b) for r in pairs.collect()}


def test_no_sets(spark):
    df = spark.createDataFrame([], "node long, component long, hashes binary")
    assert not N.by_rare_shingles(df).collect()
