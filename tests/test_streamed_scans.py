"""Scans whose choices depend on earlier ones, against plain versions."""

import random

from strandworks.operators import matches, seeds


def test_without_close(spark):
    rng = random.Random(3)
    rows = sorted({(i % 3, i % 2, rng.randrange(60), rng.randrange(300)) for i in range(6000)})
    df = spark.createDataFrame([(*r, "AC") for r in rows], "query_id long, db_id long, query_pos long, db_pos long, kmer string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        for gap in (0, 1, 3):
            kept = set()
            for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
                if not any((r[0], r[1], r[2] + i, r[3] + j) in kept for i in range(-gap, gap + 1) for j in range(-gap, gap + 1)):
                    kept.add(r)
            assert {tuple(r)[:4] for r in matches.without_close(df, gap).collect()} == kept
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_without_redundant(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        s, t, n = rng.randrange(400), rng.randrange(700), rng.choice((6, 9, 20, 90, 300))
        rows.append((i % 2, i % 3, i // 6, s, s + n - 1, t, t + n + rng.randrange(2) - 1, float(rng.randrange(40))))
    df = spark.createDataFrame(rows, "query_id long, db_id long, seed_id long, query_start long, query_end long, db_start long, db_end long, score double")

    def share(a, b, c, d):
        return max(0, min(b, d) - max(a, c) + 1) / (b - a + 1)

    for most in (0.5, 0.2, 0.8):
        kept = []
        for r in sorted(rows, key=lambda r: (r[0], r[1], -r[7], r[2])):
            if not any(k[:2] == r[:2] and share(r[3], r[4], k[3], k[4]) > most and share(r[5], r[6], k[5], k[6]) > most for k in kept):
                kept.append(r)
        assert sorted(map(tuple, seeds.without_redundant(df, most).collect())) == sorted(kept) and len(kept) < 900
