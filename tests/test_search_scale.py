"""The search moves little, and grid joins, walks and runs give what plain versions give."""

import random

import pytest
from pyspark.sql import functions as F

from strandworks.operators import extension, kmers, matches, packed, seeds
from strandworks.params import Diagonal, Search
from strandworks.plans.search import search, search_by_diagonal


def sequences(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, seq string")


def letters(rng, n, alphabet="ATGC"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    base = letters(rng, 300)
    q = [(i, letters(rng, 90, "AT") if i == 3 else base[i * 7 : i * 7 + 90]) for i in range(6)] + [(6, ""), (7, "ACGTNACGTNN"), (8, "xACGTACGx")]
    d = [(i, letters(rng, 200) + base[: 40 * i] + letters(rng, 60, "AT")) for i in range(5)] + [(5, "ACGTNACGTNNxACGTACG"), (6, letters(rng, 2500, "AT"))]
    return sequences(spark, q), sequences(spark, d)


@pytest.mark.parametrize("k, few", [(6, True), (3, False), (14, True)])
def test_packed_matches_are_all_matches(tables, monkeypatch, k, few):
    q, d = tables
    monkeypatch.setattr(packed, "LONG", 300)  # several tasks a database
    clean = lambda df: df.withColumn("seq", F.regexp_replace("seq", "[^ATGCN]", ""))
    want = matches.exact(kmers.generate(clean(q), k), kmers.generate(clean(d), k)).collect()
    got = packed.matches(packed.met(clean(q), clean(d), k, few=few), k).drop("task").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


@pytest.mark.parametrize("k, gap, least", [(6, 1, 2), (4, 3, 2), (5, 0, 3), (6, 8, 1), (12, 5, 2)])
def test_runs_give_the_seeds_of_matches(tables, k, gap, least):
    q, d = tables
    met = packed.met(q, d, k, few=True)
    p = Diagonal(k=k, max_gap=gap, min_matches=least)
    plain = seeds.by_diagonal(packed.matches(met, k).drop("task"), p)
    runs = packed.runs(met, k, gap, least < 2)
    found = seeds.by_diagonal(runs, p).drop("task")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(found.columns).collect()))


def test_rows_that_are_sorted_are_few(spark):
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id as seq_id", "regexp_replace(upper(text), '[^ATGC]', '') as seq")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as seq_id", "regexp_replace(upper(text), '[^ATGC]', '') as seq")
    met = packed.met(q, d, 6)
    assert 3 * packed.runs(met, 6, 1).count() < met.count()


def test_no_shuffle_of_matches(tables):
    q, d = tables
    seeded = search(q, d, Search(k=6))["seeds"]
    plan = seeded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # that of the databases


def test_walks_over_many_chunks(spark, monkeypatch):
    """Walks that end in their chunk, in later ones, and at the ends, against whole flanks."""
    monkeypatch.setattr(extension, "CHUNK", 4)
    monkeypatch.setattr(extension, "GROWTH", 2)
    monkeypatch.setattr(extension, "PIECE", 8)
    rng = random.Random(9)
    q = [(1, letters(rng, 400)), (2, letters(rng, 37))]
    d = [(1, letters(rng, 30) + q[0][1][20:390] + letters(rng, 5)), (2, q[1][1]), (3, q[0][1][:100] + letters(rng, 3) + q[0][1][100:200])]
    for p, run in ((Search(k=8), search), (Diagonal(k=8), search_by_diagonal)):
        stages = run(sequences(spark, q), sequences(spark, d), p)
        found = {(r.query_id, r.db_id, r.seed_id): r for r in stages["extensions"].collect()}
        flat = stages["seeds"].collect()
        assert len(found) == len(flat) and any(r.length > 300 for r in found.values())
        one, two = dict(q), dict(d)
        for s in flat:
            a, b = one[s.query_id], two[s.db_id]
            gain, steps = [], []
            for x, y in ((a[: s.query_start][::-1], b[: s.db_start][::-1]), (a[s.query_end + 1 :], b[s.db_end + 1 :])):
                now = best = at = 0
                for t, (u, v) in enumerate(zip(x, y), 1):
                    now += 2 if u == v else -1
                    if now > best:
                        best, at = now, t
                    if now < best - p.drop or (run is search_by_diagonal and now < -p.floor):
                        break
                gain.append(best)
                steps.append(at)
            r = found[s.query_id, s.db_id, s.seed_id]
            assert (r.query_start, r.query_end, r.score) == (s.query_start - steps[0], s.query_end + steps[1], s.score + sum(gain))
            assert r.query_alignment == a[r.query_start : r.query_end + 1] and r.db_alignment == b[r.db_start : r.db_end + 1]


def test_long_sequences_move_few_chunks(spark):
    """10,000 seeds on two sequences of a million letters: what is shuffled and saved is far from 10,000 sequences."""
    rng = random.Random(1)
    block = letters(rng, 50_000)
    a, b = letters(rng, 450_000) + block + letters(rng, 500_000), letters(rng, 450_000) + block + letters(rng, 500_000)
    starts = [450_000 + 20_000] + [rng.choice((rng.randrange(1_000, 449_000), rng.randrange(501_000, 999_000))) for _ in range(9_999)]
    rows = [(1, 2, i, s, s + 11, s, s + 11, 24.0) for i, s in enumerate(starts)]
    flat = spark.createDataFrame(rows, "query_id long, db_id long, seed_id long, query_start long, query_end long, db_start long, db_end long, score double")
    out = seeds.extend_live(flat, sequences(spark, [(1, a)]), sequences(spark, [(2, b)]), Search(k=12))
    rows = {r.seed_id: r.length for r in out.select("seed_id", "length").collect()}
    assert len(rows) == 10_000 and 50_000 <= rows.pop(0) < 50_050 and max(rows.values()) < 200
    long = out.filter("seed_id = 0").first()
    assert long.query_alignment == a[long.query_start : long.query_end + 1] and block in long.db_alignment


def test_overlaps_in_cells(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        s, t, n = rng.randrange(900), rng.randrange(900), rng.choice((5, 12, 31, 33, 64, 700, 3000))
        rows.append((i % 3, i % 2, i // 6, s, s + n - 1, t, t + n + rng.randrange(3) - 1))
    df = spark.createDataFrame(rows, "query_id long, db_id long, seed_id long, query_start long, query_end long, db_start long, db_end long")
    want = []
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] < b[2]:
                x, y = (min(a[k + 1], b[k + 1]) - max(a[k], b[k]) + 1 for k in (3, 5))
                if x > 0 and y > 0:
                    want.append((*a[:3], b[2], x, y))
    got = seeds.overlapping_pairs(df)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500
    assert seeds.overlapping_pairs(df.limit(0)).count() == 0
