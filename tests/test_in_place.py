"""Seeds, extensions and what they tell of their pairs come from where the databases lie, as from Spark's sorts."""

import numpy as np
import pyarrow as pa
import pytest

from strandworks import queries as Q
from strandworks.operators import in_place, packed, seeds
from strandworks.params import Diagonal, Search
from strandworks.plans import search as plans
from strandworks.plans.search import search, search_by_diagonal, summary, top
from strandworks.sources import tables

SF = "/root/testdata/sf0.001"
ODD = [(1, "ACGTACGGTCA" * 5 + "T" + "ACGTACGGTCA" * 4), (2, "A" * 90 + "C" + "A" * 90), (3, "ACA" * 40), (5, "ACGTNACGTNNxACGTACG"), (6, "")]
NAMES = [
    "diagonal_seeds", "extension_potential", "filtered_seeds", "seed_statistics", "seeds_without_redundant", "overlapping_seeds", "seed_details", "diagonal_extensions", "extension_analysis",
    "extension_lookup", "extension_statistics", "overlapping_extensions", "live_seeds", "search_results", "search_summary", "top_results", "extension_blocks",
    "match_diagonals", "seed_gaps", "dense_match_regions", "matches_without_close",
]


def frames(spark, *more):
    odd = spark.createDataFrame([*ODD, *more], "seq_id long, seq string")
    return tables.queries_of(spark, SF).filter("seq_id % 8 = 0 and seq_id > 9").union(odd), tables.databases_of(spark, SF).filter("seq_id % 10 = 0 and seq_id > 9").union(odd)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_sorted_or_shuffled_by_pair(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Join" not in plan.replace("BroadcastHashJoin", "")
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("REPARTITION" in line for line in shuffles)  # the databases alone


@pytest.mark.parametrize("p", [Diagonal(k=6), Diagonal(k=4, max_gap=3), Diagonal(k=5, max_gap=0, min_matches=3), Diagonal(k=6, max_gap=8, min_matches=1), Diagonal(k=12, max_gap=5), Diagonal(k=4, max_gap=-2)])
def test_seeds_by_diagonal(spark, monkeypatch, p):
    monkeypatch.setattr(packed, "LONG", 100)  # several tasks a database
    got = search_by_diagonal(*frames(spark), p)["seeds"].drop("task")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(plans, "EXTENDED_IN_TASK", 0)
    want = search_by_diagonal(*frames(spark), p)["seeds"].drop("task")
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() > 100


def test_what_is_told_of_pairs(spark, monkeypatch):
    def told():
        live, by_diagonal = search(*frames(spark), Q.LIVE), search_by_diagonal(*frames(spark), Q.BY_DIAGONAL)
        of_seeds = ("seeds", "seed_statistics", "apart", "seed_overlaps", "extension_overlaps", "extension_statistics")
        return [live["seeds"].drop("task"), summary(live), top(live, 3), *(by_diagonal[name].drop("task") for name in of_seeds)]

    got = told()
    monkeypatch.setattr(plans, "EXTENDED_IN_TASK", 0)
    for one, two in zip(got, told()):
        assert rows(one.select(sorted(one.columns))) == rows(two.select(sorted(two.columns))) and one.count() > 10


@pytest.mark.parametrize("p", [Search(k=4, max_gap=0, min_matches=1), Search(k=5, max_gap=3, min_matches=3)])
def test_live_seeds(spark, monkeypatch, p):
    got = search(*frames(spark), p)["seeds"].drop("task")
    monkeypatch.setattr(plans, "EXTENDED_IN_TASK", 0)
    assert rows(got) == rows(search(*frames(spark), p)["seeds"].drop("task").select(got.columns))


@pytest.mark.parametrize("more", [(1, "ACGTACGGTCA" * 3), (None, "ACGTACGGTCA" * 3)])
def test_shared_numbers_and_none(spark, more):
    """Sequences of one number are one, as in SQL: these are left to Spark's sorts."""
    q, d = frames(spark, more)
    found = search_by_diagonal(q, d, Q.BY_DIAGONAL)
    assert "Window" in found["seeds"]._jdf.queryExecution().executedPlan().toString()
    assert rows(found["seeds"]) == rows(seeds.by_diagonal(found["dealt"], Q.BY_DIAGONAL).select(found["seeds"].columns))


def test_places_are_letters():
    assert in_place.Letters(pa.array(["AéC"]), 7).size.tolist() == [3]


def test_few_at_once(monkeypatch):
    """The same seeds, however few places are met at once."""
    texts, n = pa.array([t for _, t in ODD]), np.ones(len(ODD), np.int64)
    for p in (Diagonal(k=6), Search(k=6)):
        want = in_place.Meeting(texts, p).meet(in_place.Letters(texts, 7), n, 0 * n, False)
        monkeypatch.setattr(in_place, "AT_ONCE", 7)
        got = in_place.Meeting(texts, p).meet(in_place.Letters(texts, 7), n, 0 * n, False)
        monkeypatch.undo()
        assert len(got.n) > 100 and all((getattr(got, c) == getattr(want, c)).all() for c in ("q_at", "d_at", "q_end", "d_end", "n", "query", "db", "seed_id"))


def test_close_matches():
    """Against a plain scan: words of one letter, of two by turns, and others."""
    queries = [t for _, t in ODD] + ["ATATATATATATCGATATATATAT", "GCGCGCGCATATATATTTTTTTTTCCCCCCCCGCGCGCGC"]
    for k in (6, 3, 1):
        met = in_place.Meeting(pa.array(queries), Search(k=k))
        n = np.ones(len(queries), np.int64)
        met.meet(in_place.Letters(pa.array(queries), 7), n, 0 * n, False, False)
        got, want = [], []
        for c in in_place.without_close(None, met, {}):
            got += zip(*(c[name].tolist() for name in ("query", "db", "query_pos", "db_pos")), c["kmer"].to_pylist())
        for i, a in enumerate(queries):
            for j, b in enumerate(queries):
                kept = set()
                for d in range(len(b) - k + 1):
                    for q in range(len(a) - k + 1):
                        same = a[q : q + k] == b[d : d + k] and set(a[q : q + k]) <= set("ATGCNU")
                        if same and not any((d - x, q + y) in kept for x in (0, 1) for y in (-1, 0, 1)):
                            kept.add((d, q))
                            want.append((i, j, q, d, a[q : q + k]))
        assert len(want) > 1000 and sorted(got) == sorted(want)


def test_close_matches_of_shared_numbers(spark, monkeypatch):
    """A long and a short database of one number are one, whatever length is dealt to several tasks."""
    q, d = frames(spark, (2, "AC" * 20), (3, "ACA" * 9))
    want = rows(search(q, d, Q.LIVE)["uncrowded"])
    monkeypatch.setattr(packed, "LONG", 100)
    assert rows(search(q, d, Q.LIVE)["uncrowded"]) == want and len(want) > 1000


@pytest.mark.parametrize("p", [Diagonal(k=4), Search(k=4), Diagonal(k=3, match=1.0, mismatch=1.0, drop=0.0), Search(k=3, drop=4.0, match=1.5, mismatch=-0.75)])
def test_walks_are_looked_up(monkeypatch, p):
    """As letter by letter, near ends and beyond the letters that are looked up."""
    texts = pa.array([t for _, t in ODD if "N" not in t] + ["ACGGTCATTACGGATCAGT" * 4, "TTACGGTCATTACGCATCAGTACGGTCATT", "C" + "ACGGTCATTACGGATCAGT" * 3])
    n = np.ones(len(texts), np.int64)

    def grown():
        met = in_place.Meeting(texts, p)
        met.walked = met.meet(in_place.Letters(texts, 7), n, 0 * n, False)
        return met, in_place._grown(met.walked, met)

    met, got = grown()
    assert met.steps is not None and len(got.same) > 200
    monkeypatch.setattr(in_place, "_walk", lambda m, P, D, room, sign, rules: in_place.along(m.q.text, m.d.text, P, D, room, sign, *rules))
    _, want = grown()
    for side in ("left", "right"):
        assert all((getattr(got, side)[c] == getattr(want, side)[c]).all() for c in ("best", "at", "stop", "fell"))
    alike = got.q_end - got.q_at == got.d_end - got.d_at
    same = in_place._same(met.q.text, met.d.text, got.q_at[alike], got.d_at[alike], (got.q_end - got.q_at + 1)[alike])
    assert (got.score == want.score).all() and (got.same[alike] == same).all() and (got.same[~alike] == -1).all()
