"""Live seeds of few queries come from rows of places: no row is sorted for each match."""

import pytest

from strandworks import queries as Q
from strandworks.operators import ordered, packed, seeds
from strandworks.params import Search
from strandworks.plans.search import search
from strandworks.sources import tables

SF = "/root/testdata/sf0.001"


def test_no_match_is_sorted(spark):
    plan = Q.live_seeds(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lag(" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("p", [Search(k=6), Search(k=4, max_gap=0, min_matches=1), Search(k=5, max_gap=3, min_matches=3)])
def test_batches_pieces_and_shares(spark, monkeypatch, p):
    """Runs go on from batch to batch; long databases are shared by tasks, and two databases or queries may have one number, or none."""
    monkeypatch.setattr(ordered, "PIECE", 2)
    monkeypatch.setattr(packed, "LONG", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        q, d = tables.queries_of(spark, SF).filter("seq_id % 8 = 0"), tables.databases_of(spark, SF).filter("seq_id % 40 = 0")
        low = spark.createDataFrame([(1, "A" * 90 + "C" + "A" * 90), (1, "ACA" * 40), (None, "A" * 40)], "seq_id long, seq string")
        q, d = q.union(low), d.union(low)
        want = seeds.live(search(q, d, p)["dealt"], p)
        got = ordered.seeds(q, d, 5, p).select(want.columns)
        rows = sorted(map(repr, got.drop("task").collect()))
        assert len(rows) > 300 and rows == sorted(map(repr, want.drop("task").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
