"""Seeds of short queries are extended in their task: as from chunks, without working tables or shuffles of seeds."""

import pytest
from pyspark.sql import functions as F

from strandworks import queries as Q
from strandworks.operators import extension
from strandworks.plans import search as plans
from strandworks.plans.search import search, search_by_diagonal
from strandworks.sources import tables

SF = "/root/testdata/sf0.001"


def frames(spark):
    return tables.queries_of(spark, SF).filter("seq_id % 8 = 0"), tables.databases_of(spark, SF)


@pytest.mark.parametrize("made", [lambda q, d: search(q, d, Q.LIVE), lambda q, d: search_by_diagonal(q, d, Q.BY_DIAGONAL)])
def test_as_from_chunks(spark, monkeypatch, made):
    got = made(*frames(spark))["extensions"]
    rows = got.collect()
    monkeypatch.setattr(plans, "EXTENDED_IN_TASK", 0)
    want = made(*frames(spark))["extensions"]
    assert want.columns == got.columns and len(rows) > 1000
    assert sorted(map(repr, rows)) == sorted(map(repr, want.collect()))


def test_no_working_tables_or_shuffles(spark, monkeypatch):
    def none(*_):
        raise AssertionError("seeds were written")

    monkeypatch.setattr(extension, "saved", none)
    plan = Q.QUERIES["diagonal_extensions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all("REPARTITION" in line for line in shuffles)  # the databases alone


def test_spans_of_unlike_lengths_and_ends(spark):
    told = extension._walks(2, -1, 1, None)
    df = spark.createDataFrame([("ACGTACG", "ACGTAC", 0, 0, 7, 6), ("TACGT", "GACGA", 1, 1, 3, 3)], "q string, d string, l int, r int, a int, b int")
    one, two = (r.t for r in df.select(told(F.col("q").cast("binary"), F.col("d").cast("binary"), "l", "r", "a", "b").alias("t")).collect())
    assert one.same is None and (one.left.at, one.right.stop) == (0, False)
    assert (two.same, two.left.best, two.right.at, two.left.stop) == (3, 0.0, 0, False)
