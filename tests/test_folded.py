"""What is known for each k-mer or each place of a pair is told without a row, or a shuffle, for each match."""

import pytest

from strandworks import queries as Q
from strandworks.operators import kmers, matches, packed
from strandworks.plans.search import search
from strandworks.sources import tables

SF = "/root/testdata/sf0.001"
#: Queries whose matches were shuffled by pair.
LOCAL = [
    "matches_by_kmer",
    "unique_matching_kmers",
    "overlapping_matches",
    "matches_by_query_position",
    "matches_by_db_position",
    "match_diagonals",
    "frequent_matches",
    "dense_match_regions",
    "matches_without_close",
]


def shuffles_of_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "db_id#" in line]


@pytest.mark.parametrize("name", LOCAL)
def test_matches_stay_in_their_task(spark, name):
    assert not shuffles_of_pairs(Q.QUERIES[name](spark, SF))


def test_partitions_grow_in_number(spark, monkeypatch):
    q, d = tables.queries_of(spark, SF), tables.databases_of(spark, SF)
    least = packed.partitions(q, d)
    monkeypatch.setattr(packed, "CELLS", 1 << 17)
    many = packed.partitions(q, d)
    assert many > 10 * least
    assert packed.met(q, d, 6, few=True).rdd.getNumPartitions() == many


def test_numbers_of_matches_come_from_few_rows(spark):
    stages = search(tables.queries_of(spark, SF), tables.databases_of(spark, SF), Q.LIVE)
    want = matches.numbered(stages["dealt"])
    got = packed.numbered(stages["by_query"]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 3 * stages["by_query"].count() < stages["dealt"].count()


def test_matrices_are_dealt(spark):
    """Small tables of pairs make many cells: more than one task has to make them."""
    assert Q.score_matrix_cells(spark, SF).rdd.getNumPartitions() >= 32


def test_kmers_are_counted_where_they_are(spark, monkeypatch):
    plan = Q.kmer_frequencies(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "kmer#" in line]
    monkeypatch.setattr(kmers, "LETTERS", 1 << 10)
    assert kmers.dealt(tables.databases_of(spark, SF)).rdd.getNumPartitions() > 20
