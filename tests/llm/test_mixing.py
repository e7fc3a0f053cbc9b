from pyspark.sql import functions as F

from strandworks.llm import mixing
from strandworks.llm import queries as Q

from ..oracle import check
from .helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    check(spark, SF, Q.QUERIES["op1_mixing"], Q.ORACLE_SQL["op1_mixing"])


def test_margins_meet_targets(spark):
    rows = [(i, "w " * (5 + i % 7) + ("me@x" if i % 5 == 0 else ""), "en" if i % 4 else "de", f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 1, "s1": 2, "s2": 1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.7, "contact": 0.3}}
    m = mixing.mix(docs, targets, rounds=30)
    mass = F.sum(F.col("mix_.prob") * F.col("mix_.n_tokens"))
    for dim, want in targets.items():
        got = {r[0]: r[1] for r in m.groupBy(f"mix_.{dim}").agg(mass).collect()}
        total, norm = sum(got.values()), sum(want.values())
        assert all(abs(got[k] / total - v / norm) < 1e-4 for k, v in want.items())
    assert m.agg(F.max("mix_.prob")).first()[0] == 1.0


def test_repeats_and_zero_targets(spark):
    docs = edge_docs(spark)
    a, b = ([r.doc_id for r in mixing.sample(docs).collect()] for _ in range(2))
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert mixing.sample(docs).columns == docs.columns
    none = mixing.mix(docs, {"source": {"s0": 1, "s1": 0, "": 1}})
    assert not none.filter("mix_.source = 's1' and mix_.kept").count()


def test_edges(spark):
    assert mixing.mix(edge_docs(spark)).count() == edge_docs(spark).count()
    assert mixing.mix(empty_docs(spark)).count() == 0
