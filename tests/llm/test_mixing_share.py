"""One stray row does not decide how much of a corpus is kept."""

from pyspark.sql import functions as F

from strandworks.llm import mixing


def share(docs):
    tokens = F.sum(mixing.token_weight(F.col("text")))
    return mixing.sample(docs).agg(tokens).first()[0] / docs.agg(tokens).first()[0]


def test_stray_row(spark):
    rows = [(i, "w " * (20 + i % 7), ("en", "de", "en")[i % 3], f"s{i % 4 // 2}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stray = spark.createDataFrame([(-1, "word", None, "stray")], docs.schema)
    plain, beside = share(docs), share(docs.union(stray))
    assert abs(plain - 1) < 0.05 and abs(beside - plain) < 0.02


def test_copies_meet_targets(spark):
    rows = [(i, "w " * 20, "en", "small" if i % 10 == 0 else "large") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.source: r["count"] for r in mixing.sample(docs, targets={"source": {"small": 1, "large": 1}}).groupBy("source").count().collect()}
    assert got["small"] == 1000 and abs(got["large"] - 1000) < 60


def test_many_copies_are_made_in_many_tasks(spark):
    rows = [(0, "word", "en", "small")] + [(i, "w " * 30, "en", "large") for i in range(1, 2001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.sample(docs, targets={"source": {"small": 1, "large": 1}}).withColumn("part", F.spark_partition_id())
    small = out.filter("source = 'small'")
    assert abs(small.count() - 31_000) < 1100 and out.filter("source = 'large'").count() > 800
    assert small.select("part").distinct().count() > 1


def test_stray_row_in_the_query(spark, tmp_path):
    from strandworks.llm import queries as Q

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{tmp_path}/plain/documents.parquet")
    docs.union(docs.limit(1).selectExpr("-1L", "'word'", "null", "'stray'", "4L")).write.parquet(f"{tmp_path}/stray/documents.parquet")
    shares = []
    for name in ("plain", "stray"):
        rows = Q.QUERIES["op1_mixing"](spark, f"{tmp_path}/{name}").filter("source <> 'stray'")
        shares.append(rows.agg(F.sum(F.col("copies") * F.col("n_tokens")) / F.sum("n_tokens")).first()[0])
    assert abs(shares[0] - shares[1]) < 0.01
