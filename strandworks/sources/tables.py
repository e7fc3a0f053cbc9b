"""Sources: sequences and pairs from tables and FASTA files, and the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequences import clean_dna


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(rows: DataFrame, number: str, text: str) -> DataFrame:
    """seq_id, seq: the DNA letters of a text column."""
    return rows.select(F.col(number).alias("seq_id"), clean_dna(F.coalesce(F.col(text), F.lit(""))).alias("seq"))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "benchmark"), "item_id", "text")


def databases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"), "doc_id", "text")


def item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, seq1, seq2: DNA letters of each item and of the next one, found by a join of numbers."""
    s = queries_of(spark, sf_dir).filter("seq <> ''")
    a = s.select(F.col("seq_id").alias("pair_id"), F.col("seq").alias("seq1"))
    return a.join(s.select((F.col("seq_id") - 1).alias("pair_id"), F.col("seq").alias("seq2")), "pair_id")


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, seq1, seq2: the names of each part and of the next one of the brand, in capitals without blanks."""
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), "p_brand", name.alias("seq1"))
    return rows.withColumn("seq2", F.lead("seq1").over(W.partitionBy("p_brand").orderBy("pair_id"))).filter("seq2 is not null").select("pair_id", "seq1", "seq2")


def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, seq: the first letters of each user's events in order of time; all are residues."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.upper(F.substring("event_type", 1, 1)).alias("letter"))
    log = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "letter"))).alias("log"))
    return log.select(F.col("user_id").alias("seq_id"), F.array_join(F.transform("log", lambda x: x.letter), "").alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of the records of FASTA files."""
    rows = spark.read.text(path, lineSep=">").filter(F.length(F.trim("value")) > 0)
    return rows.select(F.trim(F.substring_index("value", "\n", 1)).alias("name"), F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "").alias("seq"))
