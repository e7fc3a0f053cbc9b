"""K-mers of a table of sequences (seq_id, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import sequences as S

#: Letters of the sequences of a partition: partitions grow in number, not in size.
LETTERS = 1 << 20


def dealt(sequences: DataFrame) -> DataFrame:
    """Sequences in partitions by number, as many as their letters (which are counted) need: their k-mers are then counted where they are."""
    letters = sequences.agg(F.sum(F.length("seq"))).first()[0] or 0
    least = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sequences.repartition(max(least, -(-letters // LETTERS)), "seq_id")


def generate(sequences: DataFrame, k: int) -> DataFrame:
    """seq_id, pos, end_pos, kmer of all overlapping k-mers."""
    rows = sequences.select("seq_id", F.explode(S.kmers("seq", k)).alias("m"))
    return rows.select("seq_id", F.col("m.pos").cast("long").alias("pos"), (F.col("m.pos") + k - 1).cast("long").alias("end_pos"), "m.kmer")


def frequencies(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("seq_id", "kmer").agg(F.count("*").alias("frequency"))


def counted(kmers: DataFrame) -> DataFrame:
    """Each different k-mer once: how often it occurs and where first."""
    return kmers.groupBy("seq_id", "kmer").agg(F.count("*").alias("frequency"), F.min("pos").alias("pos"))


def with_frequency(kmers: DataFrame) -> DataFrame:
    """Each k-mer with its frequency in the sequence; a window over one sequence's k-mer."""
    n = F.count("*").over(W.partitionBy("seq_id", "kmer"))
    return kmers.withColumn("frequency", n).withColumn("is_unique", F.col("frequency") == 1)


def distinct(kmers: DataFrame) -> DataFrame:
    """The first occurrence of each."""
    return kmers.groupBy("seq_id", "kmer").agg(F.min("pos").alias("pos"), F.min("end_pos").alias("end_pos"))


def containing(kmers: DataFrame, letter: str) -> DataFrame:
    return kmers.filter(F.contains("kmer", F.lit(letter.upper())))


def at(kmers: DataFrame, pos: int | Column) -> DataFrame:
    return kmers.filter(F.col("pos") == F.lit(pos))


def covering(kmers: DataFrame, pos: int | Column) -> DataFrame:
    return kmers.filter(F.lit(pos).between(F.col("pos"), F.col("end_pos")))


def statistics(kmers: DataFrame) -> DataFrame:
    """Per sequence: totals, the most common k-mers with all ties, mean frequency, complexity."""
    each = F.collect_list(F.struct("frequency", "kmer"))  # the different k-mers of one sequence
    sums = frequencies(kmers).groupBy("seq_id").agg(F.sum("frequency").alias("total"), F.count("*").alias("unique"), F.max("frequency").alias("max_frequency"), each.alias("each"))
    common = F.transform(F.filter("each", lambda x: x.frequency == F.col("max_frequency")), lambda x: x.kmer)
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return sums.select(
        "seq_id", "total", "unique", (F.col("total") - F.col("unique")).alias("duplicate"), "max_frequency", F.array_join(F.sort_array(common), ",").alias("most_common"),
        ratio("total", "unique").alias("average_frequency"), ratio("unique", "total").alias("complexity_ratio"),
    )
