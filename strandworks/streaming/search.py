"""Streams: databases that arrive are searched by a fixed set of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import kmers
from ..operators import kmers as K


def stream_matches(arriving: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Matches of a stream (seq_id, seq) with static queries: a stream-static equi-join, stateless."""
    d = arriving.select(F.col("seq_id").alias("db_id"), F.explode(kmers("seq", k)).alias("m")).select("db_id", F.col("m.pos").cast("long").alias("db_pos"), "m.kmer")
    q = K.generate(queries, k).select(F.col("seq_id").alias("query_id"), F.col("pos").alias("query_pos"), "kmer")
    return d.join(q, "kmer").select("query_id", "db_id", "query_pos", "db_pos", "kmer")
