"""Matches of k-mers between queries and databases.

A match is a row query_id, db_id, query_pos, db_pos, kmer. Matching is an
equi-join by k-mer; Spark broadcasts the smaller side by its size and splits
hot k-mers (low-complexity sequences) at run time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .packed import keys_of

PAIR = ["query_id", "db_id"]


def exact(query_kmers: DataFrame, db_kmers: DataFrame) -> DataFrame:
    q = query_kmers.select(F.col("seq_id").alias("query_id"), F.col("pos").alias("query_pos"), "kmer")
    d = db_kmers.select(F.col("seq_id").alias("db_id"), F.col("pos").alias("db_pos"), "kmer")
    return q.join(d, "kmer").select("query_id", "db_id", "query_pos", "db_pos", "kmer")


def numbered(matches: DataFrame) -> DataFrame:
    """match_id: the running number in the order of query_pos, db_pos."""
    return matches.withColumn("match_id", (F.row_number().over(W.partitionBy(*keys_of(matches)).orderBy("query_pos", "db_pos")) - 1).cast("long")).drop("task")


def unique_kmers(matches: DataFrame) -> DataFrame:
    return matches.groupBy(*PAIR).agg(F.countDistinct("kmer").alias("unique_kmers"))


def grouped(matches: DataFrame, by: str) -> DataFrame:
    """Matches of each value of ``by`` (kmer, query_pos or db_pos), in order."""
    return matches.groupBy(*PAIR, by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("query_pos", "db_pos"))).alias("matches"))


def of_kmer(matches: DataFrame, kmer: str) -> DataFrame:
    return matches.filter(F.col("kmer") == kmer.upper())


def in_region(matches: DataFrame, side: str, low: int | Column, high: int | Column, k: int) -> DataFrame:
    """Matches whose k-mer lies inside the region of ``side`` (query or db)."""
    pos = F.col(f"{side}_pos")
    return matches.filter((pos >= F.lit(low)) & (pos + k - 1 <= F.lit(high)))


def overlapping(matches: DataFrame) -> DataFrame:
    """Database positions with several matches."""
    return matches.groupBy(*PAIR, "db_pos").agg(F.count("*").alias("n")).filter("n > 1")


def density(matches: DataFrame, lengths: DataFrame, k: int, window: int = 10) -> DataFrame:
    """query_id, db_id, start, density of each window of the database: matches wholly inside over its width.

    ``lengths``: db_id, length. A match adds to the at most window - k + 1
    windows around it, so no range join is needed; windows without a match are
    filled in from the lengths.
    """
    pairs = matches.select(*PAIR).distinct().join(lengths, "db_id")
    spine = pairs.select(*PAIR, F.explode(F.when(F.col("length") >= window, F.sequence(F.lit(0).cast("long"), F.col("length") - window)).otherwise(F.array().cast("array<long>"))).alias("start"))
    reach = window - k
    if reach < 0:
        return spine.withColumn("density", F.lit(0.0))
    hits = matches.select(*PAIR, F.explode(F.sequence(F.col("db_pos") - reach, F.col("db_pos"))).alias("start")).groupBy(*PAIR, "start").agg(F.count("*").alias("n"))
    return spine.join(hits, [*PAIR, "start"], "left").select(*PAIR, "start", (F.coalesce("n", F.lit(0)) / F.lit(float(window))).alias("density"))


def dense_regions(densities: DataFrame, least: float = 0.3) -> DataFrame:
    return densities.filter(F.col("density") >= least)


def dense(matches: DataFrame, lengths: DataFrame | None, k: int, window: int = 10, least: float = 0.3) -> DataFrame:
    """``dense_regions`` of ``density`` for a positive ``least``, by a sweep.

    A match is in the windows that begin from ``window`` - k before it up to
    its place: one more at the first of these, one fewer after the last. Only
    windows that are dense enough are ever made. Rows may stand for ``n``
    matches of a place, may bring the ``length`` of their database, and stay in
    their task where they have one.
    """
    reach, keys = window - k, keys_of(matches)
    n = F.col("n") if "n" in matches.columns else F.lit(1)
    if "length" not in matches.columns:
        matches = matches.join(lengths, "db_id")
    ends = F.array(F.struct(F.greatest(F.col("db_pos") - reach, F.lit(0)).alias("start"), n.alias("step")), F.struct((F.col("db_pos") + 1).alias("start"), (-n).alias("step")))
    steps = matches.filter(F.lit(reach >= 0)).select(*keys, "length", F.explode(ends).alias("e")).groupBy(*keys, F.col("e.start").alias("start")).agg(F.sum("e.step").alias("step"), F.max("length").alias("length"))
    order = W.partitionBy(*keys).orderBy("start")
    inside = F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0))
    spans = steps.select(*PAIR, "start", F.lead("start").over(order).alias("next"), (inside / F.lit(float(window))).alias("density"), "length").filter(F.col("density") >= least)
    last = F.least(F.col("next") - 1, F.col("length") - window)
    return spans.filter(F.col("start") <= last).select(*PAIR, F.explode(F.sequence("start", last)).alias("start"), "density")


def diagonals(matches: DataFrame) -> DataFrame:
    return matches.withColumn("diagonal", F.col("db_pos") - F.col("query_pos")).groupBy(*PAIR, "diagonal").agg(
        F.count("*").alias("n"), F.min("query_pos").alias("min_query"), F.max("query_pos").alias("max_query"), F.min("db_pos").alias("min_db"), F.max("db_pos").alias("max_db")
    )


def statistics(matches: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Per pair: totals, distinct counts, the most frequent k-mer (ties: the one first seen last), coverage, diagonals."""
    by = matches.groupBy(*PAIR, "kmer").agg(F.count("*").alias("n"), F.min(F.struct("query_pos", "db_pos")).alias("seen"))
    top = by.groupBy(*PAIR).agg(F.max_by("kmer", F.struct("n", "seen")).alias("most_frequent"), F.count("*").alias("unique_kmers"))
    sums = matches.groupBy(*PAIR).agg(
        F.count("*").alias("total"), F.countDistinct("query_pos").alias("query_positions"), F.countDistinct("db_pos").alias("db_positions"), F.countDistinct(F.col("db_pos") - F.col("query_pos")).alias("diagonals")
    )
    out = sums.join(top, PAIR).join(lengths, "db_id")
    return out.select(*PAIR, "total", "unique_kmers", "query_positions", "db_positions", "diagonals", "most_frequent", F.try_divide("total", "unique_kmers").alias("average"), F.try_divide(F.col("db_positions") * k, F.col("length")).alias("coverage"))


def at_least(matches: DataFrame, n: int) -> DataFrame:
    """Matches of k-mers with ``n`` matches or more in the pair."""
    often = matches.groupBy(*PAIR, "kmer").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= n)
    return matches.join(often, [*PAIR, "kmer"]).select("query_id", "db_id", "query_pos", "db_pos", "kmer", "frequency")


def without_close(matches: DataFrame, max_gap: int = 1) -> DataFrame:
    """Matches in database order, but for those within ``max_gap`` in both positions of one already kept.

    The choice depends on what was kept before, so each pair's matches are read
    in order, batch by batch: a task holds the kept ones that are no more than
    ``max_gap`` letters back.
    """
    reach = range(-max_gap, max_gap + 1)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, kept = None, {}
        for batch in batches:
            stays = []
            for query, db, q, d in zip(*(batch[c].tolist() for c in (*PAIR, "query_pos", "db_pos"))):
                if (query, db) != pair:
                    pair, kept = (query, db), {}
                if kept and next(iter(kept)) < d - max_gap:  # in the order of places
                    kept = {at: own for at, own in kept.items() if at >= d - max_gap}
                stays.append(not any(q + i in own for own in kept.values() for i in reach))
                if stays[-1]:
                    kept.setdefault(d, set()).add(q)
            yield batch[pd.Series(stays, batch.index, dtype=bool)]

    keys = keys_of(matches)
    rows = matches.select(*keys, "query_pos", "db_pos", "kmer")
    if keys == PAIR:  # else a task holds all matches of its pairs
        rows = rows.repartition(*PAIR)
    rows = rows.sortWithinPartitions(*keys, "db_pos", "query_pos").select(*PAIR, "query_pos", "db_pos", "kmer")
    return rows.mapInPandas(scan, rows.schema)


def close_kmers(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Matches with at most one differing letter, k >= 2.

    Of two halves one must be equal, so both sides join by half and place of
    the half, and the other half is compared: never all with all.
    """
    from ..functions.sequences import hamming

    half = k // 2
    halves = lambda: F.explode(F.array(F.struct(F.lit(0).alias("no"), F.substring("kmer", 1, half).alias("part")), F.struct(F.lit(1).alias("no"), F.substring("kmer", half + 1, k - half).alias("part")))).alias("h")
    q = a.select(F.col("seq_id").alias("query_id"), F.col("pos").alias("query_pos"), F.col("kmer").alias("query_kmer"), halves()).select("*", "h.no", "h.part").drop("h")
    d = b.select(F.col("seq_id").alias("db_id"), F.col("pos").alias("db_pos"), F.col("kmer").alias("db_kmer"), halves()).select("*", "h.no", "h.part").drop("h")
    both = q.join(d, ["no", "part"]).filter((F.col("no") == 0) | (F.substring("query_kmer", 1, half) != F.substring("db_kmer", 1, half)))
    return both.filter(hamming("query_kmer", "db_kmer") <= 1).select("query_id", "db_id", "query_pos", "db_pos", "query_kmer", "db_kmer")
