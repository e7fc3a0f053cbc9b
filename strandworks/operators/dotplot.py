"""Dotplots of pairs (pair_id, seq1, seq2): matches, lines and blocks on both strands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.sequences import chars, clean_dna, kmers, reverse_complement


def strands(pairs: DataFrame, window: int) -> DataFrame:
    """pair_id, strand, seq1, seq2: cleaned, with seq2 forward and as its reverse complement; too short pairs are left out."""
    clean = pairs.select("pair_id", clean_dna("seq1", window).alias("seq1"), clean_dna("seq2", window).alias("seq2")).filter("seq1 <> '' and seq2 <> ''")
    forward = clean.withColumn("strand", F.lit("forward"))
    return forward.unionByName(clean.withColumn("seq2", reverse_complement("seq2")).withColumn("strand", F.lit("reverse")))


def base_matches(rows: DataFrame) -> DataFrame:
    """pair_id, strand, i, j of all equal letters."""
    one = rows.select("pair_id", "strand", F.posexplode(chars("seq1")).alias("i", "base"))
    two = rows.select("pair_id", "strand", F.posexplode(chars("seq2")).alias("j", "base"))
    return one.join(two, ["pair_id", "strand", "base"]).select("pair_id", "strand", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


def seeded_matches(rows: DataFrame, window: int) -> DataFrame:
    """The letters of all equal windows: what ``base_matches`` keeps after lines, found by joining windows instead of letters."""
    one = rows.select("pair_id", "strand", F.explode(kmers("seq1", window)).alias("m")).select("pair_id", "strand", F.col("m.pos").alias("i"), "m.kmer")
    two = rows.select("pair_id", "strand", F.explode(kmers("seq2", window)).alias("m")).select("pair_id", "strand", F.col("m.pos").alias("j"), "m.kmer")
    met = one.join(two, ["pair_id", "strand", "kmer"])
    step = F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("t")
    return met.select("pair_id", "strand", "i", "j", step).select("pair_id", "strand", (F.col("i") + F.col("t")).cast("long").alias("i"), (F.col("j") + F.col("t")).cast("long").alias("j")).distinct()


def close_matches(rows: DataFrame, window: int) -> DataFrame:
    """The cells of all windows that differ in at most one letter; the differing cell counts too."""
    part = lambda c: rows.select("pair_id", "strand", F.explode(kmers(c, window)).alias("m")).select(F.struct("pair_id", "strand").alias("seq_id"), F.col("m.pos").alias("pos"), "m.kmer")
    met = close_in_pair(part("seq1"), part("seq2"), window)
    step = F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("t")
    return met.select("seq_id", "query_pos", "db_pos", step).select("seq_id.pair_id", "seq_id.strand", (F.col("query_pos") + F.col("t")).cast("long").alias("i"), (F.col("db_pos") + F.col("t")).cast("long").alias("j")).distinct()


def close_in_pair(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``close_kmers`` within the pair: halves join together with the pair."""
    from ..functions.sequences import hamming

    half = k // 2
    if half == 0:  # one letter: any two are within one mismatch
        q, d = a.select("seq_id", F.col("pos").alias("query_pos")), b.select("seq_id", F.col("pos").alias("db_pos"))
        return q.join(d, "seq_id")
    cut = F.explode(F.array(F.struct(F.lit(0).alias("no"), F.substring("kmer", 1, half).alias("part")), F.struct(F.lit(1).alias("no"), F.substring("kmer", half + 1, k - half).alias("part")))).alias("h")
    q = a.select("seq_id", F.col("pos").alias("query_pos"), F.col("kmer").alias("x"), cut).select("seq_id", "query_pos", "x", "h.no", "h.part")
    d = b.select("seq_id", F.col("pos").alias("db_pos"), F.col("kmer").alias("y"), cut).select("seq_id", "db_pos", "y", "h.no", "h.part")
    both = q.join(d, ["seq_id", "no", "part"]).filter((F.col("no") == 0) | (F.substring("x", 1, half) != F.substring("y", 1, half)))
    return both.filter(hamming("x", "y") <= 1).select("seq_id", "query_pos", "db_pos")


def lines(cells: DataFrame, window: int) -> DataFrame:
    """pair_id, strand, line_id, start1, start2, length: runs along a diagonal of at least ``window`` cells."""
    order = W.partitionBy("pair_id", "strand", "diagonal").orderBy("i")
    runs = cells.withColumn("diagonal", F.col("i") - F.col("j")).withColumn("island", F.col("i") - F.row_number().over(order))
    found = runs.groupBy("pair_id", "strand", "diagonal", "island").agg(F.min("i").alias("start1"), F.min("j").alias("start2"), F.count("*").alias("length")).filter(F.col("length") >= window)
    number = (F.row_number().over(W.partitionBy("pair_id", "strand").orderBy("start1", "start2")) - 1).cast("long")
    return found.withColumn("line_id", number).select("pair_id", "strand", "line_id", "start1", "start2", "length")


def cells_of(found: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """One row for each cell of a line, with the windows at the line's start."""
    both = found.join(rows, ["pair_id", "strand"])
    start = lambda s, c: F.substring(F.col(s), (F.col(c) + 1).cast("int"), F.lit(window))
    cells = both.select("pair_id", "strand", "line_id", "length", start("seq1", "start1").alias("kmer1"), start("seq2", "start2").alias("kmer2"), "start1", "start2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("t"))
    return cells.select("pair_id", "strand", "line_id", (F.col("start1") + F.col("t")).alias("i"), (F.col("start2") + F.col("t")).alias("j"), "kmer1", "kmer2", "length", (F.col("t") == 0).alias("line_start"), (F.col("t") == F.col("length") - 1).alias("line_end"))


def blocks(found: DataFrame) -> DataFrame:
    """Alignment blocks; on the reverse strand in coordinates of the reverse complement."""
    return found.select(
        "pair_id", "strand", "line_id", "start1", (F.col("start1") + F.col("length") - 1).alias("end1"), "start2", (F.col("start2") + F.col("length") - 1).alias("end2"),
        (F.col("strand") == "reverse").alias("is_reverse"), F.col("length").alias("score"), F.lit(1.0).alias("identity"),
    )


def forward_position(pos: Column, length: Column) -> Column:
    """From a place on the reverse complement to the place on the sequence."""
    return length - pos - 1


def block_table(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """1-based forward coordinates and lengths, for display; and spans of the polygons."""
    rows = block.join(pairs.select("pair_id", F.length(clean_dna("seq2")).cast("long").alias("length2")), "pair_id")
    back = lambda c: F.when(F.col("is_reverse"), forward_position(F.col(c), F.col("length2"))).otherwise(F.col(c))
    return rows.select(
        "pair_id", "strand", "line_id", (F.col("start1") + 1).alias("from1"), (F.col("end1") + 1).alias("to1"), (back("start2") + 1).alias("from2"), (back("end2") + 1).alias("to2"),
        (F.col("end1") - F.col("start1") + 1).alias("length_bp"), back("start2").alias("x1"), F.when(F.col("is_reverse"), back("end2")).otherwise(F.col("end2") + 1).alias("x2"),
    )


def statistics(found: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """Per pair: cells on lines of each strand, the number of window pairs, and the density in per cent, which may pass 100."""
    rows = pairs.select("pair_id", F.length(clean_dna("seq1", window)).cast("long").alias("length1"), F.length(clean_dna("seq2", window)).cast("long").alias("length2"))
    cells = lambda s: F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("length"))), F.lit(0).cast("long"))
    sums = found.groupBy("pair_id").agg(cells("forward").alias("forward_matches"), cells("reverse").alias("reverse_matches"))
    n = lambda c: F.greatest(F.col(c) - window + 1, F.lit(0).cast("long"))
    out = rows.join(sums, "pair_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("forward_matches", "reverse_matches")})
    out = out.withColumns({"total_matches": F.col("forward_matches") + F.col("reverse_matches"), "max_possible": n("length1") * n("length2") * 2})
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("total_matches") * 100.0, F.col("max_possible")), F.lit(0.0)))


def probe(cells: DataFrame, points: DataFrame, window: int) -> DataFrame:
    """For points (pair_id, x, y) the first cell, forward strand first, whose window covers the point.

    A point is met only with the cells of the window's width before it.
    """
    near = points.withColumn("i", F.explode(F.sequence(F.col("x") - window + 1, F.col("x")))).withColumn("j", F.explode(F.sequence(F.col("y") - window + 1, F.col("y"))))
    hit = near.join(cells, ["pair_id", "i", "j"])
    return hit.groupBy("pair_id", "x", "y").agg(F.min(F.struct("strand", "i", "j")).alias("first")).select("pair_id", "x", "y", "first.*")


def residue_dots(pairs: DataFrame, kind: str) -> DataFrame:
    """pair_id, i, j, similarity of all residues that are equal or, in proteins, of one group.

    Both sides lie in one row: their places by letter group meet there, so that
    no residue is shuffled or broadcast and no two unlike letters meet. Rows of
    one pair_id are one pair, as in a join of both sides.
    """
    from ..functions.sequences import CONSERVATIVE, conservative_group, residue_similarity

    group = lambda c: F.when(F.lit(kind == "PROTEIN") & c.isin(*"".join(CONSERVATIVE)), conservative_group(c)).otherwise(c)
    tasks = 8 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small pairs make many dots
    rows = pairs.filter("pair_id is not null").repartition(tasks, "pair_id").groupBy("pair_id").agg(F.collect_list("seq1").alias("all1"), F.collect_list("seq2").alias("all2"))
    rows = rows.select("pair_id", F.explode("all1").alias("seq1"), "all2").select("pair_id", "seq1", F.explode("all2").alias("seq2"))
    letter = lambda at, x: F.struct(at.cast("long").alias("at"), x.alias("x"), group(x).alias("g"))
    sides = {side: F.transform(chars(f"seq{side}"), lambda x, at: letter(at, x)) for side in (1, 2)}
    rows = rows.select("pair_id", *(c.alias(f"side{side}") for side, c in sides.items()))
    both = F.array_intersect(F.transform("side1", lambda r: r.g), F.transform("side2", lambda r: r.g))
    rows = rows.select("pair_id", "side1", "side2", F.explode(both).alias("g"))
    own = lambda side: F.filter(side, lambda r: r.g == F.col("g"))
    rows = rows.select("pair_id", own("side1").alias("one"), own("side2").alias("two")).select("pair_id", F.explode("one").alias("one"), "two").select("pair_id", "one", F.explode("two").alias("two"))
    similarity = residue_similarity(F.col("one.x"), F.col("two.x"), kind)
    return rows.select("pair_id", F.col("one.at").alias("i"), F.col("two.at").alias("j"), similarity.alias("similarity")).filter("similarity > 0")
