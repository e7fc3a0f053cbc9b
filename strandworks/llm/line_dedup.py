"""Line dedup: repeated runs of lines found by a suffix array over line ids.

Documents stand in the order of doc_id, each as its sequence of lines. A run
of consecutive lines of one document is deleted where the same run of at
least ``min_words`` words starts at an earlier line, in an earlier document
or in the same one; the first copy stays.

1. The sequence holds the lines that have words. Lines without any (blank
   ones) are kept as the gap after their line: as one hash between two lines,
   and as a hash of each beginning and each end of the gap for runs that end or
   start inside it. So a stretch of ``min_words`` words has at most that many
   lines, however many blank ones lie between.
2. Lines that occur once end every run; the others get names in sort order. A
   line and the gap after it get a second name in the same way.
3. Prefix doubling: the name of the 2**(k+1) lines from a line on is the rank
   of the pair of names at distance 2**k. Names of pairs that occur once are
   dropped, so each level holds only what still repeats. All suffixes of one
   name are a longest-common-prefix interval of depth 2**k or more.
4. A maximal repeated run is covered by its shortest stretches of
   ``min_words`` words, taken from each first and to each last line. The name
   of a stretch of n lines is its last line, and the pair of names of the first
   and the last 2**k lines before that, with 2**k the largest power up to
   n - 1. In each interval of equal stretches all but the earliest are deleted;
   what they cover is the later copies of the maximal runs.

Each step sorts, joins or aggregates by names or lines; only the lines of one
document are ever held together. Deleted stretches are merged to intervals,
and the text is cut by interval.

Defined results: null texts stay null and empty texts empty; a text without
line end is one line; rows equal in doc_id and text are one document and get
the same result; a null doc_id stands first; a document of which all lines go
has an empty text; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import in_small_batches, saved

MIN_WORDS = 50
_NONE = -(1 << 63)
KEY = ["own", "twin"]


def _own() -> list[Column]:
    """What names a document: its id, and a hash of the text for rows that share the id."""
    return [F.coalesce("doc_id", F.lit(_NONE)).alias("own"), F.xxhash64("text").alias("twin")]


def chain(lines: list[bytes]) -> list[int]:
    """A hash of each beginning of ``lines``."""
    out, last = [], 0
    for x in lines:
        last = xxhash.xxh3_64_intdigest(x, last)
        out.append(last >> 1)
    return out


def lines_of(docs: DataFrame) -> DataFrame:
    """own, twin, at, line, id, words of every line with words: its place among these and among all lines; and the gap after it.

    ``after``: hashes of the beginnings of the gap. ``before``: hashes of the
    ends of the gap before it, the shortest first. ``gap``: the whole gap after it.
    """
    schema = "own long, twin long, at long, line long, id binary, words long, gap long, after array<long>, before array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for o, t, text in zip(batch["own"].tolist(), batch["twin"].tolist(), batch["text"]):
                lines = text.encode().split(b"\n")
                words = [len(x.split()) for x in lines]
                full = [k for k, n in enumerate(words) if n]
                before = chain(lines[: full[0]][::-1]) if full else []
                for at, (k, then) in enumerate(zip(full, [*full[1:], len(lines)])):
                    after = chain(lines[k + 1 : then])
                    out.append((o, t, at, k, hashlib.blake2b(lines[k], digest_size=16).digest(), words[k], after[-1] if after else -1, after, before))
                    before = chain(lines[k + 1 : then][::-1]) if after else []
            yield pd.DataFrame(out, columns=["own", "twin", "at", "line", "id", "words", "gap", "after", "before"])

    return in_small_batches(docs).filter("text is not null").select(*_own(), "text").mapInPandas(run, schema)


def ranked(found: DataFrame, by: list[str]) -> DataFrame:
    """``found`` with ``name``: longs in the order of ``by``, dealt by a distributed sort."""
    return saved(found.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "line-names")


def stretches(repeated: DataFrame, min_words: int) -> DataFrame:
    """The shortest stretches of ``min_words`` words among neighbouring repeated lines.

    own, twin, at, n: the lines with words. line, m: all lines. last: the name
    of the last line with words. lead, tail: hashes of the blank lines before
    the first and after the last line with words, -1 if there are none.
    """
    schema = "own long, twin long, at long, n long, line long, m long, last long, lead long, tail long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, twin, rows in zip(batch["own"].tolist(), batch["twin"].tolist(), batch["rows"]):
                words, lines, names = [r["words"] for r in rows], [r["line"] for r in rows], [r["name"] for r in rows]
                found, first = set(), 0
                while first < len(rows):
                    end = first + 1  # a run goes on while the line and its gap repeat
                    while end < len(rows) and rows[end]["at"] == rows[end - 1]["at"] + 1 and rows[end - 1]["both"] is not None:
                        end += 1
                    start, total = first, 0
                    for last in range(first, end):  # to each last line
                        total += words[last]
                        while total - words[start] >= min_words:
                            total -= words[start]
                            start += 1
                        if total >= min_words:
                            found |= {(start, last, 0, k) for k in range(len(rows[last]["after"]) + 1)}
                    last, total = end - 1, 0
                    for start in range(end - 1, first - 1, -1):  # from each first line
                        total += words[start]
                        while total - words[last] >= min_words:
                            total -= words[last]
                            last -= 1
                        if total >= min_words:
                            found |= {(start, last, k, 0) for k in range(len(rows[start]["before"]) + 1)}
                    first = end
                for a, z, lead, tail in found:
                    before, after = rows[a]["before"], rows[z]["after"]
                    out.append((own, twin, rows[a]["at"], z - a + 1, lines[a] - lead, lines[z] - lines[a] + 1 + lead + tail, names[z], before[lead - 1] if lead else -1, after[tail - 1] if tail else -1))
            if out:
                yield pd.DataFrame(out, columns=["own", "twin", "at", "n", "line", "m", "last", "lead", "tail"])

    return repeated.select(*KEY, "rows").mapInPandas(run, schema)


def deleted_intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """own, twin, gone: the intervals (from, to) of lines of each document that are later copies, in order and apart from each other."""
    lines = saved(lines_of(docs), "lines")
    twice = lines.groupBy("id").agg(F.count("*").alias("times")).filter("times > 1")
    level = saved(lines.join(ranked(twice, ["id"]), "id").drop("id"), "line-repeats")
    twice = level.groupBy("name", "gap").agg(F.count("*").alias("times")).filter("times > 1")
    both = ranked(twice.withColumnRenamed("name", "alone"), ["alone", "gap"]).select(F.col("alone").alias("name"), "gap", F.col("name").alias("both"))
    level = level.join(both, ["name", "gap"], "left")
    rows = F.sort_array(F.collect_set(F.struct("at", "line", "name", "both", "words", "after", "before")))
    repeated = saved(level.groupBy(*KEY).agg(rows.alias("rows")), "line-rows")
    wanted = saved(stretches(repeated, min_words), "line-stretches")
    longest = (wanted.agg(F.max("n")).first()[0] or 0) - 1  # one number
    key = [*KEY, "line", "m", "n", "last", "lead", "tail"]
    first = [wanted.filter("n = 1").select(*key, F.lit(-1).cast("long").alias("name"), F.lit(-1).cast("long").alias("last_name"))]
    level = saved(repeated.select(*KEY, F.explode("rows").alias("r")).filter("r.both is not null").select(*KEY, "r.at", F.col("r.both").alias("name")), "line-level")
    k = 0
    while 1 << k <= longest:
        width = 1 << k
        own = wanted.filter((F.col("n") - 1).between(width, 2 * width - 1))
        heads = own.join(level, [*KEY, "at"])
        tails = level.select(*KEY, (F.col("at") + width).alias("end"), F.col("name").alias("last_name"))
        named = heads.withColumn("end", F.col("at") + F.col("n") - 1).join(tails, [*KEY, "end"]).select(*key, "name", "last_name")
        first.append(saved(named, "line-stretch-names"))
        k += 1
        if 1 << k <= longest:
            after = level.select(*KEY, (F.col("at") - width).alias("at"), F.col("name").alias("then"))
            pairs = level.join(after, [*KEY, "at"])
            more = pairs.groupBy("name", "then").agg(F.count("*").alias("times")).filter("times > 1")
            up = ranked(more.withColumnRenamed("name", "head"), ["head", "then"])
            level = saved(pairs.withColumnRenamed("name", "head").join(up, ["head", "then"]).select(*KEY, "at", "name"), "line-level")
    same = ["n", "m", "name", "last_name", "last", "lead", "tail"]
    dead = None
    for part in first:
        earliest = part.groupBy(*same).agg(F.min(F.struct(*KEY, "line")).alias("earliest"), F.count("*").alias("times")).filter("times > 1").drop("times")
        earliest = saved(earliest, "line-earliest")  # apart from the join, so that Spark can split a hot stretch there
        later = part.join(earliest, same).filter(F.struct(*KEY, "line") > F.col("earliest")).select(*KEY, "line", (F.col("line") + F.col("m")).alias("end"))
        dead = later if dead is None else dead.union(later)
    return merged(dead)


def merged(stretches: DataFrame) -> DataFrame:
    """The union of the stretches (line, end) of each document, as intervals."""
    order = W.partitionBy(*KEY).orderBy("line", "end")
    reached = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum("new_").over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = stretches.withColumn("new_", F.coalesce(F.col("line") > reached, F.lit(True)).cast("int")).withColumn("island", island)
    each = rows.groupBy(*KEY, "island").agg(F.struct(F.min("line").cast("int").alias("from"), F.max("end").cast("int").alias("to")).alias("x"))
    return each.groupBy(*KEY).agg(F.sort_array(F.collect_list("x")).alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies cut from ``text``, and ``line_dedup_``: n_lines, n_removed."""
    gone = deleted_intervals(docs, min_words).select(F.struct("own", "twin").alias("line_key_"), F.col("gone").alias("line_gone_")).hint("shuffle_hash")
    both = docs.withColumn("line_key_", F.struct(*_own())).join(gone, "line_key_", "left")
    both = both.withColumn("line_all_", F.when(F.col("line_gone_").isNotNull(), F.split("text", "\n", -1)))  # a column of its own, so that it is split once
    lines = F.col("line_all_")
    starts = F.concat(F.array(F.lit(0)), F.transform("line_gone_", lambda x: x["to"]))
    ends = F.concat(F.transform("line_gone_", lambda x: x["from"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    text = F.when(F.col("line_gone_").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    removed = F.coalesce(F.aggregate("line_gone_", F.lit(0), lambda s, x: s + x["to"] - x["from"]), F.lit(0))
    report = F.struct(n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
    return both.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), report.alias("line_dedup_"))


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of runs, and without the documents of which nothing is left."""
    out = dedup_lines(docs, min_words)
    left = (F.col("line_dedup_.n_removed") == 0) | (F.col("line_dedup_.n_removed") < F.col("line_dedup_.n_lines"))
    return out.filter(left).drop("line_dedup_")
