"""Importance resampling towards a target distribution, by hashed n-grams of words.

1. Texts of a partition, up to CHUNK bytes at once, become one sequence of word
   ids with gaps between documents. A suffix array of it, sorted as far as the
   longest n-gram, and the longest common prefixes of neighbours give runs: all
   places of one n-gram. Each run is hashed once, and its bucket is scattered
   to its places.
2. Counts of each bucket over the whole corpus and the whole target give the
   bucket's gain; BUCKETS rows come to the driver.
3. The second pass over the texts finds the runs again and adds up the gains of
   each document.
4. Ranks: rows sorted by ranges of score, numbered within their range, plus the
   rows of the ranges before. No window over all rows.

Defined results: words are runs of a-z, 0-9 and all beyond ASCII, after A-Z are
lower-cased; texts longer than CHUNK are read in pieces that share a word, with
the same features; null and empty texts have no features and weight 0; a
document without an id has no score and isn't drawn or counted; rows of the
same id are documents of their own with the same draw of chance; an empty table
gives an empty result, an empty target equal gains by (s + 1); further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_text, in_small_batches, saved

BUCKETS, LONGEST = 10_000, 2
#: Documents with fewer words are scored, but not drawn.
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of text that share one suffix array.
CHUNK = 4 << 20
#: Ranges of scores for each shuffle partition.
RANGES = 4

#: Each byte as it is in a word, or a blank.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: object) -> bytes:
    """The text in UTF-8 with every byte outside words as a blank."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD) if isinstance(text, str) else b""


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of about CHUNK bytes that end where a word ends."""
    start = 0
    while start < len(text):
        stop = start + CHUNK
        if stop < len(text):
            stop = next_ if (next_ := text.find(b" ", stop)) >= 0 else len(text)
        yield text[start:stop]
        start = stop


def suffix_array(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ids`` sorted by the ``longest`` ids from there on, and how many of these each shares with the place sorted before it.

    A negative id is a gap: it ends what is shared. Sorting goes on from names
    of twice the length, as long as these are shorter than ``longest``.
    """
    name, width = ids, 1
    n = len(ids)
    order = np.argsort(name)
    while width < longest:
        step = min(width, longest - width)
        following = np.full(n, -1, np.int64)
        following[: n - step] = name[step:]
        key = name * (int(following.max(initial=0)) + 2) + following + 1
        order = np.argsort(key)
        width += step
        if width < longest:
            named = key[order]
            name = np.zeros(n, np.int64)
            name[order[1:]] = np.cumsum(named[1:] != named[:-1])
    shared, alive = np.zeros(n, np.int8), np.ones(max(n - 1, 0), bool)
    padded = np.concatenate((ids, np.full(longest, -1, np.int64)))
    for k in range(longest):
        own = padded[order + k]
        alive &= (own[1:] == own[:-1]) & (own[1:] >= 0)
        shared[1:] += alive
    return order, shared


def occurrences(texts: list[bytes], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document and bucket of every n-gram, and the words of each document, chunk by chunk."""
    group: list[tuple[int, bytes, list[bytes]]] = []
    size = 0
    for i, text in enumerate(texts):
        tail: list[bytes] = []
        for piece in _pieces(text):
            words = piece.split()
            group.append((i, tail, words))
            size += len(piece)
            tail = (tail + words)[1 - longest :] if longest > 1 else []
            if size >= CHUNK:
                yield _chunk(group, len(texts), longest)
                group, size = [], 0
    if group:
        yield _chunk(group, len(texts), longest)


def _chunk(group: list[tuple[int, list[bytes], list[bytes]]], n: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    sizes = np.array([len(tail) + len(words) + 1 for _, tail, words in group])
    ids = np.full(int(sizes.sum()), -1, np.int64)
    fresh = np.zeros(len(ids), bool)  # words that no piece before has counted
    at = 0
    for (_, tail, words), size in zip(group, sizes.tolist()):
        both = tail + words if tail else words
        ids[at : at + size - 1] = np.fromiter(map(vocabulary.__getitem__, both), np.int64, size - 1)
        fresh[at + len(tail) : at + size - 1] = True
        at += size
    owner = np.repeat(np.array([g[0] for g in group]), sizes)
    counted = np.bincount(owner[fresh], minlength=n)
    hashes = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary))
    after = [b" " + word for word in vocabulary]
    order, shared = suffix_array(ids, longest)
    padded, inside = np.concatenate((ids, np.full(longest, -1, np.int64))), np.ones(len(ids), bool)
    places, buckets = [], []
    for length in range(1, longest + 1):
        inside &= padded[order + length - 1] >= 0  # no gap before the n-gram's end
        starts = (shared < length)[inside]
        if not len(starts):
            break
        mine = order[inside]
        run = np.cumsum(starts) - 1
        heads = mine[starts]
        hashed = hashes[ids[heads]]
        for k in range(1, length):
            hashed = np.fromiter(map(zlib.crc32, map(after.__getitem__, ids[heads + k].tolist()), hashed.tolist()), np.int64, len(heads))
        hashed %= BUCKETS
        new = fresh[mine + length - 1]  # its last word is new in this piece
        places.append(mine[new])
        buckets.append(hashed[run][new])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counted
    return owner[np.concatenate(places)], np.concatenate(buckets), counted


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many n-grams of column ``text`` fall into each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, buckets, _ in occurrences([words_of(t) for t in batch["text"]]):
                total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    found = in_small_batches(texts).select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The smoothed log ratio of target to source of each bucket, in whole thousandths."""
    ratio = (target + 1.0) * float(source.sum() + BUCKETS) / ((source + 1.0) * float(target.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean of its features' gains) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, features, total = (np.zeros(len(batch), np.int64) for _ in range(3))
            for owner, buckets, counted in occurrences([words_of(t) for t in batch["text"]]):
                words += counted
                features += np.bincount(owner, minlength=len(batch))
                total += np.bincount(owner, weights=shared.value[buckets], minlength=len(batch)).astype(np.int64)  # whole numbers far below 2^53
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": words, "n_features": features, "weight": np.floor_divide(total, np.maximum(features, 1))})

    rows = in_small_batches(docs).select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, n_words long, n_features long, weight long")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def chance(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw of the id, in whole thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their rank from 1 in this order: dealt by ranges, numbered in each, plus the rows of the ranges before."""
    n = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()), "resampling-ranges")
    before = F.sum("rows_").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1))
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("rows_")).select("range_", F.coalesce(before, F.lit(0)).alias("before_"))  # one row a range
    numbered = dealt.withColumn("number_", F.row_number().over(W.partitionBy("range_").orderBy(*order)))
    return numbered.join(F.broadcast(sizes), "range_").withColumn("rank", F.col("before_") + F.col("number_")).drop("range_", "before_", "number_")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``: its likeness to the texts of ``target`` with a draw of chance, and its place if it is drawn."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    scored = weighed(docs, gains).withColumn("score", F.col("weight") + chance(F.col("doc_id"), seed))
    scored = saved(scored, "resampling-scores")
    able = (F.col("n_words") >= MIN_WORDS) & F.col("doc_id").isNotNull()
    drawn = scored.filter(able).count() * percent // 100
    places = ranked(scored.filter(able), F.desc("score"), F.col("doc_id"))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    place = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return places.select(*rest.columns).union(rest).select("doc_id", "n_features", "weight", "score", place)


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn; rows of a drawn id stay together."""
    ids = resample(docs, target, percent, seed).filter("rank is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
