"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is brought to least distance: vectors get one component
more, so that all have the largest norm, and queries are scaled to it. Each of
TABLES tables hashes by HASHES random projections cut into cells of width
WIDTH (in units of that norm). A query visits its own bucket and perturbed
ones in the order of the estimated probability that they hold a neighbour,
until these add up to SUCCESS in each table; a neighbour's distance is taken
from the exact distances of SAMPLE queries. A query whose k-th found vector
lies farther than that goes again with the distance found as its own, which
its true neighbours cannot exceed; one that found fewer than k visits all
buckets. The k-th best score of the first table is the least that the other
tables return, and that of all tables the least for second visits. Candidates
of all tables are ranked by the exact inner product of the original vectors. Vectors of each length are a space of their own, with its
own norm, distance and projections.

Vectors are indexed by table and bucket; buckets are dealt to segments by
hash, and those of over SEGMENT vectors are split over as many segments as
needed, so no task ever holds a hot bucket whole. A segment goes to the blocks
of at most QUERY_BLOCK queries that visit it, and to none if none does.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; a query meets the vectors of its own length; a query's
own id is no candidate; rows that share a vec_id count once, with their best
score; of queries that share a vec_id the least vector asks; ties go to the
smaller vec_id; with fewer candidates than ``k`` all are returned; an empty
table gives an empty result; further columns are ignored. To the driver come a
few numbers and SAMPLE queries for each length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved
from .vectors import best_of, matrix, one_each, usable

TABLES, HASHES, WIDTH, SUCCESS = 4, 6, 1.6, 0.45
SPREAD = 4  # standard deviations that probes reach to either side
STRETCH = 1024  # vectors that a query of all buckets meets at once
SAMPLE, QUANTILE, SEGMENT, QUERY_BLOCK, SEED = 64, 0.8, 16_384, 16_384, 11


class Projections:
    """The projections of all tables, fixed by SEED and the number of components."""

    def __init__(self, dims: int, norm: float, hashes: int = HASHES, tables: int = TABLES, width: float = WIDTH):
        rng = np.random.default_rng(SEED)
        self.norm, self.width = norm, width * norm
        self.a = rng.standard_normal((tables, dims + 1, hashes))
        self.b = rng.uniform(0, self.width, (tables, hashes))
        self.mix = rng.integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))[:, None]), axis=1)

    def scaled(self, q: np.ndarray) -> np.ndarray:
        q = q * (self.norm / np.sqrt((q * q).sum(axis=1)))[:, None]
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1)

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.a[table] + self.b[table]

    def code(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells * self.mix).sum(axis=-1)


def probes(cell: np.ndarray, place: np.ndarray, width: float, distance: float, success: float) -> np.ndarray:
    """Cells in descending probability of holding a neighbour, until they add up to ``success``.

    The projections are taken in two halves; the steps of each half are sorted
    by their own probability, and a heap yields their products in descending order.
    """
    reach = int(SPREAD * distance / width) + 1
    steps, halves = range(-reach, reach + 1), []
    for half in (range(len(cell) // 2), range(len(cell) // 2, len(cell))):
        chance, at = np.ones(1), np.zeros((1, 0), np.int64)
        for j in half:
            cuts = [erf(((cell[j] + s) * width - place[j]) / (distance * sqrt(2))) / 2 for s in range(-reach, reach + 2)]
            at = np.concatenate((np.repeat(at, len(steps), axis=0), np.tile(cell[j] + np.array(steps), len(at))[:, None]), axis=1)
            chance = np.multiply.outer(chance, np.diff(cuts)).ravel()
        order = np.argsort(-chance, kind="stable")
        order = order[chance[order] > 0]
        halves.append((chance[order].tolist(), at[order]))
    (one, left), (two, right) = halves
    heap, out, total = [(-one[0] * two[0], 0, 0)], [], 0.0
    while heap and total < success:
        less, i, j = heapq.heappop(heap)
        out.append((i, j))
        total -= less
        if j + 1 < len(two):
            heapq.heappush(heap, (-one[i] * two[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (-one[i + 1] * two[0], i + 1, 0))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return np.concatenate((left[pairs[:, 0]], right[pairs[:, 1]]), axis=1)


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of vector."""
    dims = batch["embedding"].value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


@dataclass(frozen=True)
class Space:
    """What holds for all vectors of one length."""

    norm: float
    segments: int
    distance: float = 0.0


def spaces(good: DataFrame, asked: DataFrame, k: int) -> dict[int, Space]:
    """The norm of each length, and the distance within which QUANTILE of SAMPLE queries have their k-th neighbour, over all rows."""
    found = {r["dims"]: Space(sqrt(r["square"]), max(1, -(-r["n"] // SEGMENT))) for r in good.groupBy("dims").agg(F.count("*").alias("n"), F.max("square").alias("square")).collect()}
    first = W.partitionBy("dims").orderBy(F.xxhash64("vec_id"), "vec_id")
    picked = asked.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE).select("dims", "vec_id", "embedding").collect()  # SAMPLE rows of each length
    samples = {}
    for d in {r["dims"] for r in picked}:
        own = [r for r in picked if r["dims"] == d]
        q = np.array([r["embedding"] for r in own], np.float64)
        samples[d] = np.array([r["vec_id"] for r in own], np.int64), q * (found[d].norm / np.sqrt((q * q).sum(axis=1)))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                if d not in samples:
                    continue
                ids, q = samples[d]
                s = q @ matrix(part["embedding"]).T
                s[ids[:, None] == part["vec_id"].to_numpy()[None, :]] = -np.inf
                keep = min(k, s.shape[1])
                at = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                top = np.take_along_axis(s, at, axis=1).ravel()
                rows = [np.full(len(top), d, np.int32), np.repeat(ids, keep), part["vec_id"].to_numpy()[at].ravel(), top]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["dims", "query_id", "vec_id", "score"])

    scores = good.select("vec_id", "embedding").mapInArrow(run, "dims int, query_id long, vec_id long, score double").filter(F.col("score") > float("-inf"))
    best = W.partitionBy("dims", "query_id").orderBy(F.desc("score"))
    best = scores.groupBy("dims", "query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    low = best.groupBy("dims", "query_id").agg(F.min("score").alias("score")).groupBy("dims").agg(F.percentile("score", F.lit(1 - QUANTILE)).alias("low"))
    lows = {r["dims"]: r["low"] for r in low.collect()}  # one number of each length
    far = lambda norm, s: max(sqrt(max(2 * norm * norm - 2 * norm * s, 0.0)), 0.05 * norm)
    return {d: replace(x, distance=far(x.norm, lows.get(d, 0.0))) for d, x in found.items()}


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, success: float = SUCCESS) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of ``vectors`` where ``is_query`` holds."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    good = usable(vectors).withColumn("square", square).filter("square > 0").withColumn("dims", F.size("embedding"))
    asked = saved(one_each(good.filter(is_query)).withColumn("dims", F.size("embedding")), "ann-queries")
    space = spaces(good, asked, k)
    cut = {d: Projections(d, x.norm, hashes, tables, width) for d, x in space.items()}

    def index(batches: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                x = cut[d].lifted(matrix(part["embedding"]))
                for t in some:
                    code = cut[d].code(np.floor(cut[d].places(x, t) / cut[d].width).astype(np.int64))
                    fixed = [pa.array(np.full(len(x), v, np.int32)) for v in (d, t, space[d].segments)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(code), part["vec_id"], part["embedding"]], ["dims", "table", "segments", "bucket", "vec_id", "embedding"])

    def visits(batches: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                c = cut[d]
                q, reach = c.scaled(matrix(part["embedding"])), part["reach"].to_pylist()
                for t in some:
                    place = c.places(q, t)
                    cell = np.floor(place / c.width).astype(np.int64)
                    lists = [c.code(probes(*x, c.width, r, success)) for *x, r in zip(cell, place, reach)]
                    sizes, codes = [len(x) for x in lists], np.concatenate(lists)
                    fixed = [pa.array(np.full(len(codes), v, np.int32)) for v in (d, t, space[d].segments)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(codes), pa.array(np.repeat(part["vec_id"].to_numpy(), sizes))], ["dims", "table", "segments", "bucket", "query_id"])

    kind = dict(vectors.dtypes)["embedding"]
    def indexed(some: range) -> DataFrame:
        return good.select("vec_id", "embedding").mapInArrow(lambda batches: index(batches, some), f"dims int, table int, segments int, bucket long, vec_id long, embedding {kind}")

    hot = saved(indexed(range(tables)).groupBy("dims", "table", "bucket").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("parts")).filter("parts > 1"), "ann-hot")
    segment = F.pmod(F.xxhash64("table", "bucket", "part"), F.col("segments")).cast("int").alias("segment")

    def dealt(some: range) -> DataFrame:
        """The vectors in the buckets and segments of these tables."""
        rows = indexed(some).join(hot, ["dims", "table", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.coalesce("parts", F.lit(1))).cast("int"))
        return rows.select("dims", "table", segment, "bucket", "vec_id", "embedding")

    place, keys = ["dims", "table", "segment"], ["dims", "table", "segment", "block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right, k)

    def probed(some: DataFrame, own: range) -> DataFrame:
        """What the queries ``some`` find in the tables ``own`` within ``reach``, or in all buckets where that is null, with a score of ``floor`` or more."""
        asks = some.filter("reach is not null").select("vec_id", "embedding", "reach").mapInArrow(lambda batches: visits(batches, own), "dims int, table int, segments int, bucket long, query_id long").join(hot, ["dims", "table", "bucket"], "left")
        asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        asks = asks.select("dims", "table", segment, "bucket", "query_id").groupBy(*place, "query_id").agg(F.collect_set("bucket").alias("buckets"))
        count = F.create_map(*(F.lit(v) for d, x in space.items() for v in (d, x.segments)))[F.col("dims")] if space else F.lit(1)
        whole = some.filter("reach is null").select("dims", F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"), F.col("vec_id").alias("query_id"), F.lit(None).cast("array<bigint>").alias("buckets"))
        asks = saved(asks.unionByName(whole), "ann-visits")
        blocks = asks.groupBy(*place).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        left = asks.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        left = left.join(some.select(F.col("vec_id").alias("query_id"), "embedding", "floor"), "query_id")
        right = dealt(own).join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        return best_of(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)

    pick = lambda f: F.create_map(*(F.lit(v) for d, x in space.items() for v in (d, float(f(x)))))[F.col("dims")] if space else F.lit(1.0)
    def known(found: DataFrame) -> DataFrame:
        """The queries with ``floor``, their k-th best score so far; null where they have fewer."""
        last = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("found"), F.min("score").alias("score"))
        return asked.join(last, "vec_id", "left").withColumn("floor", F.when(F.col("found") >= k, F.col("score")))

    # what the first table gives is the least that the others have to give
    first = saved(best(probed(asked.withColumns({"reach": pick(lambda x: x.distance), "floor": F.lit(None).cast("double")}), range(1))), "ann-first")
    if tables > 1:
        more = probed(known(first).withColumn("reach", pick(lambda x: x.distance)), range(1, tables))
        first = saved(best(first.drop("rank").unionByName(more)), "ann-found")
    norm, length = pick(lambda x: x.norm), F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    far = F.sqrt(F.greatest(2 * norm * norm - 2 * norm * F.col("score") / length, F.lit(0.0)))
    again = known(first).withColumn("reach", F.when(F.col("found") >= k, far))
    again = saved(again.filter(F.col("reach").isNull() | (F.col("reach") > pick(lambda x: x.distance))).select("vec_id", "embedding", "dims", "reach", "floor"), "ann-again")
    return best(first.drop("rank").unionByName(probed(again, range(tables)))) if again.count() else first


def meet(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best of each query of ``left`` among the vectors of ``right`` in the buckets it visits; null: in all."""
    names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
    if not len(left) or not len(right):
        return pa.table([pa.array([], t) for t in kinds], names)
    queries, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
    q, x = matrix(left["embedding"]), matrix(right["embedding"])
    lists = left["buckets"].combine_chunks()
    asked = lists.flatten().to_numpy()
    asker = np.repeat(np.arange(len(queries)), lists.value_lengths().fill_null(0).to_numpy())
    whole = np.flatnonzero(lists.is_null().to_numpy(zero_copy_only=False))
    order = np.argsort(asked, kind="stable")
    asked, asker = asked[order], asker[order]
    order = np.lexsort((ids, right["bucket"].to_numpy()))  # by id in each bucket: of equal scores the first stay
    bucket, ids, x = right["bucket"].to_numpy()[order], ids[order], x[order]
    floor = left["floor"].fill_null(-np.inf).to_numpy().copy() if "floor" in left.column_names else np.full(len(queries), -np.inf)
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    waiting: list[list[np.ndarray]] = [[], [], []]
    size = 0

    def merge() -> list[np.ndarray]:
        row, vec, score = (np.concatenate((a, *b)) for a, b in zip(kept, waiting))
        order = np.lexsort((-score, vec, row))  # each vector once, with its best score
        row, vec, score = row[order], vec[order], score[order]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (vec[1:] != vec[:-1]))) if len(row) else np.zeros(0, bool)
        row, vec, score = row[new], vec[new], score[new]
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        start = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0)) if len(row) else row
        full = place == k - 1
        floor[row[full]] = score[full]
        return [a[place < k] for a in (row, vec, score)]

    def blocks(who: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """A bucket and its queries in blocks, so that products never take more than STRETCH squared."""
        for a in range(start, stop, STRETCH):
            for u in range(0, len(who), STRETCH):
                yield who[u : u + STRETCH], a, min(a + STRETCH, stop)

    def meetings() -> Iterator[tuple[np.ndarray, int, int]]:
        for a, b in zip(*_runs(bucket)):
            yield from blocks(asker[np.searchsorted(asked, bucket[a], "left") : np.searchsorted(asked, bucket[a], "right")], a, b)
        yield from blocks(whole, 0, len(bucket))

    for who, a, b in meetings():
        s = q[who] @ x[a:b].T
        s[queries[who][:, None] == ids[None, a:b]] = -np.inf
        hit = (s >= floor[who][:, None]) & (s > -np.inf)
        most = k + (b - a) - len(np.unique(ids[a:b]))  # rows that repeat an id take no other's place
        if most < b - a and hit.sum() > most * len(who):
            least = np.partition(s, -most, axis=1)[:, -most][:, None]
            above, ties = s > least, s == least
            hit &= above | (ties & (ties.cumsum(axis=1) <= most - above.sum(axis=1)[:, None]))
        r, c = np.nonzero(hit)
        for to, values in zip(waiting, (who[r], ids[a:b][c], s[r, c])):
            to.append(values)
        size += len(r)
        if size > 40 * len(queries):
            kept = merge()
            waiting, size = [[], [], []], 0
    kept = merge()
    return pa.table([pa.array(queries[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names)


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values start and end."""
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return [0, *cuts], [*cuts, len(values)]
