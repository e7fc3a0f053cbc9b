"""Exact top-k search by MaxScore over sharded vectors.

Components are terms and vectors the documents; a term's posting list is its
row of the transposed shard. A query meets a shard with a threshold, the k-th
best score that it has somewhere already. Its terms are ordered by the largest
product they can give. Essential are the first terms up to which the bound of
the rest falls below the threshold: a vector that gets nothing from them is no
result. Their postings are traversed; what is left of the others' postings is
probed a few terms at a time, largest first, and only for vectors whose bound
still reaches the threshold. The bound of the terms to come is the smaller of
the sum of their greatest products and, by Cauchy and Schwarz, the product of
the lengths that query and vector have left.

1. Every query meets a FIRST share of the shards; its threshold there rises
   from its best among the first SEED vectors.
2. The k-th best score so far is carried to all other shards.
3. The results of all shards are merged.

Traversal is in single precision with its error as slack; what survives is
scored in whole numbers, in doubles while these are exact and else in Python's
integers. Queries and vectors meet in blocks, each block of queries with every
shard, as an exact search must; blocks hold CELLS numbers.

Defined results: vectors that are null or hold null or non-finite components
take no part; a query meets the vectors of its own length but for those of its
own id; rows that share a vec_id count once, with their best score; of queries
that share a vec_id the least vector asks; ties go to the smaller vec_id; with
fewer candidates than ``k`` all are returned; scores beyond a long are brought
to its ends; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .vectors import best_of, matrix, one_each, usable

SCALE = 1024
#: Numbers in a shard and in a block of queries.
CELLS = 1 << 19
#: One of so many shards is met first.
FIRST = 8
#: Vectors scored at once for a first threshold, and terms probed at once.
SEED, STEP = 256, 8
EXACT = 2.0**53
ENDS = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(x * scale)


class Shard:
    """Vectors of one length as posting lists, with what bounds their products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.unit = float(np.abs(vectors).max(initial=0.0)) or 1.0
        self.postings = np.ascontiguousarray((vectors / self.unit).T.astype(np.float32))
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)
        self.square = np.einsum("ij,ij->j", self.postings, self.postings)
        self.touched = self.possible = 0  # products made, and those of all terms with all vectors

    def exact(self, query: np.ndarray, at: np.ndarray) -> list[int] | np.ndarray:
        """The whole-number scores of the vectors at ``at``."""
        self.touched += len(at) * len(query)
        if np.abs(query).sum() * self.unit < EXACT:
            return (self.vectors[at] @ query).astype(np.int64)
        own = [int(x) for x in query.tolist()]
        return [min(max(sum(a * int(b) for a, b in zip(own, row)), ENDS[0]), ENDS[1]) for row in self.vectors[at].tolist()]

    def best(self, query_id: int, query: np.ndarray, k: int, threshold: float | None) -> list[tuple[int, int]]:
        """vec_id, score of the vectors that may be among the ``k`` best: all that reach ``threshold`` and the k-th best here."""
        n, terms = self.vectors.shape
        self.possible += n * terms
        unit = float(np.abs(query).max(initial=0.0)) or 1.0
        q = (query / unit).astype(np.float32)
        least = None if threshold is None else threshold / unit / self.unit
        candidates = np.flatnonzero(self.ids != query_id)
        if least is None and len(candidates) > k:
            seed = candidates[: max(SEED, 4 * k)]
            own = self.top(seed, self.exact(query, seed), k)
            least = own[-1][1] / unit / self.unit if len(own) == k else None
        if least is not None:
            candidates = self.alive(q, least, candidates)
        return self.top(candidates, self.exact(query, candidates), k)

    def alive(self, q: np.ndarray, least: float, candidates: np.ndarray) -> np.ndarray:
        """The candidates whose score is ``least`` or more, and perhaps a few just below it."""
        most = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-np.maximum(np.abs(q * self.low), np.abs(q * self.high)), kind="stable")
        energy = np.concatenate(([0.0], np.cumsum(np.square(q[order], dtype=np.float64))))
        left = np.sqrt(np.maximum(energy[-1] - energy, 0.0))  # length of the query from each rank on
        sums = np.concatenate((np.cumsum(most[order][::-1], dtype=np.float64)[::-1], [0.0]))
        slack = 1e-6 * (len(q) + 4) * (np.sqrt(energy[-1] * self.square.max()) + abs(least)) + 1e-30
        floor = least - slack
        bound = np.minimum(sums, left * np.sqrt(self.square.max()))
        below = np.flatnonzero(bound < floor)
        done = int(below[0]) if len(below) else len(q)  # terms before this rank are essential
        done = max(done, min(STEP, len(q)))
        essential = order[:done]
        partial = q[essential] @ self.postings[essential]
        self.touched += done * len(partial)
        partial = partial[candidates]
        while True:
            # what the traversed terms gave tells how long the rest of a vector can be
            rest = np.sqrt(np.maximum(self.square[candidates] - np.square(partial) / max(energy[done], 1e-30), 0.0))
            kept = partial + np.minimum(sums[done], left[done] * rest) >= floor
            candidates, partial = candidates[kept], partial[kept]
            if done == len(q) or not len(candidates):
                return candidates
            some = order[done : done + STEP]
            partial = partial + q[some] @ self.postings[np.ix_(some, candidates)]
            self.touched += len(some) * len(candidates)
            done += len(some)

    def top(self, at: np.ndarray, scores: list[int] | np.ndarray, k: int) -> list[tuple[int, int]]:
        """vec_id, score of the ``k`` best ids, each with its best score; ties to the smaller id."""
        if isinstance(scores, list):
            best: dict[int, int] = {}
            for i, s in zip(self.ids[at].tolist(), scores):
                best[i] = max(s, best.get(i, s))
            return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        ids = self.ids[at]
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)[:k]]
        return list(zip(ids[order].tolist(), scores[order].tolist()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of ``vectors`` where ``is_query`` holds."""
    good = usable(vectors).withColumn("dims", F.size("embedding"))
    asked = saved(one_each(good.filter(is_query)).withColumn("dims", F.size("embedding")), "topk-queries")
    n, most = good.agg(F.count("*"), F.max("dims")).first()  # two numbers
    n_queries = asked.count()
    size = max(CELLS // (most or 1), 64)
    shards, blocks = max(1, -(-n // size)), max(1, -(-n_queries // size))
    every = lambda low, high, name: F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias(name)
    # dealt by row, so that one id or vector of many rows is spread over all shards; written, so that each row stays where it is
    docs = saved(good.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")), "topk-vectors")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    keys = ["dims", "shard", "block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            shard = Shard(right["vec_id"].to_numpy(), whole_numbers(matrix(right["embedding"]), scale))
            queries = whole_numbers(matrix(left["embedding"]), scale)
            for query, q, least in zip(left["vec_id"].to_pylist(), queries, left["least"].to_pylist()):
                rows += [(query, v, s) for v, s in shard.best(query, q, k, least)]
        return pa.table([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    def met(low: int, high: int, queries: DataFrame) -> DataFrame:
        """What the queries find in the shards from ``low`` to ``high``."""
        left = queries.select("vec_id", "embedding", "least", "dims", "block", every(low, high, "shard"))
        right = docs.filter(F.col("shard").between(low, high - 1)).select("vec_id", "embedding", "dims", "shard", every(0, blocks, "block"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        return best_of(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)

    first = max(1, -(-shards // FIRST))
    found = saved(best(met(0, first, asked.withColumn("least", F.lit(None).cast("double")))), "topk-first")
    if first == shards:
        return found
    least = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    known = asked.join(least, "vec_id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("low")))
    return best(found.drop("rank").unionByName(met(first, shards, known)))
