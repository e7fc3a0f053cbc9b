"""Seeds in the live order of few queries, without a row for each match.

The live order of a pair is db_pos, query_pos over all diagonals. Spark deals
the databases, joins each of their places with the places of its k-mer in the
queries as lists, and puts the places of a task in order: a row for each place
of a database instead of one for each match. A helper reads these rows batch by
batch, takes their matches apart by query and tells the runs; it carries the
last run of each query from batch to batch, so that a task never holds more
than a batch, however long a database is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.sequences import upto
from ..params import Search
from .packed import dealt, packed

#: Places of a k-mer in the queries that a row lists at most: hot k-mers have several rows.
PIECE = 256
#: What is carried of the last run of a query: its first and last match, how many it has, and the seeds of the pair before it.
CARRIED = ("number", "start_d", "start_q", "end_d", "end_q", "n", "seeds")


def _by_number(x: np.ndarray) -> np.ndarray:
    """A stable order of non-negative whole numbers, by 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    rest = x >> 16
    while rest.any():
        order = order[np.argsort((rest[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        rest = rest >> 16
    return order


def _matches(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, db_pos, number of the query and query_pos of each match."""
    places = rows["places"].cast(pa.large_binary())
    _, offsets, data = places.buffers()
    offsets = np.frombuffer(offsets, np.int64)[places.offset : places.offset + len(places) + 1] // 8
    x = np.frombuffer(data or b"", ">i8")[offsets[0] : offsets[-1]].astype(np.int64)
    row = np.repeat(np.arange(len(rows)), np.diff(offsets))
    number, tasks = x >> 32, np.asarray(rows["tasks"])
    if (tasks > 1).any():  # a long database: each task has its share of the queries
        own = number % tasks[row] == np.asarray(rows["task"])[row]
        row, number, x = row[own], number[own], x[own]
    return row, np.asarray(rows["pos"]).astype(np.int64)[row], number, x & 0xFFFFFFFF


def _runs(rows: pa.RecordBatch, carry: dict[str, np.ndarray], goes_on: bool, p: Search) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Seeds that end in ``rows``, with the ``row`` of their database, and what is carried if the last database goes on; ``carry`` belongs to the first one."""
    reach, c = p.k + p.max_gap, len(carry["number"])
    codes, task = np.asarray(rows["db_id"].dictionary_encode(null_encoding="encode").indices), np.asarray(rows["task"])
    differ = np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(task) != 0)])
    doc, begins = np.cumsum(differ) - 1, np.flatnonzero(differ)
    row, d, number, q = _matches(rows)
    d, q, number = (np.concatenate([carry[name], own]) for name, own in (("start_d", d), ("start_q", q), ("number", number)))
    of = np.concatenate([np.zeros(c, np.int64), doc[row]])
    pair = of * (number.max(initial=0) + 1) + number
    order = _by_number(pair)
    same = np.diff(pair[order]) == 0
    if (same & (np.diff(((d << 32) + q)[order]) < 0)).any():  # several databases of one number
        order = np.lexsort((q, d, np.arange(len(d)) >= c, pair))
    number, d, q, pair, of = number[order], d[order], q[order], pair[order], of[order]
    end_d, end_q = d, q
    old = np.flatnonzero(order < c)  # carried runs, each the first of its pair
    if c:
        end_d, end_q = d.copy(), q.copy()
        end_d[old], end_q[old] = carry["end_d"][order[old]], carry["end_q"][order[old]]
    q_step, d_step = q[1:] - end_q[:-1], d[1:] - end_d[:-1]
    close = same & (np.abs(q_step - d_step) <= p.max_gap) & (q_step <= reach) & (d_step <= reach)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(d)), bool), ~close]))
    last = np.append(first[1:], len(d))[: len(first)] - 1
    n, before = last - first + 1, np.zeros(len(first), np.int64)
    at = np.searchsorted(first, old)
    n[at] += carry["n"][order[old]] - 1
    before[at] = carry["seeds"][order[old]]
    pair = pair[first]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), np.diff(pair) != 0]))
    tails = np.append(heads[1:], len(pair))[: len(heads)] - 1
    whose = np.repeat(np.arange(len(heads)), tails - heads + 1)
    of = of[first]
    open_ = tails[of[tails] == doc[-1]] if goes_on else tails[:0]
    good = n >= p.min_matches
    good[open_] = False
    earlier = np.cumsum(good) - good
    seeds = earlier - earlier[heads][whose] + before[heads][whose]
    columns = {"number": number[first], "start_d": d[first], "start_q": q[first], "end_d": end_d[last], "end_q": end_q[last], "n": n, "seeds": seeds}
    return {name: x[good] for name, x in columns.items()} | {"row": begins[of[good]]}, {name: x[open_] for name, x in columns.items()}


def _scan(p: Search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    nothing = {name: np.zeros(0, np.int64) for name in CARRIED}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, carry = None, nothing

        def told(rows: pa.RecordBatch, goes_on: bool) -> pa.RecordBatch:
            nonlocal carry
            found, carry = _runs(rows, carry, goes_on, p)
            own = rows.select(["db_id", "task"]).take(pa.array(found.pop("row")))
            return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(found[name]) for name in CARRIED)], names=["db_id", "task", *CARRIED])

        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not len(rows):
                continue
            place = lambda i: tuple(rows[c][i].as_py() for c in ("db_id", "task", "pos"))  # noqa: B023, E731
            at = len(rows) - 1  # the last place waits: what comes next tells whether its database goes on
            while at and place(at - 1) == place(len(rows) - 1):
                at -= 1
            if at:
                yield told(rows.slice(0, at), place(at - 1)[:2] == place(at)[:2])
            held = rows.slice(at)
        if held is not None and len(held):
            yield told(held, False)

    return scan


def seeds(queries: DataFrame, databases: DataFrame, parts: int, p: Search) -> DataFrame:
    """``seeds.live`` of few queries, whose letters are numbered in one task and broadcast; databases are dealt to ``parts`` partitions."""
    q = queries.filter(F.length("seq") >= p.k).select("seq_id", "seq", (F.dense_rank().over(W.orderBy("seq_id")) - 1).cast("long").alias("number"))
    lists = packed(q, p.k, 6, "number").groupBy("code").agg(F.sort_array(F.collect_list(F.shiftleft("number", 32) + F.col("pos"))).alias("list"))
    lists = lists.select("code", "list", F.explode(upto(F.ceil(F.size("list") / PIECE).cast("int"))).alias("piece"))
    text = F.array_join(F.transform(F.slice("list", F.col("piece") * PIECE + 1, F.lit(PIECE)), lambda x: F.lpad(F.hex(x), 16, "0")), "")
    lists = lists.select("code", "piece", F.unhex(text).alias("places"))
    d = packed(dealt(databases, parts), p.k, 7, "tasks", "task").join(F.broadcast(lists), "code")
    rows = d.sortWithinPartitions("seq_id", "task", "pos", "piece").select(F.col("seq_id").alias("db_id"), "task", "tasks", "pos", "places")
    schema = StructType(rows.select("db_id", "task").schema.fields)
    for name in CARRIED:
        schema = schema.add(name, "long")
    ids = q.select("number", F.col("seq_id").alias("query_id")).distinct()
    found = rows.mapInArrow(_scan(p), schema).join(F.broadcast(ids), "number")
    spans = {"query_start": F.col("start_q"), "query_end": F.col("end_q") + p.k - 1, "db_start": F.col("start_d"), "db_end": F.col("end_d") + p.k - 1}
    out = found.select("query_id", "db_id", "task", F.col("seeds").alias("seed_id"), *(c.alias(name) for name, c in spans.items()), F.col("n").alias("match_count"), (F.col("n") * p.k * float(p.match)).alias("score"))
    return out.withColumn("length", F.col("query_end") - F.col("query_start") + 1)
