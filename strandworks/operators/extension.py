"""Ungapped X-drop extension on chunks of sequences.

Sequences are tables of chunks. A seed meets the chunk around its start on
either side, once; nearly all walks end there. Only walks that haven't stopped
fetch on, each time a chunk GROWTH times as long, so that what moves is in
proportion to what is walked. Alignments that one chunk doesn't hold are put
together from the chunks that they cover.

Seeds of short queries that lie in a task with their databases need no chunks:
the letters that walks may need are cut where both lie, and a batch of seeds is
walked letter by letter at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import upto
from ..sources.working import saved
from .matches import PAIR

#: Letters of a chunk at first, and how much longer those are that walks fetch afterwards.
CHUNK, GROWTH = 256, 8
#: Letters that are walked before the next ones are even split: most walks stop among the first.
STEPS = (8, 64, 512, 4096, 1 << 15, 1 << 18)
#: Letters of the chunks that alignments are put together from.
PIECE = 4096
KEY = [*PAIR, "seed_id"]

Piece = Callable[[int, Column], Column]


def start_of_walk() -> Column:
    """Sum, highest sum, letters to it, whether a rule has stopped the walk, letters walked, whether it fell by the drop."""
    return F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("at"), F.lit(False).alias("stop"), F.lit(0).alias("steps"), F.lit(False).alias("fell"))


def walk(rows: DataFrame, name: str, a: Piece, b: Piece, n: Column, match: float, mismatch: float, drop: float, floor: float | None, most: int) -> DataFrame:
    """``rows`` with the walk in column ``name`` carried on along ``n`` letters, at most ``most``; ``a`` and ``b`` give so many of them from a place on.

    It stops after a step at which the sum is more than ``drop`` below its
    highest value, or below minus ``floor``. Each part is a column of its own,
    which is not computed for walks that have stopped.
    """

    def step(s: Column, same: Column) -> Column:
        now = s.sum + F.when(same, float(match)).otherwise(float(mismatch))
        better, steps = now > s.best, s.steps + 1
        best = F.when(better, now).otherwise(s.best)
        fell = now < best - abs(float(drop))
        stop = fell if floor is None else fell | (now < -abs(float(floor)))
        new = F.struct(now.alias("sum"), best.alias("best"), F.when(better, steps).otherwise(s.at).alias("at"), stop.alias("stop"), steps.alias("steps"), fell.alias("fell"))
        return F.when(s.stop, s).otherwise(new)

    low = 0
    for high in (*(s for s in STEPS if s < most), most):
        width = (F.least(n, F.lit(high)) - low).cast("int")
        state = F.col(name)
        part = lambda x: F.split(x(low, width), "")  # noqa: B023, E731
        rows = rows.withColumn(name, F.when(state.stop | (n <= low), state).otherwise(F.aggregate(F.zip_with(part(a), part(b), lambda x, y: x == y), state, step)))
        low = high
    return rows


def walked(rows: DataFrame, name: str, a: Column, b: Column, match: float, mismatch: float, drop: float, floor: float | None = None) -> DataFrame:
    """``rows`` with the struct ``name``, of a walk along two flanks from their start."""
    piece = lambda s: lambda low, width: F.substring(s, F.lit(low + 1), width)
    return walk(rows.withColumn(name, start_of_walk()), name, piece(a), piece(b), F.least(F.length(a), F.length(b)), match, mismatch, drop, floor, 1 << 30)


def forwards(text: str, at: Column) -> Piece:
    """Letters of the binary column ``text`` from the 0-based place ``at`` on."""
    return lambda low, width: F.substring(text, (at + low + 1).cast("int"), width).cast("string")


def backwards(text: str, at: Column) -> Piece:
    """Letters before ``at``, the nearest first."""
    return lambda low, width: F.reverse(F.substring(text, (at - low - width + 1).cast("int"), width).cast("string"))


def chunks(sequences: DataFrame, size: int, side: str) -> DataFrame:
    """{side}_id, {side}_chunk, {side}_from, {side}_text, {side}_letters (of the sequence): around each chunk of ``size`` letters, as many before and after it."""
    rows = sequences.select(F.col("seq_id").alias(f"{side}_id"), F.length("seq").cast("long").alias(f"{side}_letters"), F.col("seq").cast("binary").alias("seq"))
    rows = rows.withColumn("chunk", F.explode(upto((F.floor(F.col(f"{side}_letters") / size) + 1).cast("int"))))
    start = F.greatest(F.lit(0), (F.col("chunk") - 1) * size)
    text = F.substring("seq", start + 1, (F.col("chunk") + 2) * size - start)
    return rows.select(f"{side}_id", F.col("chunk").cast("long").alias(f"{side}_chunk"), start.cast("long").alias(f"{side}_from"), text.alias(f"{side}_text"), f"{side}_letters")


def fetched(rows: DataFrame, queries: DataFrame, databases: DataFrame, size: int, query_at: Column, db_at: Column, few: bool) -> DataFrame:
    """``rows`` with the chunks of both sides around two places. Chunks of ``few`` query letters are broadcast."""
    q = chunks(queries, size, "query")
    rows = rows.withColumns({"query_chunk": F.floor(query_at / size), "db_chunk": F.floor(db_at / size)})
    rows = rows.join(F.broadcast(q) if few else q, ["query_id", "query_chunk"])
    return rows.join(chunks(databases, size, "db"), ["db_id", "db_chunk"]).drop("query_chunk", "db_chunk")


def _room(side: str) -> Column:
    """How far a walk can go at all."""
    left = F.least("query_start", "db_start")
    return left if side == "left" else F.least(F.col("query_letters") - F.col("query_end") - 1, F.col("db_letters") - F.col("db_end") - 1)


def _first_walks(seeds: DataFrame, queries: DataFrame, databases: DataFrame, rules: dict, few: bool) -> DataFrame:
    rows = fetched(seeds, queries, databases, CHUNK, F.col("query_start"), F.col("db_start"), few)
    inside = lambda side, place: F.col(f"{side}_{place}") - F.col(f"{side}_from")
    qs, ds, qe, de = inside("query", "start"), inside("db", "start"), inside("query", "end") + 1, inside("db", "end") + 1
    rows = rows.withColumns({"left": start_of_walk(), "right": start_of_walk()})
    rows = walk(rows, "left", backwards("query_text", qs), backwards("db_text", ds), F.least(qs, ds), **rules, most=2 * CHUNK)
    after = F.greatest(F.lit(0), F.least(F.octet_length("query_text") - qe, F.octet_length("db_text") - de))
    rows = walk(rows, "right", forwards("query_text", qe), forwards("db_text", de), after, **rules, most=3 * CHUNK)
    done = F.lit(True)
    for side in ("left", "right"):
        done = done & (F.col(f"{side}.stop") | (F.col(f"{side}.steps") >= _room(side)))
    spans = {}
    for side in ("query", "db"):
        low, high = inside(side, "start") - F.col("left.at"), inside(side, "end") + F.col("right.at")
        done = done & (high < F.octet_length(f"{side}_text"))
        spans[f"{side}_alignment"] = F.substring(f"{side}_text", (low + 1).cast("int"), (high - low + 1).cast("int")).cast("string")
    rows = rows.withColumn("done", done).withColumns({name: F.when(F.col("done"), c) for name, c in spans.items()})
    return rows.drop("query_text", "db_text", "query_from", "db_from")


def _walked_on(rows: DataFrame, queries: DataFrame, databases: DataFrame, rules: dict, few: bool) -> DataFrame:
    """KEY, side and walk of both sides of each row, walked to their end."""
    sides = []
    for side in ("left", "right"):
        sign, at = (-1, ("query_start", "db_start")) if side == "left" else (1, ("query_end", "db_end"))
        place = lambda c: F.col(c) + (0 if sign < 0 else 1) + sign * F.col(f"{side}.steps")  # noqa: B023, E731
        sides.append(rows.select(*KEY, F.lit(side).alias("side"), F.col(side).alias("walk"), place(at[0]).alias("query_at"), place(at[1]).alias("db_at"), (_room(side) - F.col(f"{side}.steps")).alias("room")))
    todo = sides[0].union(sides[1])
    over = F.col("walk.stop") | (F.col("room") <= 0)
    ended, size = [todo.filter(over).select(*KEY, "side", "walk")], CHUNK
    todo = saved(todo.filter(~over), "walks")
    while todo.count():
        size *= GROWTH
        some = fetched(todo, queries, databases, size, F.col("query_at"), F.col("db_at"), few)
        q, d = F.col("query_at") - F.col("query_from"), F.col("db_at") - F.col("db_from")
        back, ahead = some.filter("side = 'left'"), some.filter("side = 'right'")
        steps = F.col("walk.steps").alias("before")
        back = walk(back.select("*", steps), "walk", backwards("query_text", q), backwards("db_text", d), F.least(q, d), **rules, most=2 * size)
        ahead = walk(ahead.select("*", steps), "walk", forwards("query_text", q), forwards("db_text", d), F.least(F.octet_length("query_text") - q, F.octet_length("db_text") - d), **rules, most=3 * size)
        done = F.col("walk.steps") - F.col("before")
        sign = F.when(F.col("side") == "left", -1).otherwise(1)
        now = back.union(ahead).withColumns({"query_at": F.col("query_at") + sign * done, "db_at": F.col("db_at") + sign * done, "room": F.col("room") - done}).select(todo.columns)
        now = saved(now, "walks")
        ended.append(now.filter(over).select(*KEY, "side", "walk"))
        todo = now.filter(~over)
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    return out


def _put_together(rows: DataFrame, sequences: DataFrame, side: str) -> DataFrame:
    """KEY and the letters from {side}_low to {side}_high, from the pieces that hold them."""
    low, high = F.col(f"{side}_low"), F.col(f"{side}_high")
    wanted = rows.select(*KEY, low, high, F.explode(F.sequence(F.floor(low / PIECE), F.floor(high / PIECE))).alias("piece"))
    s = sequences.select(F.col("seq_id").alias(f"{side}_id"), F.col("seq").cast("binary").alias("seq"))
    s = s.withColumn("piece", F.explode(upto(F.ceil(F.octet_length("seq") / PIECE).cast("int"))))
    s = s.select(f"{side}_id", F.col("piece").cast("long").alias("piece"), F.substring("seq", F.col("piece") * PIECE + 1, F.lit(PIECE)).cast("string").alias("text"))
    parts = wanted.join(s, [f"{side}_id", "piece"]).groupBy(*KEY, low, high).agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("parts"))  # no more than the alignment itself
    text = F.array_join(F.transform("parts", lambda p: p.text), "")
    return parts.select(*KEY, F.substring(text, (F.pmod(low, F.lit(PIECE)) + 1).cast("int"), (high - low + 1).cast("int")).alias(f"{side}_alignment"))


def along(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, n: np.ndarray, sign: int, match: float, mismatch: float, drop: float, floor: float | None) -> dict[str, np.ndarray]:
    """Walks along ``n`` letters from places of ``a`` and ``b``: one letter more at each step, of the walks alone that haven't stopped."""
    out = {"best": np.zeros(len(n)), "at": np.zeros(len(n), np.int32), "stop": np.zeros(len(n), bool), "fell": np.zeros(len(n), bool)}
    on, steps = np.flatnonzero(n > 0), 0
    now, best = np.zeros(len(on)), np.zeros(len(on))
    while len(on):
        now = now + np.where(a[a_at[on] + sign * steps] == b[b_at[on] + sign * steps], float(match), float(mismatch))
        steps += 1
        better = now > best
        best = np.where(better, now, best)
        out["best"][on], out["at"][on[better]] = best, steps
        fell = now < best - abs(float(drop))
        stop = fell if floor is None else fell | (now < -abs(float(floor)))
        out["fell"][on], out["stop"][on] = fell, stop
        stays = ~stop & (n[on] > steps)
        on, now, best = on[stays], now[stays], best[stays]
    return out


def _walks(match: float, mismatch: float, drop: float, floor: float | None) -> Callable[..., Column]:
    """Both walks of seeds and the equal letters of what they span (null for unlike lengths), from the letters around them."""

    def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts)]

    kinds = "best: double, at: int, stop: boolean, fell: boolean"

    @F.arrow_udf(f"left: struct<{kinds}>, right: struct<{kinds}>, same: long")
    def walks(query_text: pa.Array, db_text: pa.Array, left_n: pa.Array, right_n: pa.Array, query_core: pa.Array, db_core: pa.Array) -> pa.Array:
        (q, q_at), (d, d_at) = bytes_of(query_text), bytes_of(db_text)
        left_n, right_n, q_core, d_core = (np.asarray(c) for c in (left_n, right_n, query_core, db_core))
        left = along(q, d, q_at + left_n - 1, d_at + left_n - 1, left_n, -1, match, mismatch, drop, floor)
        right = along(q, d, q_at + left_n + q_core, d_at + left_n + d_core, right_n, 1, match, mismatch, drop, floor)
        n = np.where(q_core == d_core, left["at"] + q_core + right["at"], 0).astype(np.int64)
        ends = np.cumsum(n)
        inside = np.arange(n.sum()) - np.repeat(ends - n, n)
        start = left_n - left["at"]
        equal = np.concatenate([[0], np.cumsum(q[np.repeat(q_at + start, n) + inside] == d[np.repeat(d_at + start, n) + inside])])
        struct = lambda parts: pa.StructArray.from_arrays([pa.array(c) for c in parts.values()], list(parts))
        same = pa.array(equal[ends] - equal[ends - n], pa.int64(), mask=q_core != d_core)
        return pa.StructArray.from_arrays([struct(left), struct(right), same], ["left", "right", "same"])

    return walks


def _in_task(seeds: DataFrame, queries: DataFrame, dealt: DataFrame, match: float, mismatch: float, drop: float, floor: float | None) -> DataFrame:
    """``extended`` for seeds that have the partitions of the ``dealt`` databases, with ``same``: equal letters of alignments of one length."""
    letters = lambda df, side, *own: df.select(F.col("seq_id").alias(f"{side}_id"), *own, F.col("seq").cast("binary").alias(f"{side}_seq"), F.length("seq").alias(f"{side}_letters"))
    rows = seeds.join(letters(dealt, "db", "task").hint("shuffle_hash"), ["db_id", "task"]).join(F.broadcast(letters(queries, "query")), "query_id")
    rows = rows.withColumns({f"{side}_n": _room(side).cast("int") for side in ("left", "right")})
    core = {side: (F.col(f"{side}_end") - F.col(f"{side}_start") + 1).cast("int") for side in ("query", "db")}
    text = {f"{side}_text": F.substring(f"{side}_seq", (F.col(f"{side}_start") - F.col("left_n") + 1).cast("int"), F.col("left_n") + core[side] + F.col("right_n")) for side in core}
    rows = rows.select(*seeds.columns, "left_n", "right_n", *(c.alias(name) for name, c in text.items()))
    told = _walks(match, mismatch, drop, floor)("query_text", "db_text", "left_n", "right_n", core["query"], core["db"])
    rows = rows.withColumn("told", told).select("*", "told.*")
    start, grown = (F.col("left_n") - F.col("left.at") + 1), F.col("left.at") + F.col("right.at")
    spans = {f"{side}_alignment": F.substring(f"{side}_text", start, grown + core[side]).cast("string") for side in core}
    return rows.withColumns(spans).select(*seeds.columns, "left", "right", *spans, "same")


def extended(seeds: DataFrame, queries: DataFrame, databases: DataFrame, match: float, mismatch: float, drop: float, floor: float | None = None, few: bool = False, dealt: DataFrame | None = None) -> DataFrame:
    """``seeds`` with their spans extended, query_alignment, db_alignment, and the walks ``left`` and ``right``."""
    rules = {"match": match, "mismatch": mismatch, "drop": drop, "floor": floor}
    if dealt is not None and "task" in seeds.columns:
        return moved(_in_task(seeds, queries, dealt, **rules))
    first = saved(_first_walks(seeds.drop("task"), queries, databases, rules, few), "extensions")
    columns = [c for c in first.columns if c not in ("done", "query_letters", "db_letters")]
    closed, open_ = first.filter("done").select(*columns), first.filter("not done")
    if not open_.isEmpty():
        walks = saved(_walked_on(open_, queries, databases, rules, few), "walks")
        side = lambda name: walks.filter(F.col("side") == name).select(*KEY, F.col("walk").alias(name))
        rest = open_.drop("left", "right", "query_alignment", "db_alignment").join(side("left"), KEY).join(side("right"), KEY)
        for s in ("query", "db"):
            rest = rest.withColumns({f"{s}_low": F.col(f"{s}_start") - F.col("left.at"), f"{s}_high": F.col(f"{s}_end") + F.col("right.at")})
        rest = saved(rest, "extensions")
        for s, table in (("query", queries), ("db", databases)):
            rest = rest.join(_put_together(rest, table, s), KEY)
        closed = closed.union(rest.select(*columns))
    return moved(closed.withColumn("same", F.lit(None).cast("long")))


def moved(rows: DataFrame) -> DataFrame:
    """With the spans that the walks reached."""
    return rows.withColumns({f"{s}_{e}": F.col(f"{s}_{e}") + (-F.col("left.at") if e == "start" else F.col("right.at")) for s in ("query", "db") for e in ("start", "end")})
