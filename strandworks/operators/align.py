"""Dynamic-programming alignment of pairs.

The recurrences run a row at a time in numpy: in a row, the best gap along it
is a running maximum, so only rows are a loop. The kernels work on one pair
each inside an Arrow-batched UDF; the way back is read off the scores by
testing the candidates in the order of their precedence. Global and affine
alignments keep only every so many rows and make the rows between again on the
way back, so that a pair of n and m letters holds about sqrt(n) * m scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import col
from ..params import Affine, Linear, Local

GLOBAL = "aligned1 string, aligned2 string, score double"
LOCAL = "array<struct<aligned1:string,aligned2:string,start1:long,end1:long,start2:long,end2:long,score:double>>"
NEAR = 1e-9
#: Scores of one pair that are held before rows are left out.
KEEP = 1 << 22


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


class Replayed:
    """The rows 0 to n of a recurrence, ``step(row, i)`` giving row i from the one before it.

    Rows whose number divides by the stride are kept; the others are made
    again, a stretch at a time, when one of them is asked for. Up to ``KEEP``
    scores all rows are kept.
    """

    def __init__(self, first: np.ndarray, step: Callable[[np.ndarray, int], np.ndarray], n: int):
        self.step, self.n = step, n
        self.stride = max(1, min(isqrt(n) + 1, -(-n * first.size // KEEP)))
        self.kept, self.at, self.stretch = [first], -1, []
        row = first
        for i in range(1, n + 1):
            row = step(row, i)
            if i % self.stride == 0:
                self.kept.append(row)
        self.last = row

    def __getitem__(self, i: int) -> np.ndarray:
        at, past = divmod(i, self.stride)
        if past == 0:
            return self.kept[at]
        if at != self.at:
            self.at, self.stretch = at, [self.kept[at]]
            for k in range(at * self.stride + 1, min((at + 1) * self.stride, self.n + 1)):
                self.stretch.append(self.step(self.stretch[-1], k))
        return self.stretch[past]


def linear_rows(a: str, b: str, p: Linear, local: bool = False) -> tuple[np.ndarray, Callable[[np.ndarray, int], np.ndarray]]:
    """Row 0 of the scores of prefixes (or of the best suffixes of prefixes, never below 0), and the step from a row to the next."""
    x, y = codes(a), codes(b)
    steps = np.arange(len(y) + 1) * float(p.gap) + 0.0

    def step(above: np.ndarray, i: int) -> np.ndarray:
        row = above + p.gap
        np.maximum(row[1:], above[:-1] + np.where(y == x[i - 1], float(p.match), float(p.mismatch)), out=row[1:])
        if local:
            row = np.maximum(row, 0)
            row[0] = 0
        row = np.maximum.accumulate(row - steps) + steps
        if local:
            row[0] = 0
        return row

    return np.zeros(len(y) + 1) if local else steps, step


def linear_matrix(a: str, b: str, p: Linear, local: bool = False) -> np.ndarray:
    """All scores of ``linear_rows``."""
    out = np.zeros((len(a) + 1, len(b) + 1))
    out[0], step = linear_rows(a, b, p, local)
    for i in range(1, len(a) + 1):
        out[i] = step(out[i - 1], i)
    return out


def linear_matrices(a: list[str], b: list[str], p: Linear, local: bool = False) -> np.ndarray:
    """``linear_matrix`` of pairs whose strings have one length on each side, all rows i at once."""
    n, m = len(a[0]), len(b[0])
    x, y = codes("".join(a)).reshape(len(a), n), codes("".join(b)).reshape(len(b), m)
    steps = np.arange(m + 1) * float(p.gap) + 0.0
    out = np.zeros((len(a), n + 1, m + 1))
    out[:, 0] = 0.0 if local else steps
    for i in range(1, n + 1):
        above = out[:, i - 1]
        row = above + p.gap
        np.maximum(row[:, 1:], above[:, :-1] + np.where(y == x[:, i - 1 : i], float(p.match), float(p.mismatch)), out=row[:, 1:])
        if local:
            row = np.maximum(row, 0)
            row[:, 0] = 0
        row = np.maximum.accumulate(row - steps, axis=1) + steps
        if local:
            row[:, 0] = 0
        out[:, i] = row
    return out


def _step(s: np.ndarray | Replayed, a: str, b: str, i: int, j: int, p: Linear) -> str:
    """The first of diagonal, up, left that explains cell (i, j)."""
    here, above = s[i][j], s[i - 1] if i else None
    if i and j and abs(here - above[j - 1] - (p.match if a[i - 1] == b[j - 1] else p.mismatch)) < NEAR:
        return "diagonal"
    if i and abs(here - above[j] - p.gap) < NEAR:
        return "up"
    return "left"


def _columns(path: list[tuple[int, int]], a: str, b: str) -> tuple[str, str]:
    """Strings of a path of cells, from its end to its start."""
    one, two = [], []
    for (i, j), (k, m) in zip(path, path[1:]):
        one.append(a[i - 1] if k < i else "-")
        two.append(b[j - 1] if m < j else "-")
    return "".join(reversed(one)), "".join(reversed(two))


MOVES = {"diagonal": (1, 1), "up": (1, 0), "left": (0, 1)}
#: Rows of the three matrices, in the order of precedence of ties inside.
PAIR, DOWN, ALONG = range(3)
#: Where a cell of a local matrix came from; borders stop.
STOP, FROM_BOTH, FROM_ABOVE, FROM_LEFT, USED = 0, 1, 2, 3, 4


def align_global(a: str, b: str, p: Linear = Linear()) -> tuple[str, str, float]:
    """Ties: diagonal, then a gap in the second string, then in the first. An empty side leaves both as they are, score 0."""
    if not a or not b:
        return a, b, 0.0
    s = Replayed(*linear_rows(a, b, p), len(a))
    path = [(len(a), len(b))]
    while path[-1] != (0, 0):
        i, j = path[-1]
        di, dj = MOVES["left" if i == 0 else "up" if j == 0 else _step(s, a, b, i, j, p)]
        path.append((i - di, j - dj))
    return (*_columns(path, a, b), float(s.last[-1]))


def align_local(a: str, b: str, p: Local = Local()) -> list[tuple]:
    """All hits: every cell of ``threshold`` or more that no earlier hit ran through starts one, highest first.

    A hit ends at its outermost matches; its score is that of the whole run. A
    hit whose letter pairs are all in one above it is left out.
    """
    if not a or not b:
        return []
    x, y = codes(a), codes(b)
    row, step = linear_rows(a, b, p, local=True)
    way = np.zeros((len(a) + 1, len(b) + 1), np.uint8)  # a byte a cell: where it came from, and whether a hit ran through it
    high, top = [], []
    for i in range(1, len(a) + 1):
        above, row = row, step(row, i)
        here = row[1:]
        diagonal = np.abs(here - above[:-1] - np.where(y == x[i - 1], float(p.match), float(p.mismatch))) < NEAR
        up = np.abs(here - above[1:] - p.gap) < NEAR
        way[i, 1:] = np.where(here <= NEAR, STOP, np.where(diagonal, FROM_BOTH, np.where(up, FROM_ABOVE, FROM_LEFT)))
        starts = np.flatnonzero(here >= p.threshold) + 1
        high.append(starts + i * way.shape[1])
        top.append(row[starts])
    at, scores = np.concatenate(high), np.concatenate(top)
    order = np.argsort(-scores, kind="stable")
    hits: list[tuple] = []
    holders: dict[tuple[int, int], set[int]] = {}  # the hits that hold a pair of letters
    for cell, score in zip(at[order], scores[order]):
        i, j = divmod(int(cell), way.shape[1])
        if way[i, j] & USED:
            continue
        path = [(i, j)]
        while came := int(way[i, j]) & ~USED:
            way[i, j] |= USED
            i, j = i - (came != FROM_LEFT), j - (came != FROM_ABOVE)
            path.append((i, j))
        cells = path[::-1]
        pairs = [k for k in range(1, len(cells)) if cells[k][0] > cells[k - 1][0] and cells[k][1] > cells[k - 1][1]]
        match = [k for k in pairs if a[cells[k][0] - 1] == b[cells[k][1] - 1]]
        if match:
            kept = cells[match[0] - 1 : match[-1] + 1]
            met = [cells[k] for k in pairs if match[0] <= k <= match[-1]]
            wider = holders.get(met[0], set())
            for cell in met[1:]:
                if not wider:
                    break
                wider = wider & holders.get(cell, set())
            if not wider:
                for cell in met:
                    holders.setdefault(cell, set()).add(len(hits))
                hits.append((*_columns(kept[::-1], a, b), kept[0][0], kept[-1][0], kept[0][1], kept[-1][1], float(score)))
    return hits


def align_affine(a: str, b: str, p: Affine = Affine()) -> tuple[str, str, float]:
    """Aligned strings and the optimum of the recurrence (the reported score is that of ``affine_score``).

    Three matrices: pairs, gaps in the second string, gaps in the first; no
    step between the two kinds of gap. Ties: pairs first inside; at the end
    gaps in the second, then in the first, then pairs.
    """
    a, b = a.upper(), b.upper()
    n, m = len(a), len(b)
    sub = {x: np.array([p.matrix.get(x + y, 0.0) for y in b]) for x in set(a)}
    steps = np.arange(m + 1) * float(p.gap_extend)
    first = np.full((3, m + 1), -np.inf)
    first[PAIR, 0] = 0
    first[ALONG, 1:] = p.gap_open + p.end_gap + np.arange(m) * (p.gap_extend + p.end_gap)

    def step(above: np.ndarray, i: int) -> np.ndarray:
        row = np.full((3, m + 1), -np.inf)
        row[PAIR, 1:] = above[:, :-1].max(axis=0) + sub[a[i - 1]]
        row[DOWN, 0] = p.gap_open + p.end_gap + (i - 1) * (p.gap_extend + p.end_gap)
        row[DOWN, 1:] = np.maximum(above[PAIR, 1:] + p.gap_open, above[DOWN, 1:] + p.gap_extend)
        row[ALONG, 1:] = (np.maximum.accumulate(row[PAIR] - steps) + steps)[:-1] + p.gap_open
        return row

    s = Replayed(first, step, n)
    ends = {DOWN: s.last[DOWN, m] + p.end_gap, ALONG: s.last[ALONG, m] + p.end_gap, PAIR: s.last[PAIR, m]}
    state = max(ends, key=lambda k: ends[k])
    best, i, j, path = ends[state], n, m, [(n, m)]
    while i and j:
        i, j = i - (state != ALONG), j - (state != DOWN)
        here = s[i][:, j]
        if state == PAIR:
            state = int(here.argmax())
        elif here[PAIR] + p.gap_open >= here[state] + p.gap_extend:
            state = PAIR
        path.append((i, j))
    path += [(k, 0) for k in range(i - 1, -1, -1)] if j == 0 else [(0, k) for k in range(j - 1, -1, -1)]
    return (*_columns(path, a, b), float(best))


def _each(kernel, columns: list[str]):
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernel(x, y) if isinstance(x, str) and isinstance(y, str) else (None, None, None) for x, y in zip(a, b)], columns=columns)

    return run


def global_alignment(a: Column | str, b: Column | str, p: Linear = Linear()) -> Column:
    """struct<aligned1, aligned2, score>; null for a null side."""
    run = _each(lambda x, y: align_global(x, y, p), ["aligned1", "aligned2", "score"])
    return F.pandas_udf(run, GLOBAL)(col(a), col(b))


def affine_alignment(a: Column | str, b: Column | str, p: Affine = Affine()) -> Column:
    """struct<aligned1, aligned2, score>; nulls unless both are of the letters A, T, C, G."""

    def kernel(x: str, y: str) -> tuple:
        good = x and y and set(x.upper()) <= set("ATCG") and set(y.upper()) <= set("ATCG")
        return align_affine(x, y, p) if good else (None, None, None)

    return F.pandas_udf(_each(kernel, ["aligned1", "aligned2", "score"]), GLOBAL)(col(a), col(b))


def local_hits(a: Column | str, b: Column | str, p: Local = Local()) -> Column:
    names = ["aligned1", "aligned2", "start1", "end1", "start2", "end2", "score"]

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, h)) for h in align_local(s, t, p)] if isinstance(s, str) and isinstance(t, str) else [] for s, t in zip(x, y)])

    return F.pandas_udf(run, LOCAL)(col(a), col(b))


def local_alignments(pairs: DataFrame, p: Local = Local()) -> DataFrame:
    """One row for each hit, numbered from 0 in the order of score."""
    hits = pairs.select("pair_id", F.posexplode(local_hits("seq1", "seq2", p)).alias("hit", "h"))
    return hits.select("pair_id", F.col("hit").cast("long").alias("hit"), "h.*")


def paired_positions(a: Column | str, b: Column | str, start1: Column | str, start2: Column | str) -> Column:
    """array<struct<pos1, pos2>> of the columns without a gap."""
    letters = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    start = F.struct(col(start1).cast("long").alias("i"), col(start2).cast("long").alias("j"), F.array().cast("array<struct<pos1:long,pos2:long>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        both = (r.x != "-") & (r.y != "-")
        cell = F.array(F.struct(s.i.alias("pos1"), s.j.alias("pos2")))
        return F.struct((s.i + (r.x != "-").cast("long")).alias("i"), (s.j + (r.y != "-").cast("long")).alias("j"), F.when(both, F.concat(s.out, cell)).otherwise(s.out).alias("out"))

    return F.aggregate(letters, start, step, lambda s: s.out)


def alignment_path(a: Column | str, b: Column | str) -> Column:
    """Pairs and gaps of a global alignment: array<struct<kind, pos1, pos2>>; a gap stands at the letter before it; double gaps are left out."""
    letters = F.filter(F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda r: (r.x != "-") | (r.y != "-"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.array().cast("array<struct<kind:string,pos1:int,pos2:int>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        kind = F.when(r.x == "-", "gap1").when(r.y == "-", "gap2").when(r.x == r.y, "match").otherwise("mismatch")
        cell = F.struct(kind.alias("kind"), F.when(r.x == "-", F.greatest(s.i - 1, F.lit(0))).otherwise(s.i).alias("pos1"), F.when(r.y == "-", F.greatest(s.j - 1, F.lit(0))).otherwise(s.j).alias("pos2"))
        return F.struct((s.i + (r.x != "-").cast("int")).alias("i"), (s.j + (r.y != "-").cast("int")).alias("j"), F.concat(s.out, F.array(cell)).alias("out"))

    return F.aggregate(letters, start, step, lambda s: s.out)


#: Cells of small matrices that are handed on at once, and tasks of matrices for each shuffle partition.
CELLS, SPREAD = 1 << 18, 8


def matrix_cells(pairs: DataFrame, p: Linear = Linear(), local: bool = False) -> DataFrame:
    """pair_id, i, j, score of every cell, for display.

    Pairs of a batch share their steps, shorter ones filled up to the longest:
    a cell depends on the letters before it alone, so what lies beyond the end
    of a pair is made and left out. Filled up, they have at most CELLS cells.
    """

    def together(n: list[int], m: list[int]) -> Iterator[list[int]]:
        some, rows, width = [], 0, 0
        for k in sorted(range(len(n)), key=lambda k: (n[k], m[k])):
            rows, width = max(rows, n[k] + 1), max(width, m[k] + 1)
            if some and (len(some) + 1) * rows * width > CELLS:
                yield some
                some, rows, width = [], n[k] + 1, m[k] + 1
            some.append(k)
        if some:
            yield some

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["pair_id"].to_numpy()
            one, two = batch["seq1"].fillna("").tolist(), batch["seq2"].fillna("").tolist()
            n, m = [len(x) for x in one], [len(x) for x in two]
            for some in together(n, m):
                rows, width = (np.array([x[k] for k in some]) for x in (n, m))
                scores = linear_matrices([one[k].ljust(rows.max()) for k in some], [two[k].ljust(width.max()) for k in some], p, local)
                inside = (np.arange(rows.max() + 1)[:, None] <= rows[:, None, None]) & (np.arange(width.max() + 1) <= width[:, None, None])
                at, i, j = np.nonzero(inside)
                yield pd.DataFrame({"pair_id": ids[np.array(some)[at]], "i": i, "j": j, "score": scores[inside]})

    kind = dict(pairs.dtypes)["pair_id"]
    tasks = SPREAD * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("pair_id", "seq1", "seq2").repartition(tasks, "pair_id")  # Spark would put small pairs into one task, whatever their cells
    return dealt.mapInPandas(run, f"pair_id {kind}, i long, j long, score double")
