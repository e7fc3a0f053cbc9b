"""Embedding whitening from a compensated covariance.

1. The fit list is every different vector once. Its count and sums are exact.
2. Centred outer products are added up as pairs of doubles (high and low):
   products and sums are split without error (two-product, two-sum), and tasks
   hand on both parts. Partial sums meet by row of the matrix, first within
   salts, so that no task gets more than a share of them.
3. The covariance, a table of its size alone, is reduced to tridiagonal form and
   solved by divide and conquer (LAPACK's syevd, behind numpy's eigh), then
   refined against the matrix in extended precision.
4. Vectors are projected on the leading components; what is left of their
   covariance to the identity is measured over the fit list.

The model holds a mean and the leading components: 8 bytes a component and
dimension. The driver holds one covariance: 16 bytes for each pair of
dimensions.

Defined results: vectors that are null or hold nulls or non-finite numbers are
left out, empty ones have no components and so no rows; vectors of different
lengths are spaces of their own; a component without variance (or whose
variance is lost in rounding) has whitened null; explained is null where there
is no variance at all; deviation is null where it doesn't fit a long; repeated
rows and ids, and null ids, give as many rows; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_small_batches, saved

#: Whole steps of a unit in the vectors that are whitened.
SCALE = 256
COMPONENTS = 4
#: Doubles that one step of the compensated sum works on, and salts between tasks and rows of the matrix.
LANES, SALTS = 1 << 15, 32
#: Share of the largest entry by which eigenvalues must differ to be told apart by refinement.
CLOSE = 1e-6
_SPLIT = 134217729.0


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = a * b
    x, y = a * _SPLIT, b * _SPLIT
    a1, b1 = x - (x - a), y - (y - b)
    a2, b2 = a - a1, b - b1
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def added(high: np.ndarray, low: np.ndarray, p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) + (p + e), again as two parts that don't overlap."""
    s, t = two_sum(high, p)
    t = t + (low + e)
    high = s + t
    return high, t - (high - s)


@dataclass
class Products:
    """Compensated sums of outer products of centred rows: the upper triangle, several rows at once in lanes of their own."""

    mean: tuple[np.ndarray, np.ndarray]
    sums: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        d = len(self.mean[0])
        self.at = np.triu_indices(d)
        self.lanes = max(1, LANES // len(self.at[0]))
        self.sums = [np.zeros((self.lanes, len(self.at[0]))) for _ in range(2)]

    def add(self, rows: np.ndarray) -> None:
        high, low = two_sum(rows, -self.mean[0])
        high, low = two_sum(high, low - self.mean[1])
        for k in range(0, len(rows), self.lanes):
            x, y = high[k : k + self.lanes], low[k : k + self.lanes]
            a, b = x[:, self.at[0]], x[:, self.at[1]]
            p, e = two_product(a, b)
            e = e + a * y[:, self.at[1]] + y[:, self.at[0]] * b
            n = len(x)
            self.sums[0][:n], self.sums[1][:n] = added(self.sums[0][:n], self.sums[1][:n], p, e)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        high, low = self.sums[0][0], self.sums[1][0]
        for k in range(1, self.lanes):
            high, low = added(high, low, self.sums[0][k], self.sums[1][k])
        return high, low


def divided(total: int, n: int) -> tuple[float, float]:
    """total / n of whole numbers as two parts."""
    high = total / n
    a, b = high.as_integer_ratio()
    return high, (total * b - a * n) / (n * b)


@dataclass
class Model:
    n: int
    sums: list[int]
    mean: np.ndarray
    #: One component a column, and what projections are divided by (0: no variance).
    axes: np.ndarray
    roots: np.ndarray
    explained: np.ndarray


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of the symmetric matrix high + low.

    Two steps of refinement in extended precision take the vectors of the
    double solve to the last bits where eigenvalues are apart; those of close
    ones stay as they are, orthogonal and with the least residual.
    """
    values, vectors = np.linalg.eigh(high)
    matrix = high.astype(np.longdouble) + low
    x = vectors.astype(np.longdouble)
    for _ in range(2):
        r = np.eye(len(x)) - x.T @ x
        s = x.T @ matrix @ x
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        size = 2 * (np.linalg.norm((s - np.diag(value)).astype(np.float64)) + float(abs(high).max()) * np.linalg.norm(r.astype(np.float64)))
        apart = np.abs(gap) > max(size, CLOSE * float(abs(high).max()))
        x = x + x @ np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        values = value
    values, vectors = values.astype(np.float64), x.astype(np.float64)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values[order], vectors * np.where(vectors[top, np.arange(len(vectors))] < 0, -1.0, 1.0)


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, floor(scale * c) of each entry as a long, of the rows whose vectors are whole and finite."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * float(scale)).cast("long")).alias("x"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and matrix of the vectors of each length in column ``x``."""
    column = batch.column("x")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        some = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield int(d), at, some.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), d)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Count and exact sums of the vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, at, x in _rows(batch):
                own = total.setdefault(d, [0, np.zeros(d, object)])
                own[0] += len(at)
                safe = len(at) * int(max(abs(int(x.min())), abs(int(x.max())))) < 1 << 62
                own[1] = own[1] + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_pylist([{"d": d, "i": i, "n": n, "s": str(s[i])} for d, (n, s) in total.items() for i in range(d)], pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    found = fit.mapInArrow(run, "d int, i int, n long, s string").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("d", "i").toLocalIterator():  # one row for each dimension
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


def covariance(fit: DataFrame, facts: dict[int, tuple[int, list[int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, and the high and low parts of the covariance, of the vectors of each length."""
    means = {d: tuple(np.array(x) for x in zip(*(divided(s, n) for s in each))) for d, (n, each) in facts.items()}
    shared = fit.sparkSession.sparkContext.broadcast(means)
    schema = "d int, i int, salt int, high array<double>, low array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        found: dict[int, Products] = {}
        for batch in batches:
            for d, _, x in _rows(batch):
                if d not in found:
                    found[d] = Products(shared.value[d])
                found[d].add(x.astype(np.float64))
        salt = TaskContext.get().partitionId() % SALTS
        for d, own in found.items():
            high, low = own.total()
            ends = np.cumsum(np.arange(d, 0, -1))[:-1]
            out = zip(range(d), np.split(high, ends), np.split(low, ends))
            table = [(d, i, salt, h, e) for i, h, e in out]
            yield pa.RecordBatch.from_pydict({"d": pa.array([r[0] for r in table], pa.int32()), "i": pa.array([r[1] for r in table], pa.int32()), "salt": pa.array([r[2] for r in table], pa.int32()), "high": pa.array([r[3] for r in table], pa.list_(pa.float64())), "low": pa.array([r[4] for r in table], pa.list_(pa.float64()))})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        high, low = rows["high"].iloc[0], rows["low"].iloc[0]
        for h, e in zip(rows["high"].iloc[1:], rows["low"].iloc[1:]):
            high, low = added(high, low, h, e)
        return pd.DataFrame({"d": rows["d"].iloc[:1], "i": rows["i"].iloc[:1], "salt": rows["salt"].iloc[:1], "high": [high], "low": [low]})

    parts = fit.mapInArrow(run, schema).groupBy("d", "i", "salt").applyInPandas(merged, schema).groupBy("d", "i").applyInPandas(merged, schema)
    parts = saved(parts, "whitening-products")
    for d, (n, _) in facts.items():
        high, low = np.zeros((d, d)), np.zeros((d, d))
        for r in parts.filter(F.col("d") == d).toLocalIterator():
            high[r.i, r.i :], low[r.i, r.i :] = r.high, r.low
        both = (high.astype(np.longdouble) + low) / n
        both = np.triu(both) + np.triu(both, 1).T
        high = both.astype(np.float64)
        yield d, high, (both - high).astype(np.float64)


def fit_models(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vector in the fit list (x), whose rows are different."""
    facts = sums(fit)
    out = {}
    for d, high, low in covariance(fit, facts):
        n, each = facts[d]
        values, vectors = eigen(high, low)
        trace = float((np.diag(high).astype(np.longdouble) + np.diag(low)).sum())
        k = min(components, d)
        real = values[:k] > max(values[0], 0) * d * np.finfo(float).eps * 4
        out[d] = Model(n, each, np.array([divided(s, n) for s in each]).T, vectors[:, :k], np.where(real, np.sqrt(np.where(real, values[:k], 1)), 0.0), values[:k] / trace if trace > 0 else np.full(k, np.nan))
    return out


def projected(x: np.ndarray, model: Model) -> np.ndarray:
    """The whitened components of rows ``x``; nan where a component has no variance."""
    centred = (x.astype(np.float64) - model.mean[0]) - model.mean[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(model.roots > 0, (centred @ model.axes) / model.roots, np.nan)


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S) squared; None beyond a long."""
    most = model.n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in model.sums)
    if x.shape[1] * most * most < 1 << 63:
        u = model.n * x - np.array(model.sums, np.int64)
        return (u * u).sum(axis=1).tolist()
    u = model.n * x.astype(object) - np.array(model.sums, object)
    return [s if s < 1 << 63 else None for s in (u * u).sum(axis=1)]


def identity_errors(fit: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, for each length."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def moments(about: dict[int, np.ndarray]) -> dict[int, dict[tuple[int, int], float]]:
        centre = fit.sparkSession.sparkContext.broadcast(about)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int, int], float] = {}
            for batch in batches:
                for d, _, x in _rows(batch):
                    w = projected(x, shared.value[d])
                    k = w.shape[1]
                    w = np.column_stack((w - centre.value[d], np.ones(len(w)))) if d in centre.value else np.column_stack((w, np.ones(len(w))))
                    for i in range(k):
                        for j in range(i, k + 1):
                            total[d, i, j] = total.get((d, i, j), 0.0) + float((w[:, i] * w[:, j]).sum())
            yield pa.RecordBatch.from_pylist([{"d": d, "i": i, "j": j, "s": s} for (d, i, j), s in total.items()], pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())]))

        out: dict[int, dict[tuple[int, int], float]] = {}
        for r in fit.mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
            out.setdefault(r.d, {})[r.i, r.j] = r.s / models[r.d].n
        return out

    means = {d: np.array([m[i, len(models[d].roots)] for i in range(len(models[d].roots))]) for d, m in moments({}).items()}
    out = {}
    for d, m in moments(means).items():
        real = np.flatnonzero(models[d].roots > 0).tolist()
        out[d] = max((abs(m[i, j] - (i == j)) for i in real for j in real if i <= j), default=0.0)
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every whole vector and component."""
    rows = whole(in_small_batches(vectors), scale)
    fit = saved(rows.select("x").distinct(), "whitening-fit")
    models = fit_models(fit, components)
    shared = vectors.sparkSession.sparkContext.broadcast((models, identity_errors(fit, models)))
    types = {"vec_id": pa.string(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, errors = shared.value
        for batch in batches:
            for d, at, x in _rows(batch):
                model = models[d]
                w = projected(x, model)
                k = w.shape[1]
                each = np.repeat(np.arange(len(at)), k)
                count = len(each)
                columns = [
                    batch.column("vec_id").take(pa.array(at[each])),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                    np.full(count, model.n, np.int64),
                    pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(at)), from_pandas=True),
                    np.full(count, errors.get(d, 0.0)),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

    out = rows.select(as_text("vec_id"), "x").mapInArrow(run, "vec_id string, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))
