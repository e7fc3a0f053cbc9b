"""Matrices of pairs with different lengths are made at once, so small tasks need no pairs with the same lengths."""

import random

import numpy as np
import pandas as pd
import pytest

from strandworks.operators import align
from strandworks.params import Linear


class Here:
    """Runs what a task would run here, one batch for each of ``batches``."""

    dtypes, columns = [("pair_id", "bigint")], ["pair_id", "seq1", "seq2"]

    def __init__(self, spark, batches):
        self.sparkSession, self.batches = spark, batches

    select = repartition = lambda self, *_: self

    def mapInPandas(self, f, _):
        return pd.concat(f(pd.DataFrame(rows, columns=self.columns) for rows in self.batches))


@pytest.mark.parametrize("local", [False, True])
def test_all_lengths_at_once(spark, monkeypatch, local):
    rng, made = random.Random(8), []
    word = lambda n: "".join(rng.choice("ACG ") for _ in range(n))
    rows = [(k, word(k), word(3 * k % 41)) for k in range(40)] + [(50, word(700), ""), (51, "", word(900)), (52, word(600), word(700)), (53, None, None)]
    many = align.linear_matrices
    monkeypatch.setattr(align, "linear_matrices", lambda a, b, p, local=False: made.append((len(a), len(a[0]), len(b[0]))) or many(a, b, p, local))
    p = Linear(mismatch=-1.5)
    got = align.matrix_cells(Here(spark, [rows[::2], [], rows[1::2]]), p, local)
    want = {(k, *at): s for k, a, b in rows for at, s in np.ndenumerate(align.linear_matrix(a or "", b or "", p, local))}
    assert len(got) == len(want) and {(r.pair_id, r.i, r.j): r.score for r in got.itertuples()} == want
    assert len(made) <= 8
    assert all(k == 1 or k * (n + 1) * (m + 1) <= align.CELLS for k, n, m in made)
