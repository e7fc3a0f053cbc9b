"""Matrices of pairs with the same lengths are made at once, with the scores of one after the other."""

import random

import numpy as np
import pytest

from strandworks.operators import align
from strandworks.params import Linear


@pytest.mark.parametrize("local", [False, True])
def test_many_at_once(spark, monkeypatch, local):
    rng, made = random.Random(5), []
    word = lambda n: "".join(rng.choice("ACG\U0001f600") for _ in range(n))
    rows = [(i, word(rng.randrange(4)), word(rng.randrange(4))) for i in range(200)] + [(500, None, "AC"), (501, "", None), (502, word(70), word(90))]
    many = align.linear_matrices
    monkeypatch.setattr(align, "linear_matrices", lambda a, b, p, local=False: made.append(len(a)) or many(a, b, p, local))
    p = Linear(mismatch=-1.5)

    class Here:
        """Runs what a task would run here, to see how often matrices are made."""

        dtypes, sparkSession, columns = [("pair_id", "bigint")], spark, ["pair_id", "seq1", "seq2"]
        select = repartition = lambda self, *_: self

        def mapInPandas(self, f, _):
            import pandas as pd

            return pd.concat(f([pd.DataFrame(rows, columns=self.columns)]))

    got = {(r.pair_id, r.i, r.j): r.score for r in align.matrix_cells(Here(), p, local).itertuples()}
    want = {(k, *at): s for k, a, b in rows for at, s in np.ndenumerate(align.linear_matrix(a or "", b or "", p, local))}
    assert got == want and len(made) < 25
    df = spark.createDataFrame(rows, "pair_id long, seq1 string, seq2 string")
    assert {(r.pair_id, r.i, r.j): r.score for r in align.matrix_cells(df, p, local).collect()} == want
