"""Residues of a pair meet in its row: none is broadcast or shuffled."""

import pytest

from strandworks import queries as Q
from strandworks.operators import dotplot

SF = "/root/testdata/sf0.001"


def test_no_residue_is_joined(spark):
    plan = Q.residue_dots(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("kind", ["PROTEIN", "DNA"])
def test_shared_and_absent_numbers(spark, kind):
    """Rows of one number are one pair; those without a number or a side have no dots."""
    pairs = [(1, "ACDEA", "AEEX"), (1, "KA", "RXA"), (2, "", "A"), (3, None, "A"), (4, "A", None), (None, "A", "A"), (5, "1 C", "C1*")]
    like = "AGST DE NQ RKH ILVM FYW C".split()
    want = []
    for n, one, _ in pairs:
        for m, _, two in pairs:
            for i, a in enumerate(one or "" if n == m and n else ""):
                for j, b in enumerate(two or ""):
                    if a == b or kind == "PROTEIN" and any(a in g and b in g for g in like):
                        want.append((n, i, j, 1.0 if a == b else 0.5))
    got = dotplot.residue_dots(spark.createDataFrame(pairs, "pair_id long, seq1 string, seq2 string"), kind)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5
