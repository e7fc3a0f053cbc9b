"""Kernels against cell-by-cell recurrences, written from the definitions."""

import random
import tracemalloc

import pytest

from strandworks.operators import align, scoring
from strandworks.params import Affine, Linear, Local, match_matrix, transition_matrix

RNG = random.Random(5)


def word(low=1, high=12, letters="ACGT"):
    return "".join(RNG.choices(letters, k=RNG.randint(low, high)))


def plain_global(a, b, p):
    s = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = []
            if i and j:
                options.append((s[i - 1, j - 1] + (p.match if a[i - 1] == b[j - 1] else p.mismatch), 3))
            if i:
                options.append((s[i - 1, j] + p.gap, 2))
            if j:
                options.append((s[i, j - 1] + p.gap, 1))
            if options:
                s[i, j] = max(options)[0]
    x, y, i, j = "", "", len(a), len(b)
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + (p.match if a[i - 1] == b[j - 1] else p.mismatch):
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and s[i, j] == s[i - 1, j] + p.gap:
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return x, y, float(s[len(a), len(b)])


def plain_local_matrix(a, b, p):
    s = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i][j] = max(0, s[i - 1][j - 1] + (p.match if a[i - 1] == b[j - 1] else p.mismatch), s[i - 1][j] + p.gap, s[i][j - 1] + p.gap)
    return s


def plain_local(a, b, p):
    """Every hit by the definition, then those wholly inside an earlier one left out."""
    s = plain_local_matrix(a, b, p)
    cells = sorted(((i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if s[i][j] >= p.threshold), key=lambda c: -s[c[0]][c[1]])
    used, hits = set(), []
    for cell in cells:
        if cell in used:
            continue
        (i, j), cols = cell, []
        while i and j and s[i][j] > 0:
            used.add((i, j))
            sub = p.match if a[i - 1] == b[j - 1] else p.mismatch
            if s[i][j] == s[i - 1][j - 1] + sub:
                i, j = i - 1, j - 1
                cols.append((a[i], b[j], i, j))
            elif s[i][j] == s[i - 1][j] + p.gap:
                i -= 1
                cols.append((a[i], "-", i, None))
            else:
                j -= 1
                cols.append(("-", b[j], None, j))
        cols.reverse()
        while cols and cols[0][0] != cols[0][1]:
            cols.pop(0)
        while cols and cols[-1][0] != cols[-1][1]:
            cols.pop()
        if cols:
            hits.append((cols, s[cell[0]][cell[1]]))
    out, sets = [], []
    for cols, score in hits:
        own = {(c[2], c[3]) for c in cols if None not in c}
        if not any(own <= o for o in sets):
            sets.append(own)
            out.append(("".join(c[0] for c in cols), "".join(c[1] for c in cols), cols[0][2], cols[-1][2] + 1, cols[0][3], cols[-1][3] + 1, float(score)))
    return out


def plain_affine(a, b, p):
    inf = float("-inf")
    n, m = len(a), len(b)
    M, X, Y = ({(i, j): inf for i in range(n + 1) for j in range(m + 1)} for _ in range(3))
    M[0, 0] = 0
    for j in range(1, m + 1):
        Y[0, j] = p.gap_open + p.end_gap if j == 1 else Y[0, j - 1] + p.gap_extend + p.end_gap
    for i in range(1, n + 1):
        X[i, 0] = p.gap_open + p.end_gap if i == 1 else X[i - 1, 0] + p.gap_extend + p.end_gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            M[i, j] = max(M[i - 1, j - 1], X[i - 1, j - 1], Y[i - 1, j - 1]) + p.matrix[a[i - 1] + b[j - 1]]
            X[i, j] = max(M[i - 1, j] + p.gap_open, X[i - 1, j] + p.gap_extend)
            Y[i, j] = max(M[i, j - 1] + p.gap_open, Y[i, j - 1] + p.gap_extend)
    return max(X[n, m] + p.end_gap, Y[n, m] + p.end_gap, M[n, m])


@pytest.mark.parametrize("p", [Linear(), Linear(1, -1, -1), Linear(3, -2, -4), Linear(1.5, -0.5, -0.75)])
def test_global(p):
    for _ in range(150):
        a, b = word(), word()
        assert align.align_global(a, b, p) == plain_global(a, b, p)


@pytest.mark.parametrize("p", [Local(), Local(1, -1, -1, 2), Local(2, -1, -1, 3)])
def test_local(p):
    for _ in range(150):
        a, b = word(1, 14), word(1, 14)
        assert align.align_local(a, b, p) == plain_local(a, b, p)


@pytest.mark.parametrize("p", [Affine(), Affine(transition_matrix(), -5, -2, 0), Affine(match_matrix(1, -3), -2, -1, -2)])
def test_affine(p):
    for _ in range(150):
        a, b = word(), word()
        x, y, best = align.align_affine(a, b, p)
        assert best == plain_affine(a, b, p)
        assert len(x) == len(y) and x.replace("-", "") == a and y.replace("-", "") == b


@pytest.mark.parametrize("p", [Linear(), Linear(1, -1, -1), Linear(1.5, -0.5, -0.75)])
def test_global_with_rows_left_out(p, monkeypatch):
    """Rows made again give the same way back, whatever is held."""
    for held in (1, 40, 300):
        monkeypatch.setattr(align, "KEEP", held)
        for _ in range(40):
            a, b = word(1, 60), word(1, 60)
            assert align.align_global(a, b, p) == plain_global(a, b, p)


@pytest.mark.parametrize("p", [Affine(), Affine(transition_matrix(), -5, -2, 0)])
def test_affine_with_rows_left_out(p, monkeypatch):
    pairs = [(word(1, 60), word(1, 60)) for _ in range(60)]
    whole = [align.align_affine(a, b, p) for a, b in pairs]
    assert [w[2] for w in whole] == [plain_affine(a, b, p) for a, b in pairs]
    for held in (1, 300):
        monkeypatch.setattr(align, "KEEP", held)
        assert [align.align_affine(a, b, p) for a, b in pairs] == whole


@pytest.mark.parametrize(("kernel", "limit"), [(align.align_global, 60), (align.align_affine, 180), (lambda a, b: align.align_local(a, b, Local(threshold=9960))[0], 60)])
def test_long_pairs_hold_no_matrix(kernel, limit):
    """5,000 letters on a side: a matrix of doubles is 200 MB."""
    a = word(5000, 5000)
    b = a[:2500] + a[2510:]
    tracemalloc.start()
    try:
        found = kernel(a, b)
        assert tracemalloc.get_traced_memory()[1] < limit * 1_000_000
    finally:
        tracemalloc.stop()
    assert found[0] == a and found[1].replace("-", "") == b and found[1].count("-") == 10


def test_golden():
    assert align.align_global("ATCGATCG", "ATCGAATCG") == ("ATCG-ATCG", "ATCGAATCG", 14.0)
    assert align.align_global("", "ACGTA") == ("", "ACGTA", 0.0)
    assert align.align_local("", "ACGTA") == []
    p = Linear(0, -1, -1)
    assert align.align_global("KITTEN", "SITTING", p)[2] == -3.0


def test_affine_score_rules(spark):
    rows = spark.createDataFrame([("--ACGT-", "TTACG-A"), ("AC-GT", "A-CGT"), ("--", "AC")], "a string, b string")
    s = [r["s"] for r in rows.select(scoring.affine_score("a", "b").alias("s")).collect()]
    assert [x["gap_openings"] for x in s] == [3, 2, 1]
    assert [x["end_gap_penalty_score"] for x in s] == [-4.0, 0.0, -2.0]
    assert s[2]["identity"] is None
