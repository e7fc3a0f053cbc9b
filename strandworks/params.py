"""Parameters of the operators; ``dataclasses.replace`` updates them."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

BASES = "ATCG"
TRANSITIONS = frozenset(("AG", "GA", "CT", "TC"))


@dataclass(frozen=True)
class Linear:
    match: float = 2
    mismatch: float = -1
    gap: float = -2


@dataclass(frozen=True)
class Local(Linear):
    threshold: float = 5


@dataclass(frozen=True)
class Search(Linear):
    k: int = 3
    min_matches: int = 2
    max_gap: int = 1
    drop: float = 1


@dataclass(frozen=True)
class Diagonal(Linear):
    """Search by diagonals; the seed score is 2 a letter whatever ``match`` says."""

    k: int = 3
    min_matches: int = 2
    max_gap: int = 1
    drop: float = 5
    floor: float = 1


def match_matrix(match: float = 2, mismatch: float = -1) -> dict[str, float]:
    return {a + b: float(match if a == b else mismatch) for a, b in product(BASES, repeat=2)}


def transition_matrix(match: float = 2, transition: float = 0, transversion: float = -2) -> dict[str, float]:
    return {a + b: float(match if a == b else transition if a + b in TRANSITIONS else transversion) for a, b in product(BASES, repeat=2)}


def flat(matrix: dict[str, float]) -> dict[str, float]:
    """All 16 keys; missing ones are 0."""
    return {a + b: float(matrix.get(a + b, 0)) for a, b in product(BASES, repeat=2)}


def matrix_type(matrix: dict[str, float]) -> str:
    m = flat(matrix)
    other = {m[a + b] for a, b in product(BASES, repeat=2) if a != b}
    if len(other) == 1:
        return "Match/Mismatch"
    return "Transition/Transversion" if len({m[t] for t in TRANSITIONS}) == 1 else "Custom"


def is_symmetric(matrix: dict[str, float]) -> bool:
    m = flat(matrix)
    return all(m[a + b] == m[b + a] for a, b in product(BASES, repeat=2))


def scoring_summary(p: Affine) -> dict[str, object]:
    """What is shown of affine parameters: the kind of matrix, the scores of AA and AT, gaps, symmetry."""
    m = flat(p.matrix)
    return {"matrix_type": matrix_type(m), "match_score": m["AA"], "mismatch_score": m["AT"], "gap_open": float(p.gap_open), "gap_extend": float(p.gap_extend), "end_gap": float(p.end_gap), "is_symmetric": is_symmetric(m)}


@dataclass(frozen=True)
class Affine:
    matrix: dict[str, float] = field(default_factory=match_matrix, hash=False)
    gap_open: float = -3
    gap_extend: float = -1
    end_gap: float = -1
