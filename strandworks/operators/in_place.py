"""Seeds and extensions of few short queries, told where the databases lie.

A helper holds the letters of the queries and reads whole databases batch by
batch. Places of a database find the places of their word in the queries in a
list by word and letter before it, so that only the first matches of runs are
ever made for seeds by diagonal; how far two places agree is told by 20 letters
at once. Live seeds put all matches of some databases in order. Spark gets what
is asked for: seeds, extensions, or what they tell of their pair. No match and
no seed is sorted, shuffled or written by Spark.

A task holds some databases of ``CELLS`` letter pairs in all, or one longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..params import Diagonal, Search
from . import overlaps
from .extension import along, moved
from .packed import CODED, REACH, Sizes, dealt

#: Letters of queries times letters of databases that are met at once.
CELLS = 1 << 27
#: Matches that are made at once.
AT_ONCE = 1 << 19
#: Rows of a batch that goes to Spark.
ROWS = 1 << 16
#: Letters of databases that a helper can hold at once; longer ones are left to Spark's sorts.
LONGEST = 1 << 22
#: Places between sequences: more than is looked at beyond an end.
BETWEEN = 3 * REACH
#: One bit for each letter of a long.
ONES = int("1" * REACH, 8)
#: Words of so many letters have a table of all, others a sorted list.
TABLE = 7


class Letters:
    """Sequences one behind the other: ``text``, ``code`` (``outside`` for letters without one and between sequences), ``start`` and ``size`` of each, and ``ahead``, the REACH letters from each place on."""

    def __init__(self, texts: pa.Array, outside: int) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        if pc.sum(pc.binary_length(texts)).as_py() != pc.sum(pc.utf8_length(texts)).as_py():
            texts = pc.replace_substring_regex(texts, "[^\\x00-\\x7f]", "?")  # a place is a letter, not a byte
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.size = np.diff(offsets)
        self.start = offsets[:-1] - offsets[0] + BETWEEN * (1 + np.arange(len(texts)))
        raw = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.text = np.zeros(len(raw) + BETWEEN * (len(texts) + 1), np.uint8)
        self.of = np.repeat(np.arange(-1, len(texts)), np.concatenate([[BETWEEN], self.size + BETWEEN]))
        self.text[np.arange(len(raw)) + np.repeat(BETWEEN * (1 + np.arange(len(texts))), self.size)] = raw
        codes = np.full(256, outside, np.uint8)
        codes[np.frombuffer(CODED.encode(), np.uint8)] = np.arange(len(CODED))
        self.code = codes[self.text]
        self.plain = int(np.count_nonzero(self.code == outside)) == BETWEEN * (len(texts) + 1)  # all letters have a code
        on = lambda x, n: np.concatenate([x[n:], np.full(min(n, len(x)), x[-1])])
        two = self.code.astype(np.int64) << 3 | on(self.code, 1)
        four = two << 6 | on(two, 2)
        eight = four << 12 | on(four, 4)
        self.ahead = (eight << 24 | on(eight, 8)) << 12 | on(four, 16)

    def words(self, k: int) -> np.ndarray:
        return self.ahead >> 3 * (REACH - k)

    def coded(self, k: int, outside: int) -> np.ndarray:
        """Places from which ``k`` letters have a code."""
        bad = np.concatenate([[0], np.cumsum(self.code == outside)])
        return np.flatnonzero(bad[k:] == bad[:-k])


class Listed:
    """Places of the queries by a number of what begins there and the letter before."""

    def __init__(self, q: Letters, numbers: np.ndarray, places: np.ndarray) -> None:
        before = q.code[places - 1].astype(np.int64)
        order = np.lexsort((places, before, numbers))
        self.places = places[order].astype(np.int32)
        # where each number and letter begin
        self.begin = np.searchsorted((numbers * 8 + before)[order], np.arange(8 * (numbers.max(initial=-1) + 1) + 1)).astype(np.int32)

    def met(self, numbers: np.ndarray, at: np.ndarray, d: Letters, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of both sides with one number; with ``first`` alone those whose letters before differ."""
        low, high = self.begin[8 * numbers], self.begin[8 * numbers + 8]
        if first:
            before = 8 * numbers + d.code[at - 1]  # letters of databases without a code have 7: no query has
            skip, step = self.begin[before], self.begin[before + 1] - self.begin[before]
        else:
            skip, step = high, np.zeros_like(high)
        n = high - low - step
        done = np.cumsum(n, dtype=np.int64)
        i = 0
        while i < len(n):
            stop = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + AT_ONCE, "right")))
            own = n[i:stop]
            row = np.repeat(np.arange(i, stop, dtype=np.int32), own)
            place = np.arange(len(row), dtype=np.int32) - np.repeat(np.cumsum(own, dtype=np.int32) - own - low[i:stop], own)
            if first:
                place += np.where(place >= skip[row], step[row], np.int32(0))
            yield self.places[place].astype(np.int64), at[row]
            i = stop


def _number(words: np.ndarray, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that numbers words as in the sorted ``words``, -1 for others."""
    if k <= TABLE:
        table = np.full(1 << 3 * k, -1, np.int32)
        table[words] = np.arange(len(words))
        return lambda x: table[x]

    def number(x: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        return np.where(words[at] == x, at, -1)

    return number


def _leading(x: np.ndarray) -> np.ndarray:
    """How many letters agree at first, of the exclusive or of two longs."""
    marks = (x | x >> 1 | x >> 2) & ONES
    top = (marks.astype(np.float64).view(np.int64) >> 52) - 1023  # the highest bit
    return np.where(marks == 0, REACH, REACH - 1 - (top * 43 >> 7))  # a third of it


@dataclass
class Found:
    """Seeds of some databases by pair and seed_id: places of both sides where they begin and end (inclusive), matches, their query and database, diagonal and number in the pair."""

    q_at: np.ndarray
    d_at: np.ndarray
    q_end: np.ndarray
    d_end: np.ndarray
    n: np.ndarray
    query: np.ndarray
    db: np.ndarray
    seed_id: np.ndarray
    heads: np.ndarray  #: the first seed of each pair
    pieces: pa.Array | None = None


class Meeting:
    """Matches and seeds of the queries and some databases."""

    def __init__(self, texts: pa.Array, p: Search | Diagonal) -> None:
        self.p, self.q, self.steps, self.matches = p, Letters(texts, 6), None, None
        self.by_diagonal = isinstance(p, Diagonal)
        word = p.k + 1 if self.by_diagonal and p.min_matches > 1 else p.k
        self.listed, self.number = self._list(word), _number(self.known, word)
        self.apart = []
        if self.by_diagonal and p.min_matches > 1 and p.max_gap > 0:
            _, self.single = self._list(p.k), _number(self.known, p.k)
            self.singles = len(self.known)
            for j in range(1, p.max_gap + 1):
                places = np.intersect1d(self.q.coded(p.k, 6), self.q.coded(p.k, 6) - p.k - j)
                places = places[self.q.of[places] == self.q.of[places + p.k + j]]
                both = self._both(self.q, places, j)
                keys, numbers = np.unique(both, return_inverse=True)
                self.apart.append((j, _number(keys, REACH), Listed(self.q, numbers, places)))

    def _list(self, word: int) -> Listed:
        places = self.q.coded(word, 6)
        self.known, numbers = np.unique(self.q.words(word)[places], return_inverse=True)
        return Listed(self.q, numbers.astype(np.int64), places)

    def _both(self, s: Letters, places: np.ndarray, j: int) -> np.ndarray:
        """The numbers of the words at ``places`` and ``j`` letters behind them, as one."""
        words = s.words(self.p.k)
        one, two = (self.single(words[at]).astype(np.int64) for at in (places, places + self.p.k + j))
        return np.where((one < 0) | (two < 0), -1, one * self.singles + two)

    def differ(self, P: np.ndarray, D: np.ndarray) -> np.ndarray:
        return self.q.ahead[P] ^ self.d.ahead[D]

    def equal(self, P: np.ndarray, D: np.ndarray) -> np.ndarray:
        """How many letters agree from these places on."""
        out = _leading(self.differ(P, D))
        more = np.flatnonzero(out == REACH)
        while len(more):
            e = _leading(self.differ(P[more] + out[more], D[more] + out[more]))
            out[more] += e
            more = more[e == REACH]
        return out

    def _next(self, x: np.ndarray) -> np.ndarray:
        """Letters to the first k-mer that agrees within the gap, -1 if none does."""
        k, out = self.p.k, np.full(len(x), -1)
        for j in reversed(range(self.p.max_gap)):
            out[x >> 3 * (REACH - j - k) & (1 << 3 * k) - 1 == 0] = j
        return out

    def _own(self, P: np.ndarray, D: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the queries that the task of the database has."""
        if not self.shared:
            return P, D
        db = self.d.of[D]
        own = self.q.of[P] % self.tasks[db] == self.task[db]
        return P[own], D[own]

    def _first(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where runs begin that may be seeds and have none before them within the gap."""
        k, gap, same = self.p.k, self.p.max_gap, (1 << 3 * self.p.k) - 1

        def alone(P: np.ndarray, D: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            P, D = self._own(P, D)
            if gap < 1:
                return P, D
            y, near = self.differ(P - REACH, D - REACH), np.zeros(len(P), bool)
            for j in range(1, gap + 1):
                near |= y >> 3 * j & same == 0
            return P[~near], D[~near]

        word = k + 1 if self.p.min_matches > 1 else k
        numbers = self.number(self.d.words(word))
        at = np.flatnonzero(numbers >= 0)
        for P, D in self.listed.met(numbers[at].astype(np.int64), at, self.d, True):
            yield alone(P, D)
        for j, number, listed in self.apart:  # one match that is followed after a gap of j
            both = self._both(self.d, self.one, j)
            at, both = self.one[both >= 0], both[both >= 0]
            numbers = number(both)
            at, numbers = at[numbers >= 0], numbers[numbers >= 0]
            for P, D in listed.met(numbers.astype(np.int64), at, self.d, True):
                x = self.differ(P, D)
                lone = (x >> 3 * (REACH - 1 - k) & 7 != 0) & (self._next(self.differ(P + k + 1, D + k + 1)) == j - 1)
                yield alone(P[lone], D[lone])

    def _on_diagonals(self, pieces: bool) -> Found:
        k, some, parts = self.p.k, [], []
        for P, D in self._first():
            length = self.equal(P, D)
            n, end = length - k + 1, length
            on = np.arange(len(P))
            runs = [(on, np.zeros(len(P), np.int64), n.copy())]
            while self.p.max_gap > 0 and len(on):
                at = end[on] + 1
                step = self._next(self.differ(P[on] + at, D[on] + at))
                on, at = on[step >= 0], (at + step)[step >= 0]
                e = self.equal(P[on] + at, D[on] + at)
                n[on] += e - k + 1
                end[on] = at + e
                if len(on):
                    runs.append((on, at, e - k + 1))
            good = n >= self.p.min_matches
            if pieces:
                whose = np.concatenate([r[0] for r in runs])
                order = np.argsort(whose, kind="stable")
                order = order[good[whose[order]]]
                at, many = (np.concatenate([r[i] for r in runs])[order] for i in (1, 2))
                parts.append((np.bincount(whose, minlength=len(P))[good], at, many))
            some.append((P[good], D[good], n[good], end[good]))
        P, D, n, end = (np.concatenate([s[i] for s in some]) if some else np.zeros(0, np.int64) for i in range(4))
        query, db = self.q.of[P], self.d.of[D]
        start = P - self.q.start[query]
        diagonal = D - self.d.start[db] - start
        # diagonals come as from 0 upwards, then the negative ones in the order of their first match
        turn, below = diagonal.copy(), np.flatnonzero(diagonal < 0)
        seen = self._seen(self.q.start[query[below]] - diagonal[below], self.d.start[db[below]])
        wide = int(self.q.size.max(initial=0)) + 1
        turn[below] = max(0, int(diagonal.max(initial=0))) + 1 + (seen - diagonal[below]) * wide + seen
        order = _order(db, query, turn, start)
        P, D, end, query, db = P[order], D[order], end[order], query[order], db[order]
        heads, seed_id = _in_pairs(db, query)
        made = None
        if pieces:
            count = np.concatenate([c for c, *_ in parts]) if parts else np.zeros(0, np.int64)
            at, many = (np.concatenate([s[i] for s in parts]) if parts else np.zeros(0, np.int64) for i in (1, 2))
            low, own = np.cumsum(count) - count, count[order]
            inside = np.arange(own.sum()) + np.repeat(low[order] - (np.cumsum(own) - own), own)
            values = pa.StructArray.from_arrays([pa.array(at[inside] + np.repeat(start[order], own)), pa.array(many[inside].astype(np.int32))], ["query_pos", "n"])
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), values)
        return Found(P, D, P + end - 1, D + end - 1, n[order], query, db, seed_id, heads, made)

    def _seen(self, P: np.ndarray, D: np.ndarray) -> np.ndarray:
        """Letters to the first match of a diagonal that has one, from its first place on."""
        k, out = self.p.k, np.zeros(len(P), np.int64)
        on = np.arange(len(P))
        while len(on):
            x, step = self.differ(P[on] + out[on], D[on] + out[on]), np.full(len(on), REACH - k + 1)
            for j in reversed(range(REACH - k + 1)):
                step[x >> 3 * (REACH - j - k) & (1 << 3 * k) - 1 == 0] = j
            out[on] += step
            on = on[step > REACH - k]
        return out

    def _live(self) -> Found:
        """Runs over all diagonals, in the order of both places; all matches of the databases are put in order."""
        p = self.p
        some = list(self.met(False))
        P, D = (np.concatenate([s[i] for s in some]) if some else np.zeros(0, np.int64) for i in range(2))
        wide = len(self.q.code)
        # one number for all: the query, the place of the database (and so the database), the place of the query
        bits = [max(1, int(n)).bit_length() for n in (len(self.q.size), len(self.d.code), wide)]
        if sum(bits) > 62:
            raise ValueError("databases are too long to be held at once")
        key = (self.q.of[P] << bits[1] | D) << bits[2] | P
        key.sort()
        P, D = key & (1 << bits[2]) - 1, key >> bits[2] & (1 << bits[1]) - 1
        query, db = key >> bits[1] + bits[2], self.d.of[D]
        q_step, d_step = np.diff(P), np.diff(D)
        reach = p.k + p.max_gap
        close = (np.diff(query) == 0) & (np.diff(db) == 0) & (np.abs(q_step - d_step) <= p.max_gap) & (q_step <= reach) & (d_step <= reach)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(P)), bool), ~close]))
        last = np.append(first[1:], len(P))[: len(first)] - 1
        good = last - first + 1 >= p.min_matches
        first, last = first[good], last[good]
        heads, seed_id = _in_pairs(db[first], query[first])
        self.matches = P, D, query, db
        return Found(P[first], D[first], P[last] + p.k - 1, D[last] + p.k - 1, last - first + 1, query[first], db[first], seed_id, heads)

    def met(self, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all matches, or of the ``first`` ones of runs."""
        numbers = self.number(self.d.words(self.p.k))
        at = np.flatnonzero(numbers >= 0)
        for P, D in self.listed.met(numbers[at].astype(np.int64), at, self.d, first):
            yield self._own(P, D)

    def spelled(self) -> pa.Array:
        """The k-mers by number."""
        shifts = 3 * np.arange(self.p.k - 1, -1, -1)
        codes = self.known[:, None] >> shifts & 7
        text = np.frombuffer(CODED.encode(), np.uint8)[codes].ravel()
        return pa.StringArray.from_buffers(len(self.known), pa.py_buffer(np.arange(len(self.known) + 1, dtype=np.int32) * self.p.k), pa.py_buffer(text))

    def first_of(self, s: Letters) -> np.ndarray:
        """Whether a k-mer is the first of its kind in its sequence."""
        numbers = self.number(s.words(self.p.k))
        at = np.flatnonzero(numbers >= 0)
        out = np.zeros(len(numbers), bool)
        out[at[np.unique(s.of[at] * len(self.known) + numbers[at], return_index=True)[1]]] = True
        return out

    def meet(self, d: Letters, tasks: np.ndarray, task: np.ndarray, pieces: bool, seeds: bool = True) -> Found | None:
        """The seeds of some databases, if they are asked for."""
        self.d, self.tasks, self.task, self.shared = d, tasks, task, bool((tasks > 1).any())
        if not seeds:
            return None
        if self.apart:
            self.one = np.flatnonzero(self.single(d.words(self.p.k)) >= 0)
        return self._on_diagonals(pieces) if self.by_diagonal else self._live()


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order by ``keys``, which aren't negative."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    one = keys[0]
    for key, b in zip(keys[1:], bits[1:]):
        one = one << b | key
    return np.argsort(one)


def _in_pairs(db: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each pair and the number of each row in its pair, of rows by pair."""
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(db)), bool), (np.diff(db) != 0) | (np.diff(query) != 0)]))
    return heads, np.arange(len(db)) - np.repeat(heads, np.diff(np.append(heads, len(db))))


def spans(f: Found, m: Meeting) -> dict[str, np.ndarray]:
    """query_start, query_end, db_start and db_end of seeds."""
    q, d = m.q.start[f.query], m.d.start[f.db]
    return {"query_start": f.q_at - q, "query_end": f.q_end - q, "db_start": f.d_at - d, "db_end": f.d_end - d}


def scores(f: Found, m: Meeting) -> np.ndarray:
    return f.n * m.p.k * (2.0 if m.by_diagonal else float(m.p.match))


Columns = dict[str, "np.ndarray | pa.Array"]
#: Gives columns of seeds, or with ``query`` and ``db`` those of other rows.
Teller = Callable[[Found, Meeting, dict], Iterator[Columns]]


def seeds(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """All of them, or those with the number ``only``; with ``pieces`` what they are made of."""
    rows = {**spans(f, m), "seed_id": f.seed_id, "match_count": f.n}
    if "only" in given:
        own = np.flatnonzero(f.seed_id == given["only"])
        rows = {name: c[own] for name, c in {**rows, "query": f.query, "db": f.db}.items()}
    if given.get("pieces"):
        rows["pieces"] = f.pieces.take(pa.array(own)) if "only" in given else f.pieces
    yield rows


SEEDS = "query_start: long, query_end: long, db_start: long, db_end: long, seed_id: long, match_count: long"
PIECES = SEEDS + ", pieces: array<struct<query_pos: bigint, n: int>>"


@dataclass
class Grown:
    """Extensions of seeds: where they begin and end on both sides, walks, scores, and equal letters (-1 for spans of unlike lengths)."""

    q_at: np.ndarray
    d_at: np.ndarray
    q_end: np.ndarray
    d_end: np.ndarray
    left: dict[str, np.ndarray]
    right: dict[str, np.ndarray]
    seed_score: np.ndarray
    score: np.ndarray
    same: np.ndarray


class Steps:
    """Where walks stand after at most ``MOST`` letters, for each way in which these agree and each number of letters: walks of all ways, walked once."""

    MOST = 12

    def __init__(self, rules: tuple) -> None:
        ways = np.arange(1 << self.MOST)
        letters = (ways[:, None] >> np.arange(self.MOST) & 1).astype(np.uint8).ravel()
        of_n = [along(letters, np.ones_like(letters), ways * self.MOST, ways * self.MOST, np.full(len(ways), n), 1, *rules) for n in range(self.MOST + 1)]
        self.told = {name: np.concatenate([w[name] for w in of_n]) for name in of_n[0]}
        six = np.arange(1 << 18)
        agree = [six >> 3 * i & 7 == 0 for i in range(6)]
        # how six letters agree, one bit each, the first of them lowest: with the first one in the high or in the low bits of a long
        self.high, self.low = (sum((x.astype(np.uint16) << i for i, x in enumerate(a)), np.uint16(0)) for a in (agree[::-1], agree))


def _walk(m: Meeting, P: np.ndarray, D: np.ndarray, room: np.ndarray, sign: int, rules: tuple) -> dict[str, np.ndarray]:
    """``along`` from places of both sides; the first letters are looked up where all letters have a code."""
    if not (m.q.plain and m.d.plain):
        return along(m.q.text, m.d.text, P, D, room, sign, *rules)
    if m.steps is None:
        m.steps = Steps(rules)
    some = (1 << 18) - 1
    if sign > 0:
        x = m.differ(P, D)
        one, two = m.steps.high[x >> 3 * (REACH - 6) & some], m.steps.high[x >> 3 * (REACH - 12) & some]
    else:
        x = m.differ(P - (REACH - 1), D - (REACH - 1))
        one, two = m.steps.low[x & some], m.steps.low[x >> 18 & some]
    way = np.minimum(room, Steps.MOST) << Steps.MOST | (two << 6 | one)
    out = {name: c[way] for name, c in m.steps.told.items()}
    more = np.flatnonzero(~out["stop"] & (room > Steps.MOST))
    for name, c in along(m.q.text, m.d.text, P[more], D[more], room[more], sign, *rules).items():
        out[name][more] = c
    return out


def _grown(f: Found, m: Meeting) -> Grown:
    p, q, d, s = m.p, m.q, m.d, spans(f, m)
    rules = (float(p.match), float(p.mismatch), float(p.drop), float(p.floor) if m.by_diagonal else None)
    left = _walk(m, f.q_at - 1, f.d_at - 1, np.minimum(s["query_start"], s["db_start"]), -1, rules)
    room = np.minimum(q.size[f.query] - s["query_end"], d.size[f.db] - s["db_end"]) - 1
    right = _walk(m, f.q_end + 1, f.d_end + 1, room, 1, rules)
    q_at, d_at, q_end, d_end = f.q_at - left["at"], f.d_at - left["at"], f.q_end + right["at"], f.d_end + right["at"]
    core = f.q_end - f.q_at + 1
    same = np.where(core == f.d_end - f.d_at + 1, core, -1)
    # a run on one diagonal is of equal letters; others are looked at
    other = same >= 0 if rules[0] == rules[1] else (same >= 0) & ((f.n != core - p.k + 1) if m.by_diagonal else (_leading(m.differ(f.q_at, f.d_at)) < core))
    other = np.flatnonzero(other)
    same[other] = _same(q.text, d.text, f.q_at[other], f.d_at[other], core[other])
    gained = np.zeros(len(same), np.int64)
    for walk, a, b in ((left, q_at, d_at), (right, f.q_end + 1, f.d_end + 1)):
        if rules[0] == rules[1]:
            gained += _same(q.text, d.text, a, b, walk["at"].astype(np.int64))
        else:  # its score tells how many of its letters are equal
            gained += np.rint((walk["best"] - rules[1] * walk["at"]) / (rules[0] - rules[1])).astype(np.int64)
    score = scores(f, m)
    return Grown(q_at, d_at, q_end, d_end, left, right, score, score + left["best"] + right["best"], np.where(same < 0, -1, same + gained))


def _inside(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` places from each start on."""
    ends = np.cumsum(n)
    return np.arange(n.sum()) + np.repeat(start - (ends - n), n)


def _same(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of ``n`` letters agree."""
    equal = np.concatenate([[0], np.cumsum(a[_inside(a_at, n)] == b[_inside(b_at, n)])])
    ends = np.cumsum(n)
    return equal[ends] - equal[ends - n]


def _cut(text: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(text[_inside(start, n)]))


def _ranks(f: Found, *keys: np.ndarray) -> np.ndarray:
    """Number of each row in its pair in the order of ``keys``, then of seed_id."""
    pair = np.repeat(np.arange(len(f.heads)), np.diff(np.append(f.heads, len(f.n))))
    out = np.empty(len(pair), np.int64)
    out[np.lexsort((f.seed_id, *keys[::-1], pair))] = f.seed_id  # numbers of each pair stand in their order
    return out


def extensions(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """With ``texts`` the letters of both sides, with ``ranked`` final_id."""
    g = _grown(f, m)
    out = {**spans(f, m), "seed_id": f.seed_id, "match_count": f.n, "same": pa.array(g.same, mask=g.same < 0)}
    for side, walk in (("left", g.left), ("right", g.right)):
        out |= {f"{side}_{name}": walk[name] for name in ("best", "at", "stop", "fell")}
    if given["texts"]:
        out |= {"query_alignment": _cut(m.q.text, g.q_at, g.q_end - g.q_at + 1), "db_alignment": _cut(m.d.text, g.d_at, g.d_end - g.d_at + 1)}
    if given["ranked"]:
        out["final_id"] = _ranks(f, -g.score, -g.seed_score)
    yield out


_WALK = ", ".join(f"{side}_{c}" for side in ("left", "right") for c in ("best: double", "at: int", "stop: boolean", "fell: boolean"))


def _firsts(f: Found, by: np.ndarray) -> np.ndarray:
    """The seed_id of the highest whole number ``by`` of each pair, the first of several."""
    return -np.maximum.reduceat((by << 32) - f.seed_id, f.heads) & (1 << 32) - 1


def statistics(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """``seeds.seed_statistics`` of seeds by diagonal."""
    if not len(f.heads):
        return
    s, of = spans(f, m), lambda x: np.add.reduceat(x, f.heads)
    n, length, diagonal = of(np.ones(len(f.n), np.int64)), s["query_end"] - s["query_start"] + 1, s["db_start"] - s["query_start"]
    other = np.concatenate([[True], np.diff(diagonal) != 0])  # those of one diagonal follow each other
    other[f.heads] = True
    yield {
        "query": f.query[f.heads], "db": f.db[f.heads], "seeds": n, "average_score": of(scores(f, m)) / n, "average_length": of(length) / n,
        "longest": _firsts(f, length), "highest": _firsts(f, f.n), "total_matches": of(f.n), "diagonals": of(other.astype(np.int64)),
    }


STATISTICS = "seeds: long, average_score: double, average_length: double, longest: long, highest: long, total_matches: long, diagonals: long"


def _overlaps(f: Found, at: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows and overlaps of the pairs of rows that overlap on both axes, the lower seed_id first."""
    if not len(f.n):
        return
    pair = np.repeat(np.arange(len(f.heads)), np.diff(np.append(f.heads, len(f.n))))
    low = at["db_start"].min()
    order = _order(pair, at["db_start"] - low)
    some = {c: x[order] for c, x in at.items()}
    for a, b, query, db in overlaps._met(pair[order], np.zeros(len(pair), np.int64), order, some, 0, 1 << 40):
        yield order[a], order[b], query, db


def overlapping(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """``seeds.overlapping_pairs`` of seeds or, with ``grown``, of their extensions."""
    at = spans(f, m)
    if given["grown"]:
        g = _grown(f, m)
        at = spans(Found(g.q_at, g.d_at, g.q_end, g.d_end, f.n, f.query, f.db, f.seed_id, f.heads), m)
    for a, b, query, db in _overlaps(f, at):
        yield {"query": f.query[a], "db": f.db[a], "a_seed_id": f.seed_id[a], "b_seed_id": f.seed_id[b], "query_overlap": query, "db_overlap": db}


OVERLAPS = "a_seed_id: long, b_seed_id: long, query_overlap: long, db_overlap: long"


def without_redundant(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """``seeds.without_redundant`` for a ``most`` of 0 or more.

    A seed is dropped as soon as one that it overlaps, and that has its turn
    before it, is kept; it is kept when all of these are dropped.
    """
    at, rank, edges = spans(f, m), _ranks(f, -f.n), [np.zeros((2, 0), np.int64)]
    for a, b, query, db in _overlaps(f, at):
        a, b = np.where(rank[a] < rank[b], (a, b), (b, a))
        size = lambda side: at[f"{side}_end"][b] - at[f"{side}_start"][b] + 1  # noqa: B023, E731
        near = (query / size("query") > given["most"]) & (db / size("db") > given["most"])
        edges.append(np.stack([a[near], b[near]]))
    a, b = np.concatenate(edges, axis=1)
    state = np.ones(len(f.n), np.int8)  # 1 kept, 0 not told yet, -1 dropped
    state[b] = 0
    while len(a):
        state[b[state[a] > 0]] = -1
        left = (state[a] == 0) & (state[b] == 0)
        open_ = b[state[b] == 0]
        a, b = a[left], b[left]
        state[open_] = 1
        state[b] = 0
    kept = np.flatnonzero(state > 0)
    yield {name: c[kept] for name, c in {**at, "seed_id": f.seed_id, "match_count": f.n, "query": f.query, "db": f.db}.items()}


def extension_statistics(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """``seeds.extension_statistics`` of extensions by diagonal."""
    if not len(f.heads):
        return
    g, of = _grown(f, m), lambda x: np.add.reduceat(x, f.heads)
    n, length = of(np.ones(len(f.n), np.int64)), g.q_end - g.q_at + 1
    tenths = np.floor(g.same * 100.0 / length * 10 + 0.5).astype(np.int64)
    best = np.lexsort((f.seed_id, -g.score, np.repeat(np.arange(len(f.heads)), n)))[f.heads]
    low, high = (lambda x: np.minimum.reduceat(x, f.heads)), (lambda x: np.maximum.reduceat(x, f.heads))
    yield {
        "query": f.query[f.heads], "db": f.db[f.heads], "extensions": n, "average_score": of(g.score) / n, "average_length": of(length) / n, "average_identity": of(tenths) / (10 * n),
        "best": f.seed_id[best], "longest": _firsts(f, length), "min_score": low(g.score), "max_score": high(g.score), "min_length": low(length), "max_length": high(length),
    }


EXTENSION_STATISTICS = "extensions: long, average_score: double, average_length: double, average_identity: double, best: long, longest: long, min_score: double, max_score: double, min_length: long, max_length: long"


def top(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """``seeds.top`` of the results: the ``k`` highest scores of each pair."""
    score = _grown(f, m).score
    rank = _ranks(f, -score) + 1
    own = np.flatnonzero((rank <= given["k"]) & (score > 0))  # those without a score come last
    yield {"query": f.query[own], "db": f.db[own], "seed_id": f.seed_id[own], "score": score[own], "rank": rank[own]}


TOP = "seed_id: long, score: double, rank: long"


def summary(f: Found, m: Meeting, given: dict) -> Iterator[Columns]:
    """Of each pair with a match: matches, different k-mers, live seeds, results and their highest score."""
    P, D, query, db = m.matches
    if not len(P):
        return
    heads, _ = _in_pairs(db, query)
    matches = np.diff(np.append(heads, len(P)))
    # a k-mer of both counts where it is the first of its sequence on either side
    unique = np.add.reduceat((m.first_of(m.q)[P] & m.first_of(m.d)[D]).astype(np.int64), heads)
    out = {"query": query[heads], "db": db[heads], "matches": matches, "unique_kmers": unique}
    own = {name: np.zeros(len(heads), np.int64) for name in ("seeds", "results")} | {"best_score": np.zeros(len(heads))}
    if len(f.heads):
        at = np.searchsorted(out["query"] * len(m.d.size) + out["db"], f.query[f.heads] * len(m.d.size) + f.db[f.heads])
        score = _grown(f, m).score
        own["seeds"][at] = np.diff(np.append(f.heads, len(f.n)))
        own["results"][at] = np.add.reduceat((score > 0).astype(np.int64), f.heads)
        own["best_score"][at] = np.maximum(np.maximum.reduceat(score, f.heads), 0.0)
    yield out | own


SUMMARY = "matches: long, unique_kmers: long, seeds: long, results: long, best_score: double"


def _sorted(*keys: np.ndarray) -> list[np.ndarray]:
    """``keys``, which aren't negative, in their order."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        order = np.lexsort(keys[::-1])
        return [k[order] for k in keys]
    one = keys[0].astype(np.int64)
    for key, b in zip(keys[1:], bits[1:]):
        one = one << b | key
    one.sort()
    out = []
    for b in reversed(bits[1:]):
        out.append(one & (1 << b) - 1)
        one = one >> b
    return [one, *reversed(out)]


def diagonals(f: None, m: Meeting, given: dict) -> Iterator[Columns]:
    """Of each diagonal with a match: their number and first and last places, or with ``gaps`` the positive ones between them."""
    some = [(P, D, m.equal(P, D) - m.p.k + 1) for P, D in m.met(True)]
    if not some:
        return
    P, D, n = (np.concatenate([s[i] for s in some]) for i in range(3))
    query, db, wide = m.q.of[P], m.d.of[D], int(m.q.size.max(initial=0))
    start = P - m.q.start[query]
    query, db, line, start, n = _sorted(query, db, D - m.d.start[db] - start + wide, start, n)
    same = (np.diff(line) == 0) & (np.diff(db) == 0) & (np.diff(query) == 0)
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(n)), bool), ~same]))
    if not len(heads):
        return
    diagonal = line[heads] - wide
    out = {"query": query[heads], "db": db[heads], "diagonal": diagonal}
    if given["gaps"]:
        gap = np.zeros(len(n), np.int64)
        gap[1:] = np.where(same, start[1:] - start[:-1] - n[:-1] + 1 - m.p.k, 0)
        gap = np.maximum(gap, 0)
        many, total = np.add.reduceat((gap > 0).astype(np.int64), heads), np.add.reduceat(gap, heads)
        average = pa.array(total / np.maximum(many, 1), mask=many == 0)
        yield out | {"gaps": many, "average_gap": average, "largest_gap": np.maximum.reduceat(gap, heads)}
        return
    last = np.append(heads[1:], len(n)) - 1  # runs of a diagonal don't overlap
    low, high = start[heads], start[last] + n[last] - 1
    yield out | {"n": np.add.reduceat(n, heads), "min_query": low, "max_query": high, "min_db": low + diagonal, "max_db": high + diagonal}


DIAGONALS = "diagonal: long, n: long, min_query: long, max_query: long, min_db: long, max_db: long"
GAPS = "diagonal: long, gaps: long, average_gap: double, largest_gap: long"


def dense(f: None, m: Meeting, given: dict) -> Iterator[Columns]:
    """``matches.dense``: windows of the database whose matches are ``least`` of their width or more."""
    window, k = given["window"], m.p.k
    some = [(m.q.of[P], D) for P, D in m.met(False)]
    if not some or window < k:
        return
    query, D = _sorted(*(np.concatenate([s[i] for s in some]) for i in range(2)))
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(D)), bool), (np.diff(D) != 0) | (np.diff(query) != 0)]))
    query, D, n = query[heads], D[heads], np.diff(np.append(heads, len(D)))
    # one more at the first window of a match, one fewer after the last
    first = np.maximum(D - (window - k), m.d.start[m.d.of[D]])
    most = int(n.max(initial=0))
    query, at, step = _sorted(np.concatenate([query, query]), np.concatenate([first, D + 1]), np.concatenate([most + n, most - n]))
    inside = np.cumsum(step - most)
    density = inside / float(window)
    on = np.flatnonzero((inside > 0) & (density >= given["least"]))  # never the last step of a pair
    db = m.d.of[at[on]]
    last = np.minimum(at[on + 1] - 1, m.d.start[db] + m.d.size[db] - window)
    rows = np.maximum(last - at[on] + 1, 0)
    yield {"query": np.repeat(query[on], rows), "db": np.repeat(db, rows), "start": _inside(at[on] - m.d.start[db], rows), "density": np.repeat(density[on], rows)}


DENSE = "start: long, density: double"


def without_close(f: None, m: Meeting, given: dict) -> Iterator[Columns]:
    """``matches.without_close`` for a gap of 1.

    Along a run every other match stays. Matches beside each other that aren't
    of one diagonal have k-mers of one letter or of two by turns; runs with
    such a k-mer are read in order.
    """
    k, q = m.p.k, m.q
    even = np.concatenate([[0], np.cumsum(q.code[2:] != q.code[:-2])])
    turns = np.zeros(len(q.code), bool)
    turns[: len(even) - k + 2] = even[max(0, k - 2) :] == even[: len(even) - max(0, k - 2)] if k > 2 else True
    odd = np.concatenate([[0], np.cumsum(turns)])
    rest = []

    def told(P: np.ndarray, D: np.ndarray) -> Columns:
        query, db = q.of[P], m.d.of[D]
        return {"query": query, "db": db, "query_pos": P - q.start[query], "db_pos": D - m.d.start[db], "kmer": m.spelled().take(pa.array(m.number(q.words(k))[P]))}

    for P, D in m.met(True):
        n = m.equal(P, D) - k + 1
        mixed = odd[P + n] > odd[P]
        rest.append(tuple(x[mixed] for x in (P, D, n)))
        P, D, n = (x[~mixed] for x in (P, D, n))
        half = (n + 1) // 2
        step = 2 * _inside(np.zeros(len(n), np.int64), half)
        yield told(np.repeat(P, half) + step, np.repeat(D, half) + step)
    if not rest:
        return
    P, D, n = (np.concatenate([r[i] for r in rest]) for i in range(3))
    step = _inside(np.zeros(len(n), np.int64), n)
    query, D, P = _sorted(*(lambda P, D: (q.of[P], D, P))(np.repeat(P, n) + step, np.repeat(D, n) + step))
    stays, before, here, own = np.zeros(len(P), bool), set(), set(), (-1, -1)
    for i, (one, d, p) in enumerate(zip(query.tolist(), D.tolist(), P.tolist())):
        if (one, d) != own:
            before = here if own == (one, d - 1) else set()
            here, own = set(), (one, d)
        if p - 1 not in here and p - 1 not in before and p not in before and p + 1 not in before:
            stays[i] = True
            here.add(p)
    yield told(P[stays], D[stays])


CLOSE = "query_pos: long, db_pos: long, kmer: string"


def _scan(texts: bytes, p: Search | Diagonal, teller: Teller, given: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, names = None, ["seq_id"] if given.get("bare") else ["seq_id", "task"]
        for batch in batches:
            if not len(batch):
                continue
            if meeting is None:
                with pa.ipc.open_stream(texts) as stream:
                    of = stream.read_all().combine_chunks()
                ids, sequences = (pa.concat_arrays(of[c].chunks) if of[c].num_chunks else pa.array([], of.schema.field(c).type) for c in ("seq_id", "seq"))
                meeting = Meeting(sequences, p)
                letters = max(1, int(meeting.q.size.sum()))
            done = np.cumsum(pc.fill_null(pc.utf8_length(batch["seq"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(batch):
                stop = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + CELLS // letters, "right")))
                some = batch.slice(i, stop - i)
                tasks, task = (np.asarray(some[c]).astype(np.int64) for c in ("tasks", "task"))
                found = meeting.meet(Letters(some["seq"], 7), tasks, task, bool(given.get("pieces")), not given.get("bare"))
                for columns in teller(found, meeting, given):
                    query, db = (columns.pop(c) if c in columns else getattr(found, c) for c in ("query", "db"))
                    for low in range(0, len(query), ROWS):
                        part = slice(low, low + ROWS)
                        own = some.select(names).take(pa.array(db[part]))
                        arrays = [c[part] if isinstance(c, pa.Array) else pa.array(c[part]) for c in columns.values()]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[part])), *own.columns, *arrays], names=["query_id", *names, *columns])
                found = columns = query = db = arrays = own = meeting.matches = None  # before the next ones are met
                i = stop

    return scan


def told(queries: DataFrame, databases: DataFrame, parts: int, p: Search | Diagonal, teller: Teller, kinds: str, **given: object) -> DataFrame:
    """query_id, db_id, task and the columns ``kinds`` that ``teller`` gives of the seeds of few queries; databases are dealt to ``parts`` partitions.

    What is ``bare`` comes from matches, without seeds and the task.
    """
    rows = queries.select("seq_id", "seq").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    d = dealt(databases, parts).select("seq_id", "task", "tasks", "seq")
    schema = StructType().add("query_id", queries.schema["seq_id"].dataType).add("db_id", d.schema["seq_id"].dataType)
    if not given.get("bare"):
        schema = schema.add("task", d.schema["task"].dataType)
    for field in StructType.fromDDL(kinds):
        schema = schema.add(field.name, field.dataType)
    return d.mapInArrow(_scan(sink.getvalue().to_pybytes(), p, teller, given), schema)


def by_diagonal(rows: DataFrame, p: Diagonal, *keep: str | Column) -> DataFrame:
    """The columns of ``seeds.by_diagonal`` from those of ``seeds``, and those to ``keep``."""
    length = F.col("query_end") - F.col("query_start") + 1
    pieces = ["pieces"] * ("pieces" in rows.columns)
    out = rows.select("query_id", "db_id", "task", (F.col("db_start") - F.col("query_start")).alias("diagonal"), "query_start", "query_end", "db_start", "db_end", "match_count", (F.col("match_count") * p.k * 2.0).alias("score"), *pieces, "seed_id", *keep)
    return out.withColumns({"length": length, "db_length": F.col("db_end") - F.col("db_start") + 1, "density": F.col("match_count") / length, "coverage": F.col("match_count") * p.k / length})


def live(rows: DataFrame, p: Search, *keep: str | Column) -> DataFrame:
    """The columns of ``seeds.live`` from those of ``seeds``, and those to ``keep``."""
    out = rows.select("query_id", "db_id", "task", "seed_id", "query_start", "query_end", "db_start", "db_end", "match_count", (F.col("match_count") * p.k * float(p.match)).alias("score"), *keep)
    return out.withColumn("length", F.col("query_end") - F.col("query_start") + 1)


def extended(queries: DataFrame, databases: DataFrame, parts: int, p: Search | Diagonal, texts: bool = True, ranked: bool = True) -> DataFrame:
    """What ``extension.extended`` gives of the seeds of both sides; letters and final_id where they are wanted."""
    last = ["same"] + ["query_alignment", "db_alignment"] * texts + ["final_id"] * ranked
    kinds = f"{SEEDS}, same: long, {_WALK}" + ", query_alignment: string, db_alignment: string" * texts + ", final_id: long" * ranked
    rows = told(queries, databases, parts, p, extensions, kinds, texts=texts, ranked=ranked)
    walks = (F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("best", "at", "stop", "fell"))).alias(side) for side in ("left", "right"))
    return moved((by_diagonal if isinstance(p, Diagonal) else live)(rows, p, *walks, *last))


def fits(queries: Sizes, databases: Sizes, p: Search | Diagonal) -> bool:
    """Whether all can be told in place: each sequence has a number of its own, no database is beyond LONGEST, and a long tells what follows a gap."""
    return queries.own and databases.own and databases.longest <= LONGEST and 1 - p.k <= p.max_gap < REACH - p.k
