"""Document fingerprints: digests of improbable features in chained Bloom filters.

1. Every window of WINDOW bytes has a level, its empirical entropy. How often
   each level occurs in the whole corpus orders the levels: the rarest ranks
   first, and windows of hardly any entropy rank last.
2. In every SPAN consecutive windows the best ranked one (the first of equals)
   gets a vote; windows with VOTES votes are features. A text in which none has
   so many takes all with a vote. Texts under SHORT bytes hold few windows, so
   all their windows of four bytes (of two, under 16 bytes) are features too.
3. Features go, once each and in the order of the text, into a chain of Bloom
   filters of FILTER bytes with at most FEATURES features each.
4. Two chains compare by the filters of the shorter one: for each the best
   overlap of bits with a filter of the other chain, less the overlap that
   chance gives, over the most that is possible; weighted by their bits.

Long texts are read in slices that overlap by a span, so that memory doesn't
grow with a text, and the features are those of the whole text. Comparing
takes time as the product of the lengths of two chains (about one filter for
1.5 KB of text).

Next documents: rows are dealt by ranges of ids and sorted there; the first
document of each range goes to the range before as well. One shuffle of the
texts, no window over all rows.

Defined results: null texts are empty; an empty text has the fingerprint ''
and likeness 1 to an empty one, 0 to any other; equal texts have equal
fingerprints and likeness 1; rows with the same doc_id follow each other in
the order of a hash of their texts; a null doc_id has no place in the order, so
its text stays as it is and near_next is null; a single document is its own
next one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import as_text, in_small_batches

WINDOW, SPAN, VOTES = 16, 16, 8
#: Texts under so many bytes take short windows as well.
SHORT = 128
#: Bytes of a filter, features in it, bits set for each.
FILTER, FEATURES, HASHES = 256, 160, 5
#: Entropy in bits under which a window says next to nothing.
WEAK = 1.5
#: Bytes of text whose windows are held at once.
CHUNK = 1 << 20
#: Ranges of ids for each shuffle partition, and ids drawn for each range to find its bounds.
RANGES, DRAWN = 4, 32
#: Standard deviations above the overlap of chance from which an overlap counts.
ABOVE = 3.0

_COUNTS = np.arange(WINDOW + 2, dtype=np.float64)
#: c * log2(c) for c equal bytes of a window, in 1/256.
_LEVEL = np.rint(256 * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
_STEP = np.diff(_LEVEL)
LEVELS = int(_LEVEL[WINDOW]) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def levels(data: np.ndarray) -> np.ndarray:
    """The level of each window of ``data``: the sum of c * log2(c) over its bytes, so that a high level is a low entropy.

    A window differs from the one before by the byte that comes and the byte
    that goes, and each changes the sum by how often it is in the rest.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    first = _STEP[before[:WINDOW]].sum()
    change = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    return first + np.concatenate((np.zeros(1, np.int64), np.cumsum(change)))


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, int, int]]]:
    """Groups of (text, bytes, first, past the last byte whose windows count), each of about CHUNK bytes."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            low, high = max(0, at - SPAN), min(len(text), at + CHUNK + SPAN + WINDOW)
            group.append((i, text[low:high], at - low, min(at + CHUNK, len(text)) - low))
            size += high - low
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _joined(group: list[tuple[int, bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a group, each byte's slice, and the bytes left in its slice from it on."""
    data = np.frombuffer(b"".join(g[1] for g in group), np.uint8)
    sizes = np.array([len(g[1]) for g in group])
    owner = np.repeat(np.arange(len(group)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    return data, owner, left


def level_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts have each level."""
    total = np.zeros(LEVELS, np.int64)
    for group in _slices(texts):
        data, owner, left = _joined(group)
        found = levels(data)
        at = np.arange(len(data)) - np.concatenate(([0], np.cumsum([len(g[1]) for g in group])))[owner]
        low, high = (np.array([g[k] for g in group])[owner] for k in (2, 3))
        counted = ((left >= WINDOW) & (at >= low) & (at < high))[: len(found)]
        total += np.bincount(found[counted], minlength=LEVELS)
    return total


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, from its count in the corpus: rare ones first, those of weak windows last."""
    level = np.arange(LEVELS)
    weak = np.log2(WINDOW) - level / (256.0 * WINDOW) < WEAK
    out = np.empty(LEVELS, np.int32)
    out[np.lexsort((level, counts, weak))] = level
    return out


def _selected(group: list[tuple[int, bytes, int, int]], ranks: np.ndarray, votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of each feature of a group, in order."""
    data, owner, left = _joined(group)
    found = levels(data)
    n = len(found) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = (ranks[found].astype(np.int64) << 32) | np.arange(len(found))
    width = 1
    while width < SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    whole = left[:n] >= WINDOW + SPAN - 1
    count = np.bincount(key[whole] & 0xFFFFFFFF, minlength=len(found))
    place = np.flatnonzero(count >= votes)
    of = owner[place]
    start = np.concatenate(([0], np.cumsum([len(g[1]) for g in group])))
    at = place - start[of]
    low, high = (np.array([g[k] for g in group])[of] for k in (2, 3))
    keep = (at >= low) & (at < high)
    place, of = place[keep], of[keep]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place]).view(np.uint64).reshape(-1, WINDOW // 8)
    h = np.zeros(len(place), np.uint64)
    for k in range(words.shape[1]):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return np.array([g[0] for g in group])[of], h


def _short(text: bytes) -> np.ndarray:
    """Hashes of the short windows of a short text."""
    width = 4 if len(text) >= 16 else min(2, len(text))
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.full(len(data) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(257) + data[k : len(data) - width + 1 + k]
    return _mix(h)


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The different features of each text, in the order in which they first come."""

    def gather(some: dict[int, bytes], votes: int) -> dict[int, list[np.ndarray]]:
        names, parts = list(some), {}
        for group in _slices(list(some.values())):
            of, h = _selected(group, ranks, votes)
            bounds = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
            for low, high in zip(bounds, [*bounds[1:], len(of)]):
                parts.setdefault(names[of[low]], []).append(h[low:high])
        return parts

    parts = gather({i: t for i, t in enumerate(texts) if t}, VOTES)
    if none := {i: t for i, t in enumerate(texts) if len(t) >= SHORT and i not in parts}:
        parts |= gather(none, 1)
    out = []
    for i, text in enumerate(texts):
        own = parts.get(i, []) + ([_short(text)] if 0 < len(text) < SHORT else [])
        h = np.concatenate(own) if own else np.zeros(0, np.uint64)
        out.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return out


def chained(hashes: np.ndarray) -> np.ndarray:
    """The chain of filters of a text's features, one row of FILTER bytes each."""
    n = -(-len(hashes) // FEATURES)
    bits = np.zeros((n, 8 * FILTER), bool)
    filter_ = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        bits[filter_, (hashes >> np.uint64(11 * k)) & np.uint64(8 * FILTER - 1)] = True
    return np.packbits(bits, axis=1)


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    return [chained(h) for h in features(texts, ranks)]


def written(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode("ascii")


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER)


def _one_way(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.view(np.uint64), b.view(np.uint64)
    own, other = (np.bitwise_count(z).sum(axis=1, dtype=np.int64).astype(np.float64) for z in (x, y))
    best, bits = np.zeros(len(x)), 8.0 * FILTER
    step = max(1, (1 << 17) // len(y))
    for k in range(0, len(x), step):
        both = np.bitwise_count(x[k : k + step, None, :] & y[None]).sum(axis=2, dtype=np.int64)
        most = np.minimum(own[k : k + step, None], other[None])
        chance = own[k : k + step, None] * other[None] / bits
        floor = chance + ABOVE * np.sqrt(chance * (1 - own[k : k + step, None] / bits) * (1 - other[None] / bits))
        room = most - floor
        share = np.where(room > 0, (both - floor) / np.where(room > 0, room, 1), both == most)
        best[k : k + step] = np.clip(share, 0, 1).max(axis=1)
    return float((best * own).sum() / own.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1 for two chains; 1 for equal ones."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) == len(b):
        return (_one_way(a, b) + _one_way(b, a)) / 2
    return _one_way(a, b) if len(a) < len(b) else _one_way(b, a)


def _bytes(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def learn(docs: DataFrame) -> np.ndarray:
    """The ranks of levels by their counts in all texts; at most LEVELS rows come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            total += level_counts([_bytes(t) for t in batch["text"]])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"level": at, "n": total[at]})

    found = in_small_batches(docs).select("text").mapInPandas(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LEVELS, np.int64)
    counts[found["level"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return ranks_of(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint of every row; with the ``ranks`` of another corpus they compare with its fingerprints."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if ranks is None else ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = digests([_bytes(t) for t in batch["text"]], shared.value)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [written(x) for x in found]})

    rows = in_small_batches(docs).select(as_text("doc_id"), "text").mapInPandas(run, "doc_id string, fingerprint string")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints; null beside a null."""
    return pd.Series([None if x is None or y is None else likeness(read(x), read(y)) for x, y in zip(a, b)], dtype="float64")


def firsts(docs: DataFrame) -> np.ndarray:
    """The greatest id of each range, falling, all of them ids of ``docs``.

    The ranges only deal out the work: their bounds come from a sample of
    DRAWN ids a range. The first is the greatest of all ids.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id is not null")
    n, top = ids.agg(F.count("*"), F.max("doc_id")).first()
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not n:
        return np.zeros(0, np.int64)
    share = min(1.0, ranges * DRAWN / n)
    drawn = np.unique(ids.sample(share, 7).toPandas()["doc_id"].to_numpy(np.int64))[::-1]
    picked = drawn[np.unique(np.linspace(0, len(drawn), ranges, endpoint=False).astype(int))] if len(drawn) else drawn
    return np.concatenate(([top], picked[picked < top])).astype(np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt to parts, in falling order of ids, each part ending with an edge row: the first of the next part."""
    bounds = firsts(docs)
    rising, n = -bounds, len(bounds)

    @F.pandas_udf("array<int>")
    def parts(ids: pd.Series) -> pd.Series:
        x = ids.astype("int64").to_numpy()
        own = np.searchsorted(rising, -x, side="right") - 1
        edge = bounds[own] == x
        return pd.Series([[p, (p - 1) % n] if e else [p] for p, e in zip(own.tolist(), edge.tolist())])

    twin = F.xxhash64("text")
    rows = docs.select("doc_id", "text", twin.alias("twin"))
    known = rows.filter("doc_id is not null").select("*", F.posexplode(parts("doc_id")).alias("edge", "part"))
    lone = rows.filter("doc_id is null").select("*", F.lit(0).alias("edge"), (-1 - F.pmod("twin", F.lit(1 << 20))).cast("int").alias("part"))
    return known.union(lone).repartition("part").sortWithinPartitions("part", "edge", F.desc("doc_id"), "twin").select("part", "edge", as_text("doc_id"), "text")


def against_next(docs: DataFrame, ranks: np.ndarray | None = None, share: int = 3) -> DataFrame:
    """Every row's fingerprint, held against the next document's and against that of its own text with the last 1/``share`` replaced by the next one's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if ranks is None else ranks)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def edited(text: str, following: str) -> str:
        k = len(text) // share
        return text[: len(text) - k] + following[:k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # part, edge, id, text and chain of the row whose next one is to come
        for batch in batches:
            rows = list(zip(batch["part"].tolist(), batch["edge"].tolist(), batch["doc_id"], ["" if not isinstance(t, str) else t for t in batch["text"]]))
            chains = digests([_bytes(r[3]) for r in rows], shared.value)
            rows = [(*r, c) for r, c in zip(rows, chains)]
            wanted = []
            for row in rows:
                if row[0] < 0:
                    wanted.append((row, None))
                else:
                    if last is not None and not last[1]:
                        wanted.append((last, row))
                    last = row
            texts = [a[3] if b is None else edited(a[3], b[3]) for a, b in wanted]
            data = [_bytes(t) for t in texts]
            out = []
            for (a, b), text, own in zip(wanted, data, digests(data, shared.value)):
                near = None if b is None else likeness(a[4], b[4])
                out.append((a[2], len(a[3]), hashlib.sha256(text).hexdigest(), written(a[4]), written(own), likeness(a[4], own), near))
            yield pd.DataFrame(out, columns=columns)

    rows = with_next(in_small_batches(docs)).mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
