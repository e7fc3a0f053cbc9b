"""MinHash near-dedup with min-max hashing.

1. Sketch: each document's set of distinct five-word shingles gets, under each
   of EVALUATIONS hash functions, both its minimum and its maximum.
2. Equal sets are one class, a numbered node, held by the smallest doc_id.
3. Banding: ROWS values a band. Buckets with several classes are kept.
4. Stars: in each bucket every class is paired with the bucket's hub, the
   class that meets most others. Sketches that agree in less than ESTIMATE
   of the values drop out; the rest are confirmed on the full sets. Buckets
   that still hold several components get one more hub.
5. Rest: what a star cannot rule out. The classes of such buckets join by the
   rarest shingles of their sets (two sets that are similar enough share one
   of these), between components only, and are confirmed on the full sets. So
   a bucket never has all its pairs made, and none is cut short.
6. Components of the confirmed links; doc_id = component_id stays.

Sets are confirmed by hub: the pairs of a hub are dealt to parts of at most
PART, and the hub's set is sent once to each part, not with each pair.

Joins by bucket or hub, of which one may hold most rows, meet tables that are
written first: Spark then knows their size, and where it does not broadcast
them it can still split the hot key (it does so only for a join whose both
sides come straight from a shuffle, without an aggregate in between).

Defined results: words are split at ASCII white space after A-Z are
lower-cased; a text with fewer than five words has one shingle, a null, empty
or blank text has none and links with nothing; rows that share a doc_id are
one document and repeated rows give repeated results; a null doc_id is never
kept and names no component; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_small_batches, saved
from .components import components

WORDS = 5
#: Similarity bound as a fraction: 100 * intersection >= 75 * union.
PERCENT = 75
#: Hash evaluations; each gives a minimum and a maximum. Bands of ROWS values.
EVALUATIONS, ROWS = 80, 4
BANDS = 2 * EVALUATIONS // ROWS
#: Share of equal sketch values below which a pair is dropped: over four standard deviations under PERCENT.
ESTIMATE = 0.6
STARS = 2
#: Pairs of a hub confirmed with one copy of its set.
PART = 256
#: Cells of the table of shingle counts that orders shingles by rarity: a fixed size, so it may be broadcast.
CELLS = 1 << 18
#: Bytes of text sketched at once, and shingles hashed at once.
CHUNK_BYTES, SLICE = 500_000, 1 << 14

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPOT = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = (_rng.integers(0, 1 << 31, EVALUATIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_PLUS = _rng.integers(0, 1 << 32, EVALUATIONS, dtype=np.uint64).astype(np.uint32)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, base: int, name: str) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; empty for a text without words."""
    start = 0
    while start < len(texts):
        parts, size, stop = [], 0, start
        while stop < len(texts) and (not parts or size < CHUNK_BYTES):
            parts.append(texts[stop].encode("utf-8", "surrogatepass").lower())
            size += len(parts[-1]) + 1
            stop += 1
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        letter = np.concatenate(([False], ~blank))
        first = np.flatnonzero(letter[1:] & ~letter[:-1])
        last = np.flatnonzero(letter[:-1] & ~letter[1:])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(len(data), _BASE, "up"))))
        word = _mix((total[last] - total[first]) * _power(len(data), _UNBASE, "down")[first] + (last - first).astype(np.uint64))
        ends = np.cumsum([len(p) + 1 for p in parts])
        bound = np.concatenate(([0], np.searchsorted(first, ends)))
        n = len(word) - WORDS + 1
        windows = _mix(sum(word[k : n + k] * _SPOT[k] for k in range(WORDS))) if n > 0 else word[:0]
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if b - a >= WORDS:
                yield np.unique(windows[a : b - WORDS + 1])
            elif b > a:
                yield _mix(np.array([int((word[a:b] * _SPOT[: b - a]).sum(dtype=np.uint64)) ^ int(_SPOT[WORDS]) * (b - a) & (1 << 64) - 1], np.uint64))
            else:
                yield word[:0]
        start = stop


def min_max(hashes: np.ndarray) -> np.ndarray:
    """2 * EVALUATIONS values: minimum and maximum of each evaluation side by side."""
    low, high = np.full(EVALUATIONS, 0xFFFFFFFF, np.uint32), np.zeros(EVALUATIONS, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), SLICE):
        y = np.multiply.outer(_TIMES, x[k : k + SLICE])
        y += _PLUS[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.stack((low, high), axis=1).ravel()


def sketch(hashes: np.ndarray) -> bytes:
    """``min_max`` with each value hashed to 16 bits."""
    return (_mix(min_max(hashes).astype(np.uint64)) >> np.uint64(48)).astype("<u2").tobytes()


def _texts(batch: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch["text"]]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), sketch(x)) if len(x) else (0, None, None) for x in shingle_sets(_texts(batch))]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "twin": batch["twin"], "n_shingles": [r[0] for r in rows], "set_key": [r[1] for r in rows], "sketch": [r[2] for r in rows]})

    rows = in_small_batches(docs).select(as_text("doc_id"), F.xxhash64("text").alias("twin"), "text")
    return rows.mapInPandas(run, "doc_id string, twin long, n_shingles long, set_key binary, sketch binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, doc_id, hashes of the nodes in ``wanted`` (node, doc_id, twin), once each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "doc_id": batch["doc_id"], "hashes": [x.tobytes() for x in shingle_sets(_texts(batch))]})

    some = docs.select("doc_id", F.xxhash64("text").alias("twin"), "text").join(wanted, ["doc_id", "twin"])
    return some.dropDuplicates(["doc_id", "twin"]).select("node", "doc_id", "text").mapInPandas(run, "node long, doc_id long, hashes binary")


def paired(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with ``column`` of both sides."""
    one = facts.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    two = facts.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(one, "a").join(two, "b")


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in ESTIMATE of the values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), -1) for c in ("of_a", "of_b"))
                yield batch.loc[(x == y).mean(axis=1) >= ESTIMATE, ["a", "b"]]

    return paired(pairs, classes, "sketch").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: the documents of the pairs with 100 * intersection >= PERCENT * union on the full sets."""

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= PERCENT * (len(both) - shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, hub_id, own = None, None, np.zeros(0, np.uint64)  # the hub whose members follow, also in the next batch
        for batch in batches:
            out = []
            for a, member, doc_id, hashes in zip(batch["a"].tolist(), batch["member"].tolist(), batch["doc_id"].tolist(), batch["hashes"]):
                if not member:
                    hub, hub_id, own = a, doc_id, np.frombuffer(hashes, np.uint64)
                elif a == hub and similar(own, np.frombuffer(hashes, np.uint64)):
                    out.append((hub_id, doc_id))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    pairs = saved(pairs, "near-pairs")
    parts = saved(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "near-parts")
    facts = lambda name: sets.select(F.col("node").alias(name), "doc_id", "hashes")
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member")).join(facts("a"), "a")
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(facts("b"), "b").select("a", "part", F.lit(True).alias("member"), "doc_id", "hashes")
    rows = hubs.select(*members.columns).union(members).repartition("a", "part").sortWithinPartitions("a", "part", "member")
    return rows.mapInPandas(run, "a long, b long")


def in_buckets(classes: DataFrame) -> DataFrame:
    """bucket, node, doc_id, n of the buckets that hold several classes, with the number of members."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * width + 1, F.lit(width))))
    rows = classes.select("node", "doc_id", F.col("n_shingles").alias("n"), F.explode(keys).alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return rows.join(saved(full, "near-full"), "bucket")


def stars(rows: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a bucket's hub and every class of it in another component; and the hubs.

    A hub is the class with most meetings; with ``past`` hubs, one whose
    component has given none yet where there is such a class.
    """
    fresh = F.lit(True) if past is None else ~F.col("given")
    best = F.max(F.struct(fresh, "meetings", (-F.col("node")).alias("last"), F.col("doc_id").alias("hub_id"), F.col("component").alias("hub_component"), F.col("n").alias("hub_n")))
    hubs = rows.groupBy("bucket").agg(best.alias("hub")).select("bucket", (-F.col("hub.last")).alias("hub"), "hub.hub_id", "hub.hub_component", "hub.hub_n")
    hubs = saved(hubs, "near-hubs")
    met = rows.join(hubs, "bucket").filter("component <> hub_component")
    met = met.filter(100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n"))
    return met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), hubs


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many ``hashes`` each of CELLS cells occurs. The driver gets one row of bytes from each task, not a row object for each cell."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for x in batch["hashes"]:
                np.add.at(total, (np.frombuffer(x, np.uint64) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [batch[["cell", "n"]].to_numpy("<i8") for batch in batches]
        if any(map(len, rows)):
            yield pd.DataFrame({"rows": [np.concatenate(rows).tobytes()]})

    found = sets.select("hashes").mapInPandas(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(CELLS, np.int64)
    for (rows,) in found.mapInPandas(packed, "rows binary").collect():  # at most 16 * CELLS bytes
        cells, n = np.frombuffer(rows, "<i8").reshape(-1, 2).T
        table[cells] = n
    return table


def by_rare_shingles(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a rare enough shingle.

    ``sets``: node, component, hashes. Shingles are ordered by how many sets
    hold them, as told by a table of CELLS counts, and then by hash. Sets of
    the wanted similarity share one of the first (100 - PERCENT) % of each in
    any common order; size and place bound the intersection further.
    """
    table = shingle_counts(sets)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for d, c, x in zip(batch["node"], batch["component"], batch["hashes"]):
                x = np.frombuffer(x, np.uint64)
                n = len(x)
                order = np.lexsort((x, shared.value[(x & np.uint64(CELLS - 1)).astype(np.int64)]))[: n - -(-PERCENT * n // 100) + 1]
                parts.append(pd.DataFrame({"shingle": x[order].view(np.int64), "node": d, "component": c, "n": n, "place": np.arange(len(order))}))
            if parts:
                yield pd.concat(parts)

    rows = saved(sets.mapInPandas(firsts, "shingle long, node long, component long, n long, place long"), "near-rare")
    spread = rows.groupBy("shingle", "component").agg(F.count("*").alias("members")).groupBy("shingle").agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("spread"))
    rows = rows.join(spread.filter("spread > 1").select("shingle", F.col("top.component").alias("major")), "shingle")
    # one side leaves out the shingle's largest component, so that this is never met with itself
    a = rows.filter("component <> major").select("shingle", *(F.col(c).alias("a_" + c) for c in ("node", "component", "n", "place")))
    b = rows.select("shingle", "major", *(F.col(c).alias("b_" + c) for c in ("node", "component", "n", "place")))
    least = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    fits = (
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("major")) | (F.col("a_node") < F.col("b_node")))
        & ((100 + PERCENT) * least >= PERCENT * (F.col("a_n") + F.col("b_n")))
    )
    pairs = a.alias("a").join(b.alias("b"), fits)
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the component of doc_id (itself where it has no link)."""
    joined = rows.drop("component").join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def unresolved(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    return rows.join(saved(mixed, "near-mixed"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    drawn = saved(sketches(docs), "near-sketches")
    with_set = drawn.filter("set_key is not null")
    least = F.min(F.struct("doc_id", "twin", "n_shingles", "sketch"))
    classes = with_set.filter("doc_id is not null").groupBy("set_key").agg(least.alias("least")).select("set_key", "least.*")
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    rows = saved(in_buckets(classes), "near-buckets")
    meetings = rows.groupBy("node").agg(F.sum(F.col("members") - 1).alias("meetings"))
    rows = saved(rows.drop("members").join(meetings, "node").withColumn("component", F.col("doc_id")), "near-members")
    sets = saved(full_sets(docs, classes.join(meetings, "node", "left_semi").select("node", "doc_id", "twin")), "near-sets")
    links, parts, past = None, None, None
    for k in range(STARS):
        pairs, hubs = stars(rows, past)
        found = confirmed(promising(pairs, classes), sets)
        links = saved(found if links is None else links.union(found), "near-links")
        parts = components(links)
        rows = unresolved(labelled(rows, parts))
        if k + 1 < STARS:
            given = hubs.select("bucket", F.col("hub_id").alias("doc_id"))
            past = saved(labelled(given, parts).select("bucket", "component").distinct().withColumn("given", F.lit(True)), "near-past")
            rows = rows.drop("given").join(past, ["bucket", "component"], "left").withColumn("given", F.coalesce("given", F.lit(False)))
        rows = saved(rows, "near-members")
    rest = rows.select("node", "component").distinct()
    found = confirmed(promising(by_rare_shingles(saved(sets.join(rest, "node"), "near-rest")), classes), sets)
    parts = components(saved(links.union(found), "near-links"))
    named = classes.select("set_key", F.col("doc_id").alias("first")).join(parts.select(F.col("node").alias("first"), "component"), "first", "left")
    out = drawn.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component", "first", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without those of which an earlier near copy stays."""
    gone = near_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
