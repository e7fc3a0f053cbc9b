import hashlib
from collections import Counter

import numpy as np
import pytest

from strandworks.llm import fingerprints as P
from strandworks.llm import queries as Q

from .helpers import LONG, edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


def plain_features(text, ranks):
    """The features of one text, window by window."""
    if not text:
        return []
    n = len(text) - P.WINDOW + 1
    rank = [int(ranks[sum(int(P._LEVEL[c]) for c in Counter(text[i : i + P.WINDOW]).values())]) for i in range(n)]
    votes = Counter(min(range(i, i + P.SPAN), key=lambda k: (rank[k], k)) for i in range(n - P.SPAN + 1))
    chosen = sorted(i for i, v in votes.items() if v >= P.VOTES)
    if not chosen and len(text) >= P.SHORT:
        chosen = sorted(votes)
    out = [text[i : i + P.WINDOW] for i in chosen]
    if len(text) < P.SHORT:
        width = 4 if len(text) >= 16 else min(2, len(text))
        out += [text[i : i + width] for i in range(len(text) - width + 1)]
    return list(dict.fromkeys(out))


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id", ascending=False).collect()
    return [(r.doc_id, r.text or "") for r in rows]


@pytest.fixture(scope="module")
def ranks(texts):
    return P.ranks_of(P.level_counts([t.encode() for _, t in texts]))


def test_levels_and_counts(texts):
    data = [t.encode() for _, t in texts[:20]]
    counts = Counter()
    for x in data:
        own = [sum(int(P._LEVEL[c]) for c in Counter(x[i : i + P.WINDOW]).values()) for i in range(len(x) - P.WINDOW + 1)]
        assert own == P.levels(np.frombuffer(x, np.uint8)).tolist()
        counts.update(own)
    found = P.level_counts(data)
    assert {k: int(found[k]) for k in np.flatnonzero(found).tolist()} == dict(counts)


def test_features_are_those_of_a_plain_scan(texts, ranks):
    some = [t.encode() for _, t in texts[:40]] + [b"", b"a", b"ab", b"abc", b"the quick brown fox", b"x" * 127, b"a" * 3000, b"ab" * 64, b"one two three " * 30]
    found = P.features(some, ranks)
    for text, h in zip(some, found):
        plain = plain_features(text, ranks)
        assert len(h) == len(plain)
    names = {}
    for text, h in zip(some, found):
        for f, x in zip(plain_features(text, ranks), h.tolist()):
            assert names.setdefault(x, f) == f


def test_slices_change_nothing(texts, ranks, monkeypatch):
    big = " ".join(t for _, t in texts).encode() + b"z" * 5000
    whole, counts = P.features([big, b"a" * 9000], ranks), P.level_counts([big])
    monkeypatch.setattr(P, "CHUNK", 1009)
    cut = P.features([big, b"a" * 9000], ranks)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut)) and np.array_equal(counts, P.level_counts([big]))


def test_likeness(texts, ranks):
    rng = np.random.default_rng(5)
    a, b, c = (P.chained(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (500, 30, 500))
    assert P.likeness(a, a) == 1 and P.likeness(a, c) < 0.05 and P.likeness(a, b) < 0.1
    assert P.likeness(P.chained(np.zeros(0, np.uint64)), a) == 0 and P.likeness(a[:0], a[:0]) == 1
    half = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    one, two = (P.chained(np.concatenate((half, rng.integers(0, 1 << 63, 50).astype(np.uint64)))) for _ in range(2))
    assert 0.5 < P.likeness(one, two) < 0.75 and P.likeness(one, two) == P.likeness(two, one)
    assert np.array_equal(P.read(P.written(a)), a)


def test_query_against_a_plain_version(spark, texts, ranks):
    rows = {r.doc_id: r for r in Q.QUERIES["op11_fingerprints"](spark, SF).collect()}
    assert len(rows) == len(texts)
    chains = P.digests([t.encode() for _, t in texts], ranks)
    near, far = [], []
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own = P.digests([edited.encode()], ranks)[0]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.written(chains[k]), P.written(own))
        assert r.near_edited == P.likeness(chains[k], own) and r.near_next == P.likeness(chains[k], chains[(k + 1) % len(texts)])
        near.append(r.near_edited)
        far.append(r.near_next)
    assert np.median(near) > 0.55 and np.median(far) == 0 and np.mean([a > b for a, b in zip(near, far)]) > 0.97


def test_many_ranges_and_hot_ids(spark):
    rows = [(i * 3 - 900, f"text number {i} of this very small set {i * i}") for i in range(600)] + [(77, f"repeated id {k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = P.against_next(df).collect()
    order = sorted({r[0] for r in rows}, reverse=True)
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id != 77 and (k := order.index(r.doc_id)) + 1 < len(order) and order[k + 1] != 77:
            text, following = texts[r.doc_id], texts[order[k + 1]]
            cut = len(text) // 3
            assert r.edited_sha256 == hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()


def test_edges(spark):
    out = P.against_next(edge_docs(spark)).collect()
    assert len(out) == edge_docs(spark, False).count()
    for r in out:
        assert 0 <= r.near_edited <= 1 and (r.near_next is None) == (r.doc_id is None)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[0].fingerprint == by[1].fingerprint == "" and by[0].near_next is not None and by[0].near_edited == 1
    assert len({r.fingerprint for r in out if r.doc_id == 5}) == 1 and by[8].n_chars == len(LONG)
    assert P.against_next(empty_docs(spark)).count() == 0
    alone = P.against_next(spark.createDataFrame([(3, "only one text here, and no other")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    both = P.fingerprints(spark.createDataFrame([(1, "same text"), (2, "same text"), (None, None)], "doc_id long, text string"))
    assert both.selectExpr("fingerprint").distinct().count() == 2
    near = both.crossJoin(both.selectExpr("fingerprint as other")).select(P.similarity("fingerprint", "other").alias("s"))
    assert {r.s for r in near.collect()} == {0.0, 1.0}
