import random
import re

import numpy as np

from strandworks.llm import near_dedup as N
from strandworks.llm.components import components
from strandworks.llm import queries as Q

from .helpers import edge_docs, empty_docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    group = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def agree(spark, docs):
    rows = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = Q.QUERIES["op9_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)


def test_edits_of_all_sizes(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(4000)}" for _ in range(80)] for _ in range(6)]
    common = [f"c{i}" for i in range(55)]
    docs = []
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(rng.randrange(7)):
            words[rng.randrange(80)] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(words).upper() if i % 9 == 0 else " ".join(words)))
    docs += [(200 + i, " ".join(common + [f"r{rng.randrange(99999)}" for _ in range(rng.randint(10, 30))])) for i in range(120)]
    docs += [(400 + i, " ".join(f"s{k}" for k in range(i % 5))) for i in range(20)]
    agree(spark, docs)


def test_rest_finds_what_stars_miss(spark):
    """With no star at all, the rare shingles alone must give every link between classes of a bucket."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(base[: 60 - i] + [f"y{k}" for k in range(i)])) for i in range(12)]
    stars, N.STARS = N.STARS, 1
    try:
        agree(spark, docs)
    finally:
        N.STARS = stars
    rng.shuffle(docs)
    agree(spark, docs)


def test_sets_and_sketches():
    texts = ["", " \n", "One", "one two three four five", "ONE  two\tthree four five", "a b c d", "é É x y z w"]
    assert [len(x) for x in N.shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    a, b = N.shingle_sets(["one two three four five", "ONE  two\tthree four five"])
    assert a.tolist() == b.tolist()
    x = np.random.default_rng(0).integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    y[:100] = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    same = (np.frombuffer(N.sketch(x), "<u2") == np.frombuffer(N.sketch(y), "<u2")).mean()
    assert abs(same - 300 / 500) < 0.15


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_edges(spark):
    docs = edge_docs(spark)
    out = N.near_duplicates(docs)
    assert out.count() == docs.count()
    assert not out.filter("doc_id is null and kept").count()
    kept = N.first_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, None}
    assert N.near_duplicates(empty_docs(spark)).count() == 0


def test_rows_repeated_a_thousand_times(spark):
    """Two near copies a thousand times each, one id with many texts, and a hub with more members than one part holds."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    changed = lambda n: " ".join([*base[: 80 - n], *(f"z{rng.randrange(10**9)}" for _ in range(n))])
    docs = [(1, " ".join(base))] * 1000 + [(2, changed(2))] * 1000 + [(3, changed(5)) for _ in range(40)]
    docs += [(10 + i, changed(1)) for i in range(600)] + [(5000, "quite another text than all of the others here")]
    rows = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    assert {r.component_id for r in rows if r.doc_id < 5000} == {1} and {(r.component_id, r.kept) for r in rows if r.doc_id == 5000} == {(5000, True)}


def test_each_pair_is_confirmed_once(spark):
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(700)]
    sets = spark.createDataFrame([(i, 1000 + i, bytearray((own[0] if i % 3 else x).tobytes())) for i, x in enumerate(own)], "node long, doc_id long, hashes binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 700)] + [(4, 3), (4, 5)], "a long, b long")
    got = sorted(tuple(r) for r in N.confirmed(pairs, sets).collect())
    assert got == sorted([(1000, 1000 + i) for i in range(1, 700) if i % 3] + [(1004, 1005)])
