import random

from strandworks.llm import line_dedup as L
from strandworks.llm import queries as Q

from ..oracle import check
from .helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


def brute(docs, min_words):
    """Every repeated run of enough words, by comparing all pairs of starts."""
    rows = sorted((i, t) for i, t in docs if t is not None)
    lines = {i: t.split("\n") for i, t in rows}
    order = [i for i, _ in rows]
    starts = [(d, k) for d in order for k in range(len(lines[d]))]
    gone = set()
    for x, (d, k) in enumerate(starts):
        for e, m in starts[:x]:
            n = 0
            while k + n < len(lines[d]) and m + n < len(lines[e]) and lines[d][k + n] == lines[e][m + n]:
                n += 1
            if sum(len(s.split()) for s in lines[d][k : k + n]) >= min_words:
                gone |= {(d, k + t) for t in range(n)}
    return {d: ("\n".join(s for k, s in enumerate(lines[d]) if (d, k) not in gone), sum((d, k) in gone for k in range(len(lines[d])))) for d in order}


def test_against_sql(spark):
    check(spark, SF, Q.QUERIES["op8_line_dedup"], Q.ORACLE_SQL["op8_line_dedup"])


def test_against_all_pairs(spark):
    rng = random.Random(4)
    pool = ["a b c", "d e", "f g h i", "", "", "  ", "j", "k l m n o", "p q"]
    for min_words in (1, 6, 12):
        docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(25)] + [(30, "\n".join(["z z"] * 9)), (31, "only here\nand here")]
        rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words).collect()
        want = brute(docs, min_words)
        assert {r.doc_id: (r.text, r.line_dedup_.n_removed) for r in rows} == want


def test_blank_lines_and_repeated_rows(spark):
    """Long runs of blank lines, a document of many lines that all repeat, and rows repeated a thousand times."""
    import time

    words = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"line {i} of many" for i in range(60_000))
    docs = [(1, words + "\n" * 100_000 + "end"), (2, "x\n" + words + "\n" * 50_000 + "other"), (3, long), (4, "first\n" + long + "\nlast"), *[(5, words + "\nagain")] * 1000]
    began = time.time()
    rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert time.time() - began < 100
    assert len(rows) == 1004
    got = {r.doc_id: (r.text, r.line_dedup_.n_lines, r.line_dedup_.n_removed) for r in rows}
    assert got[1] == (docs[0][1], 100_001, 0) and got[3] == (long, 60_000, 0)
    assert got[2] == ("x\nother", 50_002, 50_000) and got[4] == ("first\nlast", 60_002, 60_000) and got[5] == ("again", 2, 1)


def test_edges(spark):
    docs = edge_docs(spark)
    out = L.dedup_lines(docs, 2)
    assert out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text is None and got[1].text == "" and got[5].text == ""
    assert L.without_copies(docs, 2).columns == docs.columns
    assert L.dedup_lines(empty_docs(spark)).count() == 0
