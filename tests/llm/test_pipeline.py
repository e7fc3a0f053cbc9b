import corpus_pipeline as P
from strandworks.llm import bpe, line_dedup, mixing, near_dedup, toxicity

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_copies

from .helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on its own input, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    out = {}
    for name, stage in P.STAGES:
        before, docs = docs, P.saved(stage(spark, docs, SF), name)
        out[name] = (before, docs)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(out[n][1].columns == names for n in ("toxicity", "line_dedup", "near_dedup", "mixing"))
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = out["toxicity"]
    grammar = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(after) == {i: t for i, t in rows(before).items() if grammar.scores([t])[0] < 0.5}

    before, after = map(rows, out["line_dedup"])
    want = brute_lines(list(before.items()), line_dedup.MIN_WORDS)
    assert after == {i: t for i, (t, n) in want.items() if n < len(before[i].split("\n"))}

    before, after = map(rows, out["near_dedup"])
    assert set(after) == {i for i, (_, first) in brute_copies(list(before.items())).items() if i == first}

    before, after = out["mixing"]
    assert set(rows(after)) == {r.doc_id for r in mixing.mix(before).filter("mix_.kept").collect()}

    before, after = out["bpe"]
    assert {r.doc_id: r.text for r in bpe.decoded(after, P.BPE_FILE).collect()} == rows(before)
    assert near_dedup.PERCENT == 75


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names, and an empty table through all stages."""
    for given in (edge_docs(spark), empty_docs(spark)):
        docs, kept = given, []
        for name, stage in P.STAGES:
            docs = P.saved(stage(spark, docs, SF), f"edge-{name}")
            kept.append(docs.count())
            assert name == "bpe" or docs.columns == given.columns
            if name == "near_dedup" and kept[0]:
                ids = [r.doc_id for r in docs.collect()]
                assert {0, 1, 2, None} <= set(ids) and 4 in ids and 5 not in ids
        assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and bool(kept[-1]) == bool(given.count())
