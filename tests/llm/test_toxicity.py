import random

from pyspark.sql import functions as F

from strandworks.llm import queries as Q
from strandworks.llm import toxicity as X

from .helpers import edge_docs, empty_docs

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    rows = Q.QUERIES["op6_toxicity"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count()
    held = rows.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in held.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.95 * (n[1, 1] + n.get((0, 1), 0))
    assert rows.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_composed_machine_is_both():
    a, b = X.countdown(X.NEGATION, 3, X.NEGATED), X.from_then_on(X.REPORT, X.REPORTED)
    both = X.compose(a, b)
    words = [X.INSULT, X.NEGATION, X.OTHER, X.INSULT, X.REPORT, X.OTHER, X.INSULT, X.NEGATION, X.INSULT]

    def run(machine):
        state, out = 0, []
        for c in words:
            state, m = machine[state, c]
            out.append(m)
        return out

    assert run(both) == [x | y for x, y in zip(run(a), run(b))] == [0, 0, 0, 1, 0, 0, 2, 0, 3]


def plain_marks(classes):
    """The same by looking around each word."""
    out = []
    for i, c in enumerate(classes):
        near = lambda kind, before, after: any(classes[j] == kind for j in range(max(0, i - before), min(len(classes), i + after + 1)) if j != i)
        hit = c in (X.INSULT, X.THREAT)
        out.append(hit * (near(X.NEGATION, 3, 2) * X.NEGATED | near(X.REPORT, 99, 99) * X.REPORTED | near(X.TARGET, 4, 4) * X.AIMED))
    return out


def test_marks_against_looking_around():
    rng = random.Random(1)
    for _ in range(3000):
        classes = rng.choices(range(6), weights=(6, 2, 2, 1, 1, 1), k=rng.randint(0, 14))
        assert X.marks(classes) == plain_marks(classes)


def test_clauses():
    g = X.Grammar({"idiot": 5.0}, {"grobi": 4.0})
    f = lambda t: {k: sum(c[i] for c in g.clauses(t, g.finder())) for i, k in enumerate(X.ARCS)}
    assert f("What an idiot. Fine day.") == dict(zip(X.ARCS, (5.0, 0, 0, 0, 0, 0, 0, 0.2, 1.0)))
    assert f("You idiot!")["aimed"] == 5 and f("not an idiot")["negated"] == 5 and f("he is an idiot, she said")["reported"] == 5 and f("an idiot he isn't never")["negated"] == 5
    assert f("I will kill you")["aimed_threat"] == 1 and f("said: I kill")["threat"] == 1 and f("said I kill you")["excused_threat"] == 1
    assert f("grobian Grobität")["plain"] == 8 and f("xgrobian idiots")["clause"] == 0 and f("idiot. idiot? x\nidiot")["clause"] == 3
    none, one, two = g.scores(["", "you idiot", "you idiot, you idiot"])
    assert none < one < two and none < 0.05


def test_scores_are_of_any_clause():
    """Against the product over single clauses."""
    g = X.Grammar({"idiot": 2.0, "fool": 1.0})
    texts = ["you fool", "an idiot here", "not a fool at all"]
    alone = 1 - g.scores(texts)
    quiet = 1 - g.scores([""])[0]
    assert abs(g.scores([". ".join(texts)])[0] - (1 - quiet * (alone / quiet).prod())) < 1e-12


def test_long_texts():
    """Clauses without end, and megabytes without and with many of them."""
    import time

    g = X.Grammar({"idiot": 5.0})
    for text in ("idiot " * 800_000, "x " * 2_500_000 + "idiot", "idiot. " * 700_000, "word idiot; " * 400_000):
        began = time.process_time()
        assert g.scores([text])[0] > 0.5
        assert time.process_time() - began < 25


def test_edges(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    g = X.learn(docs, labels)
    assert X.score(docs, g).count() == docs.count()
    assert X.score(docs, g).filter("doc_id is null and held_out").count() == 0
    assert X.clean(docs, g).columns == docs.columns
    none = X.learn(empty_docs(spark), labels.limit(0))
    assert X.score(empty_docs(spark), none).count() == 0 and not none.insults


def test_sample_bounds_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "c"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(1, 0)], "doc_id long, toxic int").withColumn("x", F.lit(1))
    kept = [i for i in range(1, 5) if not spark.range(1).select(X.held_out(F.lit(i))).first()[0]]
    want = {1: ("a", 1), 2: ("c", 0), 3: (None, 1), 4: ("d", 0)}
    rows = [tuple(r) for r in X.training_rows(docs, labels).collect()]
    assert sorted(rows, key=str) == sorted((want[i] for i in kept), key=str)
    assert X.training_rows(docs, labels, sample=1).count() == 1


def test_fold_by_crc32(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(50).select("id", X.held_out(F.col("id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())
