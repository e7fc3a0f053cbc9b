"""Edge rows: empty sides, limits, ties, halves, homopolymers, palindromes, streams."""

import pytest
from pyspark.sql import functions as F

from strandworks.functions import sequences as S
from strandworks.operators import dotplot, editing, kmers, matches, seeds, validate
from strandworks.params import Diagonal, Search, flat, is_symmetric, match_matrix, matrix_type, transition_matrix
from strandworks.plans.search import search, search_by_diagonal
from strandworks.plans.synteny import synteny
from strandworks.sources import catalog, tables
from strandworks.streaming.search import stream_matches


def table(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


def test_validation_order(spark):
    rows = spark.createDataFrame([("",), ("ACGT",), ("ACGTA",), ("A" * 50,), ("A" * 51,), (" atcga ",), ("AUCGA",), ("ATCGN",), ("ATCGX",), (None,)], "s string")
    got = [(r.v.error or r.v.type, r.v.clean) for r in rows.select(validate.validate_sequence("s").alias("v")).collect()]
    assert [g[0] for g in got] == ["Sequence is empty", "Sequence is shorter than 5", "DNA", "DNA", "Sequence is longer than 50", "DNA", "RNA", "PROTEIN", "Sequence has letters of no known type", "Sequence is empty"]
    assert got[5][1] == "ATCGA"
    pair = spark.createDataFrame([("ATCGA", "AUCGA")], "a string, b string").select(validate.validate_pair("a", "b").alias("v")).first().v
    assert not pair.is_valid


def test_rounding(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (-0.25,)], "x double").select(S.js_round(F.col("x")).alias("r"), S.round1(F.col("x")).alias("r1")).collect()
    assert [(r.r, r.r1) for r in got] == [(-2, -2.5), (3, 2.5), (0, -0.2)]


def test_kmers_longer_than_sequence(spark):
    assert kmers.generate(table(spark, "AC", "", "ACG"), 3).count() == 1
    assert kmers.statistics(kmers.generate(table(spark, "AC"), 3)).count() == 0


def test_golden_seeds(spark):
    one = table(spark, "ATCGATCG")
    live = search(one, one, Search(k=3))
    assert live["matches"].count() == 10
    assert [(r.query_start, r.query_end, r.db_start, r.score) for r in live["seeds"].collect()] == [(2, 5, 2, 12.0)]
    assert [(r.query_start, r.query_end, r.score, r.identity) for r in live["results"].collect()] == [(0, 7, 20.0, 100)]
    diagonal = search_by_diagonal(one, one, Diagonal(k=3))["seeds"].orderBy("seed_id").collect()
    assert [(r.diagonal, r.query_start, r.query_end, r.score) for r in diagonal] == [(0, 0, 7, 36.0), (4, 0, 3, 12.0), (-4, 4, 7, 12.0)]


def test_no_match(spark):
    stages = search(table(spark, "AAAAA"), table(spark, "CCCCC"), Search(k=3))
    assert all(stages[s].count() == 0 for s in ("matches", "seeds", "results"))


def test_homopolymer_lines(spark):
    pairs = spark.createDataFrame([(1, "A" * 8, "A" * 8)], "pair_id long, seq1 string, seq2 string")
    lines = synteny(pairs, 3)["lines"].filter("strand = 'forward'").collect()
    assert sum(r.length for r in lines) == sum(8 - abs(d) for d in range(-5, 6))
    assert synteny(pairs.limit(0), 3)["statistics"].count() == 0


def test_palindrome_strands(spark):
    pairs = spark.createDataFrame([(1, "ACGTACGT", "ACGTACGT")], "pair_id long, seq1 string, seq2 string")
    got = {s: sorted((r.start1, r.start2, r.length) for r in synteny(pairs, 4)["lines"].filter(F.col("strand") == s).collect()) for s in ("forward", "reverse")}
    assert got["forward"] == got["reverse"] != []


def test_seeded_cells_make_the_same_lines(spark):
    pairs = tables.item_pairs(spark, "/root/testdata/sf0.001")
    rows = dotplot.strands(pairs, 5)
    a, b = (dotplot.lines(f, 5).orderBy("pair_id", "strand", "line_id").collect() for f in (dotplot.base_matches(rows), dotplot.seeded_matches(rows, 5)))
    assert a == b and a


def test_one_mismatch_in_each_window(spark):
    a = "ACGTTGCA" * 4
    b = "".join("T" if i % 9 == 4 and c != "T" else c for i, c in enumerate(a))
    pairs = spark.createDataFrame([(1, a, b)], "pair_id long, seq1 string, seq2 string")
    whole = synteny(pairs, 8, True)["lines"].filter("strand = 'forward' and start1 = start2").collect()
    assert max(r.length for r in whole) == len(a)
    close = dotplot.close_matches(dotplot.strands(pairs, 1), 1).filter("strand = 'forward'").count()
    assert close == len(a) * len(b)


def test_matrices():
    assert matrix_type(match_matrix()) == "Match/Mismatch" and matrix_type(transition_matrix()) == "Transition/Transversion"
    assert matrix_type({"AG": 1.0}) == "Custom" and not is_symmetric({"AG": 1.0})
    assert len(flat({})) == 16 and not any(flat({}).values())


def test_editing(spark):
    keys = [(1, i, k) for i, k in enumerate(["ArrowRight", "-", "Tab", "Delete", "ArrowLeft", " ", "Backspace"])]
    sessions = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, "AC", "ACGT")], "session_id long, aligned1 string, aligned2 string")
    got = {r.session_id: r for r in editing.fold(sessions, spark.createDataFrame(keys, "session_id long, seq_no long, key string")).collect()}
    assert (got[1].aligned1, got[1].aligned2, got[1].active) == ("A-CGT", "ACGT-", 2)
    assert (got[2].aligned1, got[2].n_keys) == ("AC--", 0)


class PlainEditor:
    """The editor by its definition: whole strings, made tidy after each change."""

    def __init__(self, a, b):
        self.first, self.rows, self.cursor, self.active = [a, b], [a, b], 0, 0
        self.tidy()

    def press(self, key):
        row, at = self.rows[self.active], self.cursor
        if key == "ArrowLeft":
            self.cursor = max(0, at - 1)
        elif key == "ArrowRight":
            self.cursor = min(len(row), at + 1)
        elif key in ("ArrowUp", "ArrowDown", "Tab"):
            self.active = {"ArrowUp": 0, "ArrowDown": 1, "Tab": 1 - self.active}[key]
        elif key == "Reset":
            self.rows, self.cursor, self.active = list(self.first), 0, 0
        elif key in ("-", " "):
            self.rows[self.active], self.cursor = row[:at] + "-" + row[at:], at + 1
        elif key in ("Delete", "Backspace"):
            back = key == "Backspace" and at > 0
            if row[at - back : at - back + 1] == "-":
                self.rows[self.active], self.cursor = row[: at - back] + row[at - back + 1 :], at - back
        self.tidy()

    def tidy(self):
        width = max(map(len, self.rows))
        self.rows = [r.ljust(width, "-") for r in self.rows]
        full = [i for i in range(width) if self.rows[0][i] != "-" or self.rows[1][i] != "-"]
        if full and len(full) < width:
            self.rows = [r[full[0] : full[-1] + 1] for r in self.rows]
            self.cursor = max(0, min(self.cursor - full[0], len(self.rows[0]))) if len(self.rows[0]) < width else self.cursor


def test_editor_equals_plain_strings():
    import random

    rng, strokes = random.Random(4), ["ArrowLeft", "ArrowRight", "ArrowRight", "ArrowUp", "ArrowDown", "Tab", "-", " ", "-", "Delete", "Backspace", "Reset", "x", None]
    for n in range(300):
        a, b = ("".join(rng.choices("AC-" if n % 5 else "-", k=rng.randint(0, 6))) for _ in range(2))
        one, two = editing.Editor([a, b]), PlainEditor(a, b)
        for _ in range(60):
            key = rng.choice(strokes if rng.random() < 0.2 else strokes[:11])
            one.press(key)
            two.press(key)
            assert (one.rows, one.cursor, one.active) == (two.rows, two.cursor, two.active), (a, b, key)


def test_edges_of_edits(spark):
    """Nulls, repeats, ties, empty tables, clashing extra columns."""
    shape = "session_id long, aligned1 string, aligned2 string, seq_no string, is_key string"
    sessions = spark.createDataFrame([(1, "AC", "AC", "z", "z"), (1, "G", "G", None, None), (None, "T", "TT", None, None), (None, "T", "TT", None, None), (2, None, "A", None, None), (3, "", None, None, None)], shape)
    keys = spark.createDataFrame([(1, 2, "-", 0), (1, None, "ArrowRight", 0), (1, 2, None, 0), (None, 1, "-", 0), (9, 1, "-", 0), (3, 1, "-", 0)], "session_id long, seq_no long, key string, n_keys int")
    got = sorted((tuple(r) for r in editing.fold(sessions, keys).collect()), key=str)
    assert got == sorted([(1, "A-C", "AC-", 2, 1, 3), (1, "G", "G", 1, 1, 3), (None, "T-", "TT", 0, 1, 0), (None, "T-", "TT", 0, 1, 0), (2, "-", "A", 0, 1, 0), (3, "-", "-", 1, 1, 1)], key=str)
    assert editing.fold(sessions.limit(0), keys).count() == 0 and editing.fold(sessions, keys.limit(0)).count() == 6


def test_a_long_log(spark):
    """100,000 keys of one session on strings of 200,000 letters, beside many short ones."""
    import time

    text = "ACGT" * 50_000
    sessions = spark.createDataFrame([(1, text, text)] + [(i, "ACGT", "ACG") for i in range(2, 500)], "session_id long, aligned1 string, aligned2 string")
    keys = spark.range(100_000).selectExpr("1L as session_id", "id as seq_no", "case when id % 4 = 3 then '-' else 'ArrowRight' end as key")
    began = time.time()
    got = editing.fold(sessions, keys.repartition(8)).filter("session_id = 1").first()
    assert time.time() - began < 30
    assert got.n_keys == 100_000 and got.cursor == 100_000 and got.aligned1.count("-") == 25_000 and got.aligned1.startswith("ACG-TAC-")


def test_close_matches_scan(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, "A"), (1, 1, 1, 1, "A"), (1, 1, 2, 2, "A"), (1, 1, 9, 0, "A")], "query_id long, db_id long, query_pos long, db_pos long, kmer string")
    assert sorted((r.query_pos, r.db_pos) for r in matches.without_close(rows).collect()) == [(0, 0), (2, 2), (9, 0)]


def test_catalogs(spark):
    assert catalog.examples(spark).groupBy("catalog").count().count() == 7
    assert catalog.tier(spark, "nothing").count() == 6 and catalog.levels(spark).count() == 4
    assert catalog.example(spark, "dotplot", "nothing", "self-comparison").first().key == "self-comparison"
    assert catalog.sound(catalog.by_level(spark, "beginner")).count() == 3
    assert catalog.random_example(spark, "local", 3).count() == 1 and catalog.listing(spark, "search").count() == 3


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one\nACGT\nAC\n>two\nTTT\n")
    got = {r.name: r.seq for r in tables.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": "ACGTAC", "two": "TTT"}


def test_stream(spark, tmp_path):
    table(spark, "ACGTACGT").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("seq_id long, seq string").parquet(str(tmp_path / "in"))
    run = stream_matches(arriving, table(spark, "GTAC"), 3).writeStream.format("memory").queryName("met").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r.query_pos, r.db_pos) for r in spark.table("met").collect()) == [(0, 2), (1, 3)]


def test_seed_filters(spark):
    one = table(spark, "ATCGATCG")
    s = search_by_diagonal(one, one, Diagonal(k=3))["seeds"]
    assert seeds.at_least(s, score=20).count() == 1 and seeds.top(s, 1).count() == 1
    assert [r.diagonal for r in seeds.without_redundant(s).collect()] == [0]


@pytest.mark.parametrize("window, high, want", [(0, 10, 1), (99, 15, 15), (7, 10, 7)])
def test_clamp(spark, window, high, want):
    assert spark.range(1).select(validate.clamp_window(window, high).alias("w")).first().w == want


def test_streamed_edits_equal_the_fold(spark, tmp_path):
    from strandworks.streaming.editing import stream_edits

    strokes = ["ArrowRight", "-", "Tab", "Delete", "ArrowLeft", " ", "Backspace", "-", "Reset", "ArrowRight", "-"]
    rows = [(1, i, k, "ACGT", "ACG") for i, k in enumerate(strokes)]
    schema = "session_id long, seq_no long, key string, aligned1 string, aligned2 string"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_edits(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("edits").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = max(spark.table("edits").collect(), key=lambda r: r.n_keys)
    sessions = spark.createDataFrame([(1, "ACGT", "ACG")], "session_id long, aligned1 string, aligned2 string")
    want = editing.fold(sessions, spark.createDataFrame([r[:3] for r in rows], "session_id long, seq_no long, key string")).first()
    assert tuple(last) == tuple(want)


def test_walks_over_long_flanks(spark):
    """Flanks of 100,000 letters that match, and walks that stop in each part, against a plain loop."""
    import random
    import time

    rng = random.Random(3)
    same = "".join(rng.choices("ACGT", k=100_000))
    flanks = [(same, same), (same, same[:70] + "".join(rng.choices("ACGT", k=500))), (same[:2000] + "T" * 50 + "A", same[:2000] + "C" * 50 + "A"), ("", "A"), ("ACGT", "TTTT")]
    flanks += [("".join(rng.choices("AC", k=200)), "".join(rng.choices("AC", k=150))) for _ in range(40)]

    def plain(a, b, drop, floor):
        now, best, at, steps, stop, fell = 0.0, 0.0, 0, 0, False, False
        for x, y in zip(a, b):
            now, steps = now + (2 if x == y else -1), steps + 1
            if now > best:
                best, at = now, steps
            fell = now < best - drop
            stop = fell or (floor is not None and now < -floor)
            if stop:
                break
        return best, at, stop, steps, fell

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(flanks)], "i long, a string, b string")
    for drop, floor in ((1, None), (5, 1)):
        began = time.time()
        got = {r.i: r.w for r in seeds.walked(rows, "w", F.col("a"), F.col("b"), 2, -1, drop, floor).select("i", "w").collect()}
        assert time.time() - began < 30
        for i, (a, b) in enumerate(flanks):
            assert (got[i].best, got[i]["at"], got[i].stop, got[i].steps, got[i].fell) == plain(a, b, drop, floor), i


def test_dense_windows_without_the_others(spark):
    q, d = table(spark, "ACGTACGTTT", "AAAAAA"), table(spark, "ACGTACGTACGTTTTACGT", "AAAAAAAAAAAA", "AC")
    found = search(q, d, Search(k=3))["matches"]
    lengths = d.selectExpr("seq_id as db_id", "cast(length(seq) as long) as length")
    for window in (2, 3, 10, 15):
        want = matches.dense_regions(matches.density(found, lengths, 3, window), 0.3)
        assert sorted(map(str, matches.dense(found, lengths, 3, window, 0.3).collect())) == sorted(map(str, want.collect()))


def test_reset_and_scores_of_edits(spark):
    sessions = spark.createDataFrame([(1, "ACGT", "ACGT"), (2, "ACGT", "ACGT")], "session_id long, aligned1 string, aligned2 string")
    keys = spark.createDataFrame([(1, 1, "ArrowRight"), (1, 2, "-"), (2, 1, "ArrowRight"), (2, 2, "-"), (2, 3, "Tab"), (2, 4, "Reset")], "session_id long, seq_no long, key string")
    got = {r.session_id: r for r in editing.scored(editing.fold(sessions, keys)).collect()}
    assert (got[1].aligned1, got[1].aligned2, got[1].score, got[1].optimum, got[1].improvement) == ("A-CGT", "ACGT-", -4.0, 8.0, 12.0)
    assert (got[2].aligned1, got[2].cursor, got[2].active, got[2].improvement) == ("ACGT", 0, 1, 0.0)
