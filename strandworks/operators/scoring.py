"""Scores and statistics of aligned pairs, as struct columns over their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequences import chars, col, degap, js_round, round1, substitution
from ..params import Affine, Linear


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def count(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x)).cast("long")


def kinds(a: Column | str, b: Column | str) -> Column:
    """'gap', 'match' or 'mismatch' of each column."""
    return F.zip_with(chars(a), chars(b), lambda x, y: F.when((x == "-") | (y == "-"), "gap").when(x == y, "match").otherwise("mismatch"))


def of_kind(k: Column, name: str) -> Column:
    return F.size(F.filter(k, lambda x: x == name)).cast("long")


def alignment_stats(a: Column | str, b: Column | str) -> Column:
    """matches, mismatches, gaps, identity over the length, length; zeros for unequal or empty strings."""
    good = (F.length(col(a)) == F.length(col(b))) & (F.length(col(a)) > 0)
    k = kinds(a, b)
    n = lambda name: F.when(good, of_kind(k, name)).otherwise(F.lit(0).cast("long")).alias({"match": "matches", "mismatch": "mismatches", "gap": "gaps"}[name])
    identity = F.when(good, round1(F.try_divide(of_kind(k, "match") * 100.0, F.length(col(a))))).otherwise(0.0)
    return F.struct(n("match"), n("mismatch"), n("gap"), identity.alias("identity"), F.when(good, F.length(col(a)).cast("long")).otherwise(F.lit(0).cast("long")).alias("length"))


def linear_breakdown(a: Column | str, b: Column | str, p: Linear = Linear()) -> Column:
    """array<struct<position, char1, char2, score, type>>."""
    rows = F.arrays_zip(chars(a).alias("x"), chars(b).alias("y"))

    def row(r: Column, i: Column) -> Column:
        x, y = r.x, r.y
        kind = F.when((x == "-") | (y == "-"), "gap").when(x == y, "match").otherwise("mismatch")
        score = F.when(kind == "gap", float(p.gap)).when(kind == "match", float(p.match)).otherwise(float(p.mismatch))
        return F.struct(i.alias("position"), x.alias("char1"), y.alias("char2"), score.alias("score"), kind.alias("type"))

    return F.transform(rows, row)


def linear_score(a: Column | str, b: Column | str, p: Linear = Linear()) -> Column:
    """Totals of an aligned pair. ``gap_openings`` is 0 as the model has none; ``gap_openings_actual`` counts them."""
    k, n = kinds(a, b), F.length(col(a))
    matches, mismatches, gaps = (of_kind(k, x) for x in ("match", "mismatch", "gap"))
    whole = matches * float(p.match) + mismatches * float(p.mismatch) + gaps * float(p.gap)
    return F.struct(
        round1(whole).alias("total_score"), matches.alias("matches"), mismatches.alias("mismatches"), gaps.alias("gaps"), F.lit(0).cast("long").alias("gap_openings"),
        gap_openings(a, b).alias("gap_openings_actual"), F.coalesce(round1(F.try_divide(matches * 100.0, n)), F.lit(0.0)).alias("identity"), n.cast("long").alias("alignment_length"),
    )


def gap_sides(a: Column | str, b: Column | str) -> Column:
    """0 for a pair of letters, 1 for a gap in the first string, 2 in the second; both count as the first."""
    return F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == "-", 1).when(y == "-", 2).otherwise(0))


def opens(a: Column | str, b: Column | str) -> Column:
    """Whether each column opens a gap; a change of side opens anew."""
    sides = gap_sides(a, b)
    return F.transform(sides, lambda x, i: (x != 0) & ((i == 0) | (x != F.element_at(sides, F.greatest(i, F.lit(1))))))


def gap_openings(a: Column | str, b: Column | str) -> Column:
    return count(opens(a, b))


def terminal_columns(a: Column | str, b: Column | str) -> Column:
    """Whether each column is in the first or last run of gaps."""
    sides = gap_sides(a, b)
    n = F.size(sides)
    first = F.array_position(sides, 0)
    last = n + 1 - F.array_position(F.reverse(sides), 0)
    return F.transform(sides, lambda x, i: (x != 0) & ((first == 0) | (i + 1 < first) | (i + 1 > last)))


def as_map(matrix: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(matrix.items()) for x in kv))


def affine_score(a: Column | str, b: Column | str, p: Affine = Affine()) -> Column:
    """Totals by a substitution matrix, gap openings and extensions, and terminal columns; identity over letter pairs."""
    matrix = as_map(p.matrix)
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.struct(F.upper(x).alias("x"), F.upper(y).alias("y")))
    letters = F.filter(pairs, lambda r: (r.x != "-") & (r.y != "-"))
    part = lambda equal: total(F.transform(F.filter(letters, lambda r: (r.x == r.y) == F.lit(equal)), lambda r: substitution(matrix, r.x, r.y)))
    matches = F.size(F.filter(letters, lambda r: r.x == r.y)).cast("long")
    mismatches = F.size(letters).cast("long") - matches
    gaps = F.size(pairs).cast("long") - F.size(letters)
    openings = gap_openings(a, b)
    gap_score = openings * float(p.gap_open) + (gaps - openings) * float(p.gap_extend)
    ends = count(terminal_columns(a, b)) * float(p.end_gap)
    return F.struct(
        round1(part(True) + part(False) + gap_score + ends).alias("total_score"), round1(part(True)).alias("match_score"), round1(part(False)).alias("mismatch_score"),
        round1(gap_score).alias("gap_penalty_score"), round1(ends).alias("end_gap_penalty_score"), matches.alias("matches"), mismatches.alias("mismatches"), gaps.alias("gaps"),
        openings.alias("gap_openings"), round1(F.try_divide(matches * 100.0, matches + mismatches)).alias("identity"), F.size(pairs).cast("long").alias("alignment_length"),
    )


def overlay_estimate(a: Column | str, b: Column | str, p: Linear = Linear()) -> Column:
    """The score of both strings laid over each other, the rest as gaps: an estimate, not the optimum."""
    least = F.least(F.length(col(a)), F.length(col(b)))
    same = count(F.transform(F.zip_with(F.slice(chars(a), 1, least), F.slice(chars(b), 1, least), lambda x, y: x == y), lambda x: x))
    return round1(same * float(p.match) + (least - same) * float(p.mismatch) + (F.greatest(F.length(col(a)), F.length(col(b))) - least) * float(p.gap))


def compare_with_estimate(score: Column, estimate: Column) -> Column:
    share = F.when(estimate != 0, score / estimate * 100).otherwise(0.0)
    return F.struct(estimate.alias("optimal_score"), score.alias("current_score"), round1(share).alias("percentage"), round1(estimate - score).alias("difference"))


#: Texts of the advice of the report.
ADVICE = {
    "low": "Low identity: the sequences may not be related.",
    "gaps": "More than half of the columns are gaps: review the gap penalties.",
    "negative": "Negative score despite matches: lower the gap penalties or raise the match score.",
    "long": "Long gaps: large insertions or deletions.",
}


def recommendations(s: Column) -> Column:
    """Advice for a ``linear_score`` struct."""
    found = (
        F.when(s.identity < 30, ADVICE["low"]), F.when(s.gaps > s.alignment_length * 0.5, ADVICE["gaps"]), F.when((s.total_score < 0) & (s.matches > 0), ADVICE["negative"]),
        F.when(F.coalesce(F.try_divide(s.gaps, s.gap_openings), F.lit(0.0)) > 5, ADVICE["long"]),
    )
    return F.array_compact(F.array(*found))


#: Kind of each advice, and what to do about it.
KINDS = {
    "low": ("warning", "Check the sequences and the parameters of the alignment"), "gaps": ("info", "Change the gap penalties or look at the alignment again"),
    "negative": ("tip", "Lower the gap penalties or raise the reward of matches"), "long": ("info", "Think of large insertions or deletions"),
}


def advice(s: Column) -> Column:
    """array<struct<type, message, action>> for the texts of ``recommendations``."""
    whole = F.create_map(*(x for k, text in ADVICE.items() for x in (F.lit(text), F.struct(F.lit(KINDS[k][0]).alias("type"), F.lit(text).alias("message"), F.lit(KINDS[k][1]).alias("action")))))
    return F.transform(recommendations(s), lambda text: F.element_at(whole, text))


def linear_report(a: Column | str, b: Column | str, p: Linear = Linear()) -> Column:
    """Summary, breakdown, advice, comparison."""
    s = linear_score(a, b, p)
    n = s.alignment_length
    ratio = lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))
    shortest = F.least(F.length(degap(a)), F.length(degap(b)))
    efficiency = F.coalesce(round1(F.try_divide(s.matches * 100.0, shortest)), F.lit(0.0))
    return F.struct(
        s.alias("summary"),
        F.struct((s.matches * float(p.match)).alias("match_score"), (s.mismatches * float(p.mismatch)).alias("mismatch_penalty"), F.lit(0.0).alias("gap_penalty"), (s.gaps * float(p.gap)).alias("gap_penalty_actual")).alias("breakdown"),
        recommendations(s).alias("recommendations"),
        F.struct(ratio(s.matches).alias("match_ratio"), ratio(s.mismatches).alias("mismatch_ratio"), ratio(s.gaps).alias("gap_ratio"), ratio(s.total_score).alias("score_per_position"), efficiency.alias("efficiency")).alias("comparison"),
    )


def affine_report(a: Column | str, b: Column | str, p: Affine = Affine()) -> Column:
    s = affine_score(a, b, p)
    return F.struct(
        F.struct(degap(a).alias("original1"), degap(b).alias("original2"), col(a).alias("aligned1"), col(b).alias("aligned2"), s.alignment_length.alias("length")).alias("alignment"),
        s.alias("scoring"),
        F.struct(
            s.identity.alias("identity_percentage"), F.coalesce(round1(F.try_divide(s.gaps * 100.0, s.alignment_length)), F.lit(0.0)).alias("gap_percentage"),
            F.coalesce(F.try_divide(s.gaps, s.gap_openings), F.lit(0.0)).alias("average_gap_length"), F.coalesce(F.try_divide(s.total_score, s.alignment_length), F.lit(0.0)).alias("score_per_position"),
        ).alias("quality"),
    )


def compare_alignments(one: Column, two: Column) -> Column:
    """Differences of two ``affine_score`` structs, and which is better."""
    return F.struct(
        (one.total_score - two.total_score).alias("score_difference"), (one.identity - two.identity).alias("identity_difference"), (one.gaps - two.gaps).alias("gap_difference"),
        (one.total_score > two.total_score).alias("better_score"), (one.identity > two.identity).alias("better_identity"), (one.gaps < two.gaps).alias("fewer_gaps"),
    )


def editor_stats(a: Column | str, b: Column | str) -> Column:
    return F.struct(F.length(col(a)).cast("long").alias("length"), F.length(degap(a)).cast("long").alias("length1"), F.length(degap(b)).cast("long").alias("length2"), of_kind(kinds(a, b), "gap").alias("gap_columns"))


def quality_score(score: Column, length: Column, identity: Column) -> Column:
    """0 to 100 from score, length and identity."""
    return js_round(F.least(score / 20.0, F.lit(1.0)) * 40 + F.least(length / 50.0, F.lit(1.0)) * 30 + identity * 0.3)


