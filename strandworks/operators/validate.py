"""Validation as struct columns: is_valid, error, type, clean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequences import clean_dna, col, degap, sequence_type

MIN_LENGTH, MAX_LENGTH = 5, 50


def _first(*checks: tuple[Column, str]) -> Column:
    out = None
    for bad, says in checks:
        out = F.when(bad, F.lit(says)) if out is None else out.when(bad, F.lit(says))
    return out


def validate_sequence(s: Column | str, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    clean = F.upper(F.trim(F.coalesce(col(s), F.lit(""))))
    kind = sequence_type(clean)
    error = _first(
        (clean == "", "Sequence is empty"),
        (F.length(clean) < low, f"Sequence is shorter than {low}"),
        (F.length(clean) > high, f"Sequence is longer than {high}"),
        (kind.isNull(), "Sequence has letters of no known type"),
    )
    return F.struct(error.isNull().alias("is_valid"), error.alias("error"), F.when(error.isNull(), kind).alias("type"), F.when(error.isNull(), clean).alias("clean"))


def validate_pair(a: Column | str, b: Column | str, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    one, two = validate_sequence(a, low, high), validate_sequence(b, low, high)
    error = (
        F.when(~one.is_valid, F.concat(F.lit("Sequence 1: "), one.error))
        .when(~two.is_valid, F.concat(F.lit("Sequence 2: "), two.error))
        .when(one.type != two.type, F.concat(F.lit("Types differ: "), one.type, F.lit(" and "), two.type))
    )
    good = error.isNull()
    return F.struct(good.alias("is_valid"), error.alias("error"), F.when(good, one.type).alias("type"), F.when(good, one.clean).alias("clean1"), F.when(good, two.clean).alias("clean2"))


def kmer_input_errors(s: Column | str, k: Column | int) -> Column:
    """All errors that hold, not the first alone."""
    s, k = F.coalesce(col(s), F.lit("")), F.lit(k)
    found = (
        F.when(s == "", "Sequence is empty"), F.when(k < 1, "k must be at least 1"),
        F.when(F.length(s) < k, "Sequence is shorter than k"), F.when((s != "") & ~s.rlike(r"(?i)\A[ATCGN]+\z"), "Sequence has letters other than A, T, C, G, N"),
    )
    return F.array_compact(F.array(*found))


def search_input_error(query: Column | str, database: Column | str, k: Column | int) -> Column:
    """The first error, null if there is none."""
    q, d, k = F.coalesce(F.trim(col(query)), F.lit("")), F.coalesce(F.trim(col(database)), F.lit("")), F.lit(k)
    letters = r"(?i)\A[ATCGN]+\z"
    return _first(
        ((q == "") | (d == ""), "Both sequences are needed"), (F.length(q) < k, "Query is shorter than k"), (F.length(d) < k, "Database is shorter than k"),
        (~q.rlike(letters), "Query has letters other than A, T, C, G, N"), (~d.rlike(letters), "Database has letters other than A, T, C, G, N"),
    )


def is_dna(s: Column | str) -> Column:
    return F.coalesce(col(s).rlike(r"(?i)\A[ATCG]+\z"), F.lit(False))


def affine_pair_ok(a: Column | str, b: Column | str, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    return is_dna(a) & is_dna(b) & F.length(col(a)).between(low, high) & F.length(col(b)).between(low, high)


def dotplot_error(s: Column | str, window: int = 3, high: int = 50) -> Column:
    """Other letters are stripped silently."""
    clean = clean_dna(F.coalesce(col(s), F.lit("")))
    return _first((clean == "", "Sequence has no DNA letters"), (F.length(clean) < window, "Sequence is shorter than the window"), (F.length(clean) > high, f"Sequence is longer than {high}"))


def long_dotplot_error(s: Column | str, low: int = 3, high: int = 200) -> Column:
    """Other letters are an error, digits and blanks are not."""
    s = F.coalesce(col(s), F.lit(""))
    clean = clean_dna(s)
    letters = F.length(F.regexp_replace(F.upper(s), "[^A-Z]", ""))
    return _first((F.length(s) > high, f"Sequence is longer than {high}"), (F.length(clean) < low, f"Sequence is shorter than {low}"), (letters != F.length(clean), "Sequence has letters other than A, T, G, C"))


def alignment_ok(a: Column | str, b: Column | str, original1: Column | str, original2: Column | str) -> Column:
    """Equal lengths, and the originals without gaps."""
    return (F.length(col(a)) == F.length(col(b))) & (degap(a) == F.upper(col(original1))) & (degap(b) == F.upper(col(original2)))


def clamp_window(x: Column | int, high: int = 10) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(high), F.lit(x)))
