"""Column functions on sequences. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets in the order in which they are tried, and groups of residues that replace each other.
ALPHABETS = (("DNA", "ATCG"), ("RNA", "AUCG"), ("PROTEIN", "ACDEFGHIKLMNPQRSTVWY"))
CONSERVATIVE = ("AGST", "DE", "NQ", "RKH", "ILVM", "FYW", "C")
#: Classes of residues, first that fits.
RESIDUE_CLASSES = (("C", "aa-cysteine"), ("G", "aa-glycine"), ("P", "aa-proline"), ("FWY", "aa-aromatic"), ("RK", "aa-positive"), ("DE", "aa-negative"), ("NQSTYH", "aa-polar"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x: Column) -> Column:
    """To whole numbers, halves upwards."""
    return F.floor(x + F.lit(0.5))


def round1(x: Column) -> Column:
    """To one decimal, halves upwards."""
    return F.floor(x * 10 + F.lit(0.5)) / F.lit(10.0)


def chars(s: Column | str) -> Column:
    """The letters of a string; none for an empty one."""
    s = col(s)
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def upto(n: Column) -> Column:
    """0 .. n-1; empty where n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def clean_dna(s: Column | str, window: int = 1) -> Column:
    """Upper case, other letters than ATGC stripped; empty if shorter than ``window``."""
    stripped = F.regexp_replace(F.upper(col(s)), "[^ATGC]+", "")
    if window <= 1:
        return F.coalesce(stripped, F.lit(""))  # stripped once
    return F.when(F.length(stripped) >= window, stripped).otherwise("")


def complement(s: Column | str) -> Column:
    return F.translate(col(s), "ATGC", "TACG")


def reverse_complement(s: Column | str) -> Column:
    return F.reverse(complement(s))


def degap(s: Column | str) -> Column:
    return F.replace(col(s), F.lit("-"), F.lit(""))


def safe_substring(s: Column | str, start: Column | int, length: Column | int) -> Column:
    """0-based; cut at the end, empty if ``start`` is outside."""
    s, start = col(s), F.lit(start)
    return F.when((start >= 0) & (start < F.length(s)), F.substring(s, start + 1, F.lit(length))).otherwise("")


def sequence_type(s: Column | str) -> Column:
    out = None
    for name, letters in ALPHABETS:
        hit = col(s).rlike(f"(?i)\\A[{letters}]+\\z")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def kmers(s: Column | str, k: int) -> Column:
    """array<struct<pos, kmer>> of all substrings of length ``k``; empty if there is none."""
    s = col(s)
    return F.transform(upto(F.length(s) - k + 1), lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))


def same_kmer(a: Column | str, b: Column | str) -> Column:
    return F.upper(col(a)) == F.upper(col(b))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places; infinite for unequal lengths."""
    a, b = col(a), col(b)
    different = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda x: x))
    return F.when(F.length(a) == F.length(b), different.cast("double")).otherwise(F.lit(float("inf")))


def close_kmer(a: Column | str, b: Column | str, allow_mismatch: bool) -> Column:
    return hamming(a, b) <= 1 if allow_mismatch else same_kmer(a, b)


def conservative_group(residue: Column | str) -> Column:
    letters = "".join(CONSERVATIVE)
    return F.translate(col(residue), letters, "".join(str(i) * len(g) for i, g in enumerate(CONSERVATIVE)))


def is_conservative(a: Column | str, b: Column | str, kind: Column | str) -> Column:
    """Both residues of a protein in one group."""
    a, b = col(a), col(b)
    known = a.isin(*"".join(CONSERVATIVE)) & b.isin(*"".join(CONSERVATIVE))
    return (F.lit(kind) if isinstance(kind, str) else kind).eqNullSafe("PROTEIN") & known & (conservative_group(a) == conservative_group(b))


def residue_similarity(a: Column | str, b: Column | str, kind: Column | str) -> Column:
    return F.when(col(a) == col(b), 1.0).when(is_conservative(a, b, kind), 0.5).otherwise(0.0)


def residue_class(residue: Column | str, kind: Column) -> Column:
    x = F.upper(col(residue))
    base = F.when(x == "A", "nucleotide-A").when(x.isin("T", "U"), "nucleotide-T").when(x == "C", "nucleotide-C").when(x == "G", "nucleotide-G").otherwise("nucleotide-gap")
    acid = None
    for letters, name in RESIDUE_CLASSES:
        acid = F.when(x.isin(*letters), name) if acid is None else acid.when(x.isin(*letters), name)
    return F.when(kind.isin("DNA", "RNA"), base).when(kind == "PROTEIN", acid.otherwise("aa-hydrophobic")).otherwise("")


def match_line(a: Column | str, b: Column | str) -> Column:
    """A bar where both letters are equal and no gap."""
    return F.array_join(F.zip_with(chars(a), chars(b), lambda x, y: F.when((x == y) & (x != "-"), "|").otherwise(" ")), "")


def substitution(matrix: Column, a: Column, b: Column) -> Column:
    """The score of two letters; 0 for gaps and unknown letters."""
    known = F.coalesce(F.try_element_at(matrix, F.concat(F.upper(a), F.upper(b))), F.lit(0.0))
    return F.when((a == "-") | (b == "-"), 0.0).otherwise(known)


def match_line_by_score(a: Column | str, b: Column | str, matrix: Column) -> Column:
    """Bars for equal letters, colons for others of positive score."""

    def mark(x: Column, y: Column) -> Column:
        gap = (x == "-") | (y == "-")
        return F.when(gap, " ").when(F.upper(x) == F.upper(y), "|").when(substitution(matrix, x, y) > 0, ":").otherwise(" ")

    return F.array_join(F.zip_with(chars(a), chars(b), mark), "")


def score_line(a: Column | str, b: Column | str, matrix: Column, gap_open: float) -> Column:
    """The rounded score of each column; a gap shows the opening."""
    gap = js_round(F.lit(float(gap_open))).cast("string")
    show = lambda x, y: F.when((x == "-") | (y == "-"), gap).otherwise(js_round(substitution(matrix, x, y)).cast("string"))
    return F.array_join(F.zip_with(chars(a), chars(b), show), " ")


def context(s: Column | str, center: Column, reach: int = 10) -> Column:
    """``reach`` letters to either side of ``center``, blanks outside the sequence."""
    s = col(s)
    from_, to = center - reach, center + reach
    inner = F.substring(s, F.greatest(from_, F.lit(0)) + 1, F.greatest(F.least(to, F.length(s) - 1) - F.greatest(from_, F.lit(0)) + 1, F.lit(0)))
    return F.rpad(F.concat(F.repeat(F.lit(" "), F.greatest(-from_, F.lit(0))), inner), 2 * reach + 1, " ")


def context_match(a: Column | str, b: Column | str) -> Column:
    same = lambda x, y: F.when((x != " ") & (F.upper(x) == F.upper(y)), "|").otherwise(" ")
    return F.array_join(F.zip_with(chars(a), chars(b), same), "")


def format_value(x: Column) -> Column:
    """One decimal; '0' for null."""
    return F.coalesce(round1(x).cast("string"), F.lit("0"))


def format_percentage(x: Column) -> Column:
    return F.concat(format_value(x), F.lit("%"))
