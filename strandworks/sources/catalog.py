"""Example pairs: catalog, key, level, window, seq1, seq2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "catalog string, key string, level string, window int, seq1 string, seq2 string"
TIERS = ("beginner", "intermediate", "advanced")
#: The example sequences.
EXAMPLES = [
    ("global", "identical-dna", None, None, "ATCGATGCT", "ATCGATGCT"),
    ("global", "similar-dna", None, None, "ATCGATCGAATCGT", "ATGGATCGTATAGT"),
    ("global", "indel-example", None, None, "ATCGCGTATGCAACG", "ATCGATGCAACG"),
    ("global", "length-difference", None, None, "ATCGATCGATCG", "ATCGAA"),
    ("global", "rna-example", None, None, "GCTAGCTAGCTATGCG", "ACATAAGGTACCTAGAG"),
    ("global", "tandem-repeats", None, None, "GCTAGCTGCTAGCTGCTAGCT", "TAGCTGCTAGCTGCTAGCTGCTAG"),
    ("global", "partialy-similar-sequences", None, None, "TATTGAACCAGGTGACACCCGTTATA", "TATTGAACCAGGTTGTTATAAACAAT"),
    ("global", "small-inversion", None, None, "GAGGTCGCCGTATGCAGACGCTCGGAT", "TGAGCGCCGTATGCAGCGTTACCCCA"),
    ("local", "core-motif", None, None, "GAGCGTCTGTTGACATCGTACGATTGCAACGATT", "CGTCTTGGCTAATCTTGACATCGTACGATGGTCGGTT"),
    ("local", "sequence-overlap", None, None, "GAGCGTCTGGCGTCTTGGCTAATC", "GCGTCTTGGCTAATCCCCCTACAT"),
    ("local", "te-insertion", None, None, "GGCCAGTGGTCGGTTGCTACACCCCTGCCGCAACGTTGAAGGTCCCGG", "GGCCAGTGGTCGGTTGAACGTTGAAGGTCCCGG"),
    ("local", "repeat", None, None, "GAGCGTCTGGCGTCTTGGCTAAT", "GTGCGTCTGGCCTCTTGGCTAATGAGCGTCTGGCCTCTTGGCTAAT"),
    ("local", "partialy-similar", None, None, "CAAGGGCGAGTATTGAACCAGGTGACACCCGTTATACTCCA", "CAAGGGCGAGTATTGAACCAGGTTGTTATAAACAATCAGTG"),
    ("local", "unrelated-sequences", None, None, "GAAGTTATGGAGCATAATAACATGTGGATGGCCAGTGGTCGGTTGCTACA", "CCCTGCCGCGGTCCCGGATTAGACTGGCTGGATCTATGCCGTGACACCCG"),
    ("dotplot", "self-comparison", None, None, "GAGCGTCTGGCGTCTTGGCTAATCCCCCTACATGTTGT", "GAGCGTCTGGCGTCTTGGCTAATCCCCCTACATGTTGT"),
    ("dotplot", "direct-repeat", None, None, "GACTCGCTGTTTTCGAAATTTGCTTCGAAATTTGCGCTCAAGGGCGAGT", "GACTCGCTGTTTTCGAAATTTGCTTCGAAATTTGCGCTCAAGGGCGAGT"),
    ("dotplot", "inverted-repeat", None, None, "TGCCATTCTCTCAGTGTATTACGCGTAATACACTGAGAGAATGGCA", "TGCCATTCTCTCAGTGTATTACGCGTAATACACTGAGAGAATGGCA"),
    ("dotplot", "inverted-repeat2", None, None, "TGCCATTCTCTCAGTGTATTAACGTCGCGTAATACACTGAGAGAATGGCA", "TGCCATTCTCTCAGTGTATTACCTACGCGTAATACACTGAGAGAATGGCA"),
    ("dotplot", "mutations", None, None, "AGCTTAGCAGCTTGACGTAACG", "AGCTGAGCATCTTGCCGTAACG"),
    ("dotplot", "inversion-deletion", None, None, "GACTCGCTGTTTTCGAAATTTGCGCTCAAGGGCG", "GACTCGCTGTTTTCGAAATAAACAATTGCGCTCAAGGGCG"),
    ("dotplot", "middle-inversion", None, None, "TATAAACCTGTTAGCTTACCTGACTCTACTTGGAAAT", "TATAAACCTGTGGTAAGCTATGACTCTACTTGGAAAT"),
    ("dotplot", "partial-overlap", None, None, "AGCTTAGCAGCTTGAC", "GCAGCTTGACGTAACG"),
    ("dotplot", "tandem-repeats", None, None, "GTGTTGACGTAACGGTGTTGACGTAACGGTGTTGACGTAACGGTGTTGA", "GTGTTGACGTAACGGTGTTGACGTAACGGTGTTGACGTAACGGTGTTGA"),
    ("dotplot", "tandem-repeats2", None, None, "AGATCAGATCAGATCAGATCAGATCAGATCAGATCAGATCAGATCAGAT", "AGATCAGATCAGATCAGATCAGATCAGATCAGATCAGATCAGATCAGAT"),
    ("dotplot", "low-complexity", None, None, "AAAAAAAAAATTTTTTTTTT", "AAAAAAATTTTAAAAAAATTTTAAAAAA"),
    ("dotplot", "low-complexity2", None, None, "AAAAAAAAAATTTTTTTTTTCCCCCCCCCCCATATATATAT", "AAAAAAAAAATTTTTTTTTTCCCCCCCCCCCATATATATAT"),
    ("dotplot", "duplication", None, None, "TGGTCGGATCCATCGTTGGCGCCCGACCCCCCCATTCCA", "TGGTCGGATCCATCGTTGGCCCATCGTTGGCGCCCGACCCCCCCATTCCA"),
    ("dotplot-long", "gene-duplications", None, 8, "ATGTACAACAATACTTATTAGTCATCTTTTAGACACAATCTCCCTGCTCAGTGGTATATGGTTTTAGACACAATCTCCCTGCTCAGTGGTATATGGTTTTTGCTATAATTAGCCACCCTCATAAGTTGCACTACTTCTGCGACCCAAATGCACCCTTACCACGAAGACAGGATTGTCCGATCCTA", "ATGTACAACAATACTTATTAGTCATCTTTTAGACACAATCTCCCTGCTCAGTGGTATATGGTTTTAGACACAATCTCCCTGCTCAGTGGTATATGGTTTTTGCTATAATTAGCCACCCTCATAAGTTGCACTACTTCTGCGACCCAAATGCACCCTTACCACGAAGACAGGATTGTCCGATCCTA"),
    ("dotplot-long", "chromosomal-inversion", None, 6, "CTAGGACGGGCGCAAAGGATATATAATTCAATTAAGAATACCTTATATTATTGTACACCTACCGGTCACCAGCCAACAATGTGCGGATGGCGTTACGACTTACTGGGCCTGATCTCACCGCTTTAGATACCGCACACTGGGCAATACGAGGTAAAGCCAGTCACCCAGTGTCGATCAACAGCTAACGTAACGGTAAGAGG", "CTAGGACGGGCGCAAAGGATATATAATTCAATTAAGAATACCTTATATTATTGTACACCTACCGGTCACCAGCCAACAATGTGCGGATGGCGTTACGACTTACTGGGCCTGATCTCACCGCTTTAGACCTCTTACCGTTACGTTAGCTGTTGATCGACACTGGGTGACTGGCTTTACCTCGTATTGCCCAGTGTGCGGTA"),
    ("dotplot-long", "tandem-repeat-expansion", None, 5, "ATCGATCGATCGAACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTAAGGCTTATGCGCAATCCGGATCGATCGATCGATCGATCGATCGATCGATCG", "ATCGATCGATCGAACGTACGTACGTACGTACGTAAGGCTTATGCGCAATCCGGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCGATCG"),
    ("dotplot-long", "transposon-insertion", None, 7, "CTCACAAAATCGCACTGTCGGCGTCCCTTGGGTATTTTACGTTAGCATCAGGTGGACTAGCATGAATCTTTACTCCCAGGCGAAAACGGGTGCGTGGACAAGTTTACGTTAGCATCAGGTGCGAGCAGCAAACGAAAATTCTTGGCCTGCTTGGTGTCTCGTATTTCTC", "CTCACAAAATCGCACTGTCGGCGTCCCTTGGGTATTTTACGTTAGCATCAGGTGGACTAGCATGAATCTTTACTCCCAGGCGAAAACGGGTGCGTGGACAAGTTTACGTTAGCATCAGGTGCGAGCAGCAAACGAAAATTCTTGGCCTGCTTGGTGTCTCGTATTTCTC"),
    ("dotplot-long", "syntenic-regions", None, 9, "GCGCTGATAGTCGTTGTGTCCCGACAGGCTAGGATATAAGATATCACCAGTACCCAAAACATACGTTCAGCGTGGGATCAGGCGGGCTCGCCACGTTGGCTAATCCTGGACATGTACGAGACCATGTTACATTTTGTAAATGTTCAGAAGAA", "AATTTGTGTTAGAAGGTTGTGTCCCGACAGGCTAGGATATAACGAGTCACCACGTACCAATAGCAAATACGTTCAGCGTGGGATCAACGATCGGTCCTATTCATTGTGGTGGACATGTACGAGACCATGTTGACGCTCGGATTACACGGGAAAGGTGC"),
    ("dotplot-long", "segmental-duplication", None, 8, "ATAGATTTGCGTTACTGTCTGCATAAGGAGTCCGGTGTAGCGAAGGATGAAGGCGACCCTAGGTAGCAACCGCCGGCTTCGGCGGTAAGGTATCACTCAGGAAGCAGACACAGAAAGACACG", "ATAGATTTGCGTTACTGTCTGCATAAGGAGTCCGGTGTAGCGAAGGATGAAGGCGACCCTAGGTAGCAGGTGTAGCGAAGGATGAAGGCGACCCTAGGTAGCAACCGCCGGCTTCGGCGGTAAGGTATCACTCAGGAAGCAGACACAGAAAGACACG"),
    ("dotplot-long", "similar-sequences", None, 8, "GTTAATTCTATAGCAATACGATCATATGCGGATGGGCAGTGGCCGGTAGTCACACGTCTACCGCGGTGCTCAATGACCGGGACTAAAGAGGCGAAGATTATGGTGTGTGACCCGTTATGCTCGAGTTCGGTCAGAGCGTCATTGCGAGTAGTCGATTGCTTTCTCAATCTCCGAGCGATTTAGCGTGACAGCCCCAGGGA", "GTTAATAGGATAGCAATACGATAGTACGTGGATGGTCAGTGGCCGGTAGTCACACATGTTCCCCGGTGCTTAATGACCGGGACTAAAGAGGCGAAGATTATGGTGTGTAACCCGTTATGCTCGAGTTCGGTCAGAGCGTTATTGCGAGTAGCCGATTGCTTTCGCAATCTCCGGGCGATTTAGCGTGATTGCCCCAGGGA"),
    ("affine", "simple_match", "beginner", None, "ATCGATCG", "ATCAATCG"),
    ("affine", "simple_insertion", "beginner", None, "ATCGATCG", "ATCGAATCG"),
    ("affine", "simple_deletion", "beginner", None, "ATCGATCG", "ATCGTCG"),
    ("affine", "multiple_gaps", "intermediate", None, "ATCGATAACG", "ATCGATCG"),
    ("affine", "transition_mutations", "intermediate", None, "ATCGATCGAT", "GTCAATCAGT"),
    ("affine", "transversion_mutations", "intermediate", None, "AAAAGGGG", "CCCCTTTT"),
    ("affine", "mixed_mutations", "intermediate", None, "ATCGATCGATCG", "ATCGAACGATG"),
    ("affine", "repetitive_sequences", "advanced", None, "ATATATCGATCGATAT", "ATATCGATCGATAT"),
    ("affine", "gc_rich", "advanced", None, "GCGCGCGCATGCGC", "GCGCGCATGCGCGC"),
    ("affine", "at_rich", "advanced", None, "ATATATATCGATAT", "ATATATCGATATATAG"),
    ("affine", "long_gap", "advanced", None, "ATCGATCG", "ATCGAAAAAAAATCG"),
    ("affine", "terminal_gaps", "advanced", None, "AAATCGATCGCCC", "TCGATCG"),
    ("affine", "highly_divergent", "advanced", None, "AAAATTTTCCCCGGGG", "GGGCCCCTTTTAAAA"),
    ("affine", "gap_opening_demo", "educational", None, "ATCGAAAATCG", "ATCGATCG"),
    ("affine", "gap_extension_demo", "educational", None, "ATCGAAAAATCG", "ATCGATCG"),
    ("affine", "substitution_matrix_demo", "educational", None, "AAAGGGCCCTTTT", "GGGTTTAAACCC"),
    ("affine", "end_gap_demo", "educational", None, "ATCGATCGATCG", "GATCGATCG"),
    ("tiered", "beginner-dna-1", "beginner", None, "ATCGATCG", "ATCGATCG"),
    ("tiered", "beginner-dna-2", "beginner", None, "ATCGATCG", "ATCGATCC"),
    ("tiered", "beginner-dna-3", "beginner", None, "ATCGATCG", "ATCGAATCG"),
    ("tiered", "beginner-protein-1", "beginner", None, "ACDEFGH", "ACDEFGH"),
    ("tiered", "beginner-protein-2", "beginner", None, "ACDEFGH", "ACDEAGH"),
    ("tiered", "beginner-protein-3", "beginner", None, "ACDEFGH", "ACDEAFGH"),
    ("tiered", "intermediate-dna-1", "intermediate", None, "ATCGATCGAAT", "ATCGAATCGAT"),
    ("tiered", "intermediate-dna-2", "intermediate", None, "ATCGATCGAAT", "ATCGATAAT"),
    ("tiered", "intermediate-dna-3", "intermediate", None, "ATCGATCG", "GGATCGATCC"),
    ("tiered", "intermediate-protein-1", "intermediate", None, "ACDEFGHIKL", "ACDEAGHIKM"),
    ("tiered", "intermediate-protein-2", "intermediate", None, "ACDEFGHIKL", "ACDEFGIKL"),
    ("tiered", "intermediate-protein-3", "intermediate", None, "ACDEFGH", "ACDEAFGHIK"),
    ("tiered", "advanced-dna-1", "advanced", None, "ATCGATCGAATGCC", "AACGATCGGTGCT"),
    ("tiered", "advanced-dna-2", "advanced", None, "ATCGATCGAAT", "GGGATCGCCAAT"),
    ("tiered", "advanced-dna-3", "advanced", None, "ATCGATCG", "CGATCGATAA"),
    ("tiered", "advanced-protein-1", "advanced", None, "ACDEFGHIKLMNP", "ACDAGGHIKLMQP"),
    ("tiered", "advanced-protein-2", "advanced", None, "ACDEFGHIKL", "ACEGHIKLNP"),
    ("tiered", "advanced-protein-3", "advanced", None, "ACDEFGH", "DEFGHACL"),
    ("search", "example-1", None, None, "ATCGATCGAA", "GGATCGATCGAATCGTAGCCATCGATCGAATTGCCGATCG"),
    ("search", "example-2", None, None, "GCTAGCTAG", "AAGCTAGCTAGTTGCTAGCTAGAAACCGCTAGCTGAATTCGCTAGCTAGG"),
    ("search", "example-3", None, None, "TTAACCGGTT", "CCTTAACCGGTTAACCGGAACCTTAACCGGTTATCGTTAACCGGTTGGCC"),
]


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXAMPLES, SCHEMA)


def example(spark: SparkSession, catalog: str, key: str, default: str | None = None) -> DataFrame:
    """The example of that key, or else that of ``default``."""
    rows = examples(spark).filter(F.col("catalog") == catalog)
    return rows.filter(F.col("key").isin(key, default) if default else F.col("key") == key).orderBy(F.col("key") != key).limit(1)


def listing(spark: SparkSession, catalog: str) -> DataFrame:
    return examples(spark).filter(F.col("catalog") == catalog).select("key", "level", "window")


def by_level(spark: SparkSession, level: str) -> DataFrame:
    return examples(spark).filter((F.col("catalog") == "affine") & (F.col("level") == level))


def levels(spark: SparkSession) -> DataFrame:
    return examples(spark).filter("catalog = 'affine'").select("level").distinct()


def tier(spark: SparkSession, name: str) -> DataFrame:
    """The pairs of a difficulty; an unknown one is the first."""
    return examples(spark).filter((F.col("catalog") == "tiered") & (F.col("level") == (name if name in TIERS else TIERS[0])))


def random_example(spark: SparkSession, catalog: str, seed: int | None = None) -> DataFrame:
    return examples(spark).filter(F.col("catalog") == catalog).orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1)


def sound(rows: DataFrame, low: int = 5, high: int = 50) -> DataFrame:
    """Examples of DNA letters alone, of lengths within the limits."""
    good = lambda c: F.col(c).rlike(r"\A[ATCG]+\z") & F.length(c).between(low, high)
    return rows.filter(good("seq1") & good("seq2"))
