"""Edge tables that every operator must take."""

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [None, "", "   \n\t ", "one", "one two three four five six", "one two three four five six", "Ünï çödé — ☃ 😀\u2003x\x00y", "a" * 30_000, LONG, "it's <|endoftext|> here", "line\n\nline\nline", "1234 5678 !!!! ??"]


def edge_docs(spark, extra=True):
    """Texts with nulls, empties, long ones, repeats, a null id, a repeated id, and columns with clashing names."""
    rows = [(i, t, None if i % 5 == 3 else "en", None if i % 4 == 2 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id at all here now", "de", "s0", 21), (4, TEXTS[4], "en", "s0", 29), (4, "another text under the same id", "en", "s1", 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if not extra:
        return df
    return df.selectExpr("*", "'x' as rank", "1.5d as score", "true as kept", "7 as component_id", "'t' as topic", "3L as n_tokens", "'k' as set_key", "0 as line", "'g' as gone", "1 as prob")


def empty_docs(spark):
    return edge_docs(spark, False).limit(0)
