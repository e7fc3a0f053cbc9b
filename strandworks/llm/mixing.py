"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Token counts are summed
by cell, and the cell weights are raked: in turn, each dimension's marginal is
scaled to its target, until all three hold. The ratio of fitted to observed
tokens, scaled so that the largest is 1, is the probability that a document
of the cell is kept by ``prob``: in expectation the kept tokens have the target mix.
The draw is a hash of the seed and doc_id, so it repeats.

That scale follows one cell, however small, so ``kept`` and ``sample`` use
another: ``rate``, the ratio of shares, is 1 on average, and what exceeds 1 is
met by ``copies``, its whole part and one more by the draw on the rest. In
expectation ``sample`` returns as many tokens as it was given, in the target mix.

Only cells are summed and joined; documents are never shuffled: the table of
cells is written, and Spark broadcasts it by its real size.

Defined results: a null source, language or text is a value of its own
(``''``); null doc_id draws as ``''``; repeated rows draw alike; documents
without words weigh 1 token; a target of 0 keeps nothing; values without a
target are kept at zero; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved

DIMS = ("source", "lang", "topic")
#: First that matches; else prose.
TOPICS = (("contact", "[a-z0-9]@[a-z0-9]"), ("licence", "[Ll]icen[cs]e"), ("figures", "[0-9]{4}"))
#: Default targets: shares in proportion to tokens to this power, so that large sources count for less.
TEMPERATURE = 0.9
ROUNDS = 8
#: Copies of a document that one task makes.
SPLIT = 64
SEED = "mix-1"


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = None
    for name, pattern in topics:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def token_weight(text: Column) -> Column:
    """Words, counted as blanks and line ends and one."""
    return (F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + 1).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def keyed(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """``docs`` with a struct column ``mix_``: the cell and the tokens."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("mix_", F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMS[:2]), topic_of(text, topics).alias("topic"), token_weight(text).alias("n_tokens")))


def default_targets(cells: DataFrame, dim: str, temperature: float = TEMPERATURE) -> DataFrame:
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("mass"))
    total = sums.agg(F.sum("mass")).first()[0]  # one number
    return sums.select(dim, (F.col("mass") / F.lit(total or 1.0)).alias(f"target_{dim}"))


def rake(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scale ``fitted`` to the columns ``target_<dim>`` in turn, ``rounds`` times."""
    for k in range(rounds):
        for dim in DIMS:
            total = F.sum("fitted").over(W.partitionBy(dim))
            cells = cells.withColumn("fitted", F.coalesce(F.col("fitted") * F.try_divide(F.col(f"target_{dim}"), total), F.lit(0.0)))
        if k % 2 or k == rounds - 1:
            cells = saved(cells, "mix-cells")
    return cells


def cell_rates(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topics=TOPICS, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """source, lang, topic, weight, prob, rate of each cell."""
    cells = saved(keyed(docs, topics).groupBy(*(F.col(f"mix_.{c}").alias(c) for c in DIMS)).agg(F.sum("mix_.n_tokens").alias("tokens")), "mix-sums")
    all_tokens = cells.agg(F.sum("tokens").cast("double")).first()[0]  # one number
    fit = cells.withColumn("fitted", F.col("tokens") / F.lit(all_tokens or 1.0))
    for dim in DIMS:
        if targets and dim in targets:
            named = targets[dim]
            norm = sum(named.values())
            given = docs.sparkSession.createDataFrame([(k, v / norm) for k, v in named.items()], f"{dim} string, target_{dim} double")
        else:
            given = default_targets(cells, dim, temperature)
        fit = fit.join(given, dim, "left").withColumn(f"target_{dim}", F.coalesce(f"target_{dim}", F.lit(0.0)))
    fit = rake(fit, rounds).withColumn("ratio", F.col("fitted") / F.col("tokens"))
    top = fit.agg(F.max("ratio")).first()[0]  # one number
    return saved(fit.select(*DIMS, F.col("fitted").alias("weight"), (F.col("ratio") / F.lit(top or 1.0)).alias("prob"), (F.col("ratio") * F.lit(all_tokens or 1.0)).alias("rate")), "mix-rates")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED, topics=TOPICS, temperature: float = TEMPERATURE, rounds: int = ROUNDS, rates: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``mix_``: source, lang, topic, n_tokens, weight, prob, rate, copies, kept (at least one copy)."""
    rates = cell_rates(docs, targets, topics, temperature, rounds) if rates is None else rates
    rates = rates.select(F.struct(*DIMS).alias("cell_"), "weight", "prob", "rate")
    own = keyed(docs, topics).withColumn("cell_", F.struct(*(F.col(f"mix_.{c}").alias(c) for c in DIMS)))
    whole = F.floor("rate_.rate").cast("long")
    copies = whole + (draw(F.col("doc_id"), seed) < F.col("rate_.rate") - whole).cast("long")
    joined = own.join(rates.select("cell_", F.struct("weight", "prob", "rate").alias("rate_")), "cell_", "left")
    return joined.withColumn("mix_", F.struct("mix_.*", "rate_.weight", "rate_.prob", "rate_.rate", copies.alias("copies"), (copies > 0).alias("kept"))).drop("cell_", "rate_")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: str = SEED, topics=TOPICS, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """The documents, each as often as its ``copies`` say, with the columns of ``docs`` alone.

    A document of more than SPLIT copies is sent to as many tasks as hold
    SPLIT copies each, so that no target makes one task repeat a row without end.
    """
    rates = cell_rates(docs, targets, topics, temperature, rounds)
    kept = mix(docs, seed=seed, topics=topics, rates=rates).filter("mix_.kept")
    each = lambda rows, n: rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
    if not rates.filter(F.col("rate") > SPLIT).count():  # a table of cells
        return each(kept, F.col("mix_.copies"))
    few = each(kept.filter(F.col("mix_.copies") <= SPLIT), F.col("mix_.copies"))
    often = kept.filter(F.col("mix_.copies") > SPLIT).withColumn("part_", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_.copies") - 1) / SPLIT).cast("int"))))
    often = often.withColumn("salt_", F.xxhash64("doc_id", "text", "part_")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "salt_")
    return few.union(each(often, F.least(F.lit(SPLIT), F.col("mix_.copies") - F.col("part_") * SPLIT)))
