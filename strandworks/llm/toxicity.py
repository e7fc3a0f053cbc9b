"""Toxicity: a weighted finite-state grammar over clauses.

Words have classes: insult, threat, target, negation, reported speech. Small
transducers read the classes of a clause and mark its insults and threats:
negated (a negation stands up to three words before or two after), reported
(a word of speech stands in the clause), aimed (a target stands within four
words). They are composed into one machine for each direction, which run over
the clauses that hold an insult or a threat; the others weigh nothing. Every
arc has a weight: an insult's own weight times that of its marks, a threat's
by its marks, a little for each other word. A clause's weight is the sum along
its path, and gives the probability that the clause is toxic; a document is
toxic if any of its clauses is (or for no clause's sake, with a small chance).

Insults and all weights are learned from labelled rows: first the words and
the beginnings of words that stand in significantly more places of toxic
documents (a test against the number of all words, so chance finds stay out),
then the weights of the arcs, for which the labels of whole documents are most
likely. At most ``SAMPLE`` labelled rows are
used, the first by a hash of doc_id; all sums over them run on Spark. Every
text is scored whole.

Defined results: null and empty texts have no match and get the small
chance alone; a row without doc_id is not held out; repeated rows give
repeated results; of labelled rows that share a doc_id the least text is
learned from; without labels of both kinds no insult is learned and the
prior weights hold; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_small_batches, saved

#: Bound of the labelled rows that the grammar is fitted on.
SAMPLE = 10_000
FOLDS = 5
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed word classes of the four languages.
THREATS = "kill murder hurt destroy strangle shoot stab töten umbringen erschießen tuer assassiner frapper matar asesinar golpear".split()
TARGETS = "you your yours he she they them him her people dich dir euch ihn sie toi vous ton votre lui eux tú ti usted ustedes ellos".split()
NEGATIONS = "not no never none nobody isn't don't nicht kein keine niemals nie pas jamais aucun ni nunca nadie".split()
REPORTS = "said says say wrote writes claimed called told asked quoted according sagte schrieb behauptete laut dit écrit affirmé selon dijo escribió según".split()
CLASSES = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_ENDS = re.compile(r"[.!?;:\n]")
STEMS = range(4, 9)
NEGATED, REPORTED, AIMED = 1, 2, 4

Machine = dict[tuple[int, int], tuple[int, int]]  # (state, class) -> (state, marks); state 0 starts


def countdown(trigger: int, reach: int, mark: int) -> Machine:
    """Marks insults and threats up to ``reach`` words after a word of class ``trigger``."""
    return {(s, c): (reach if c == trigger else max(s - 1, 0), mark if s and c in (INSULT, THREAT) else 0) for s in range(reach + 1) for c in range(6)}


def from_then_on(trigger: int, mark: int) -> Machine:
    return {(s, c): (1 if s or c == trigger else 0, mark if s and c in (INSULT, THREAT) else 0) for s in (0, 1) for c in range(6)}


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines at once: pairs of states, and the marks of both."""
    width = 1 + max(s for s, _ in b)
    return {(sa * width + sb, c): (ta * width + tb, ma | mb) for (sa, c), (ta, ma) in a.items() for (sb, cb), (tb, mb) in b.items() if c == cb}


FORWARD = compose(compose(countdown(NEGATION, 3, NEGATED), from_then_on(REPORT, REPORTED)), countdown(TARGET, 4, AIMED))
BACKWARD = compose(compose(countdown(NEGATION, 2, NEGATED), from_then_on(REPORT, REPORTED)), countdown(TARGET, 4, AIMED))


def marks(classes: list[int]) -> list[int]:
    """The marks of each word of a clause."""
    out, state = [], 0
    for c in classes:
        state, m = FORWARD[state, c]
        out.append(m)
    state = 0
    for i in range(len(classes) - 1, -1, -1):
        state, m = BACKWARD[state, classes[i]]
        out[i] |= m
    return out


#: What arcs have weights for: insults by their marks, threats by theirs, other words (in tens); and the constant of a clause.
ARCS = ("plain", "negated", "reported", "aimed", "threat", "aimed_threat", "excused_threat", "other", "clause")
PRIOR = np.array([0.7, 0.2, 0.2, 0.9, 0.0, 1.5, -0.5, 0.0, -2.5])
#: The log odds of a document's being toxic for no clause's sake.
LEAK = -4.0


def arc(c: int, m: int) -> str:
    """Which weight an arc that reads class ``c`` and writes marks ``m`` has."""
    if c == INSULT:
        return "negated" if m & NEGATED else "reported" if m & REPORTED else "aimed" if m & AIMED else "plain"
    if c == THREAT:
        return "excused_threat" if m & (NEGATED | REPORTED) else "aimed_threat" if m & AIMED else "threat"
    return "other"


ARC_AT = {(c, m): ARCS.index(arc(c, m)) for c in range(6) for m in range(8)}


@dataclass
class Grammar:
    insults: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    leak: float = LEAK

    def finder(self):
        """An automaton for the words that make a clause worth reading."""
        found = ahocorasick.Automaton()
        for w in {*self.insults, *self.stems, *THREATS}:
            found.add_word(w, len(w))
        if len(found):
            found.make_automaton()
        return found

    def insult(self, word: str) -> float:
        return max([self.insults.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if k < len(word))]) if len(word) > 2 else 0.0

    def clauses(self, text: str, finder) -> list[list[float]]:
        """Of each clause with an insult or a threat: how often each arc is taken, insults by their own weight."""
        out, low, done = [], text.lower(), 0
        for end, n in finder.iter(low) if len(finder) else ():
            start = end - n + 1
            if start < done or (start and low[start - 1].isalpha()):
                continue
            left = max(done, *(low.rfind(c, done, start) + 1 for c in ".!?;:\n"))
            right = m.start() if (m := CLAUSE_ENDS.search(low, end + 1)) else len(low)
            done = right
            words = WORD.findall(low[left:right])
            own = [self.insult(w) for w in words]
            classes = [INSULT if x > 0 else CLASSES.get(w, OTHER) for w, x in zip(words, own)]
            if INSULT not in classes and THREAT not in classes:
                continue
            path = [0.0] * len(ARCS)
            path[-1] = 1.0
            for c, x, m in zip(classes, own, marks(classes)):
                path[ARC_AT[c, m]] += x if c == INSULT else 1.0 if c == THREAT else 0.1
            out.append(path)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        finder = self.finder()
        found = [self.clauses(t, finder) for t in texts]
        return chance(self.weights, self.leak, *stacked(found))


def stacked(found: list[list[list[float]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """All clauses in a row, the document of each, and the number of documents."""
    sizes = [len(x) for x in found]
    rows = np.array([c for x in found for c in x], float).reshape(-1, len(ARCS))
    return rows, np.repeat(np.arange(len(found)), sizes), len(found)


def chance(weights: np.ndarray, leak: float, rows: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The probability that any clause of a document is toxic."""
    none = np.bincount(doc, np.logaddexp(0, rows @ weights), n) + np.logaddexp(0, leak)  # minus the log of no clause's being so
    return -np.expm1(-none)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _texts(batch: pd.DataFrame) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch["text"]]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``sample`` labelled rows outside the held-out fold."""
    own = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most ``sample`` small rows
    return known.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("doc_id")


def word_counts(rows: DataFrame) -> DataFrame:
    """word, bad: different places in toxic texts, docs: toxic texts, good: occurrences in other texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good, bad = Counter(), []
            for text, toxic in zip(_texts(batch), batch["toxic"].tolist()):
                words = WORD.findall(text.lower())
                if not toxic:
                    good.update(words)
                    continue
                mark = xxhash.xxh3_64_intdigest(text) >> 1
                around = ["", *words, ""]
                bad += {(w, xxhash.xxh3_64_intdigest(around[i] + " " + around[i + 2]) >> 1, mark) for i, w in enumerate(words)}
            if good or bad:
                yield pd.DataFrame({"word": [*good, *(b[0] for b in bad)], "good": [*good.values(), *[0] * len(bad)], "place": [*[-1] * len(good), *(b[1] for b in bad)], "mark": [*[-1] * len(good), *(b[2] for b in bad)]})

    places = rows.mapInPandas(run, "word string, good long, place long, mark long").filter(F.length("word").between(3, 40))
    once = places.groupBy("word", "place").agg(F.sum("good").alias("good"), F.min("mark").alias("mark"))
    return once.groupBy("word").agg(F.sum("good").alias("good"), F.count_if(F.col("place") >= 0).alias("bad"), F.countDistinct(F.when(F.col("place") >= 0, F.col("mark"))).alias("docs"))


def significant(terms: DataFrame, share: float, n_terms: int) -> DataFrame:
    """The terms whose places are so rarely in good texts that chance among all terms is out, with their log odds."""
    total = F.col("good") + F.col("bad")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (total * p))).otherwise(0.0)
    g = part(F.col("bad"), F.lit(share)) + part(F.col("good"), F.lit(1 - share))
    odds = F.log((F.col("bad") + 0.5) / F.lit(share)) - F.log((F.col("good") + 0.5) / F.lit(1 - share))
    return terms.withColumn("weight", odds).filter((g >= float(np.log(max(n_terms, 1)) + 3)) & (F.col("weight") >= float(np.log(12.0))) & (F.col("docs") >= 3))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    rows = saved(training_rows(docs, labels, sample), "toxic-sample")
    counts = saved(word_counts(rows), "toxic-words")
    good, bad, n = counts.agg(F.sum("good"), F.sum("bad"), F.count("*")).first()  # three numbers
    grammar = Grammar()
    if good and bad:
        share = bad / (good + bad)
        stems = counts.select(F.explode(F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda k: k < F.length("word")), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("word"), "good", "bad", "docs")
        stems = stems.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("docs").alias("docs"), F.count_if(F.col("bad") > 0).alias("words")).filter("words >= 3 and bad > 3")
        grammar.insults = {r["word"]: r["weight"] for r in significant(counts, share, n).select("word", "weight").collect()}  # bounded by the sample
        grammar.stems = {r["word"]: r["weight"] for r in significant(stems, share, n).select("word", "weight").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = shared.value.finder()
        for batch in batches:
            yield pd.DataFrame({"x": [[v for c in shared.value.clauses(t, finder) for v in c] for t in _texts(batch)], "y": batch["toxic"]})

    fitted = rows.mapInPandas(run, "x array<double>, y int").toPandas()  # at most ``sample`` rows of a few clauses
    if len(fitted) and fitted["y"].nunique() == 2:
        found = [np.asarray(x, float).reshape(-1, len(ARCS)).tolist() for x in fitted["x"]]
        grammar.weights, grammar.leak = fit(*stacked(found), fitted["y"].to_numpy(float))
    return grammar


def fit(rows: np.ndarray, doc: np.ndarray, n: int, y: np.ndarray, ridge: float = 1.0, steps: int = 600, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Weights and leak under which the labels are most likely; they stay near the prior where the rows tell nothing."""
    start = np.append(PRIOR, LEAK)
    w, mean, square = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, steps + 1):
        z = rows @ w[:-1]
        none = np.bincount(doc, np.logaddexp(0, z), n) + np.logaddexp(0, w[-1])
        slope = np.where(y > 0, -np.exp(-none) / np.maximum(-np.expm1(-none), 1e-9), 1.0)  # of the loss, by ``none``
        rise = slope[doc] / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.append(rows.T @ rise, slope.sum() / (1 + np.exp(-w[-1]))) + ridge * (w - start)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": shared.value.scores(_texts(batch))})

    rows = in_small_batches(docs).select(as_text("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(run, "doc_id string, held_out boolean, score double")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of ``docs`` that the grammar does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([t or "" for t in batch["text"].to_pylist()])
            yield batch.filter(pa.array(scores < 0.5))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
