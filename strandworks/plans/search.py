"""Seed-and-extend search as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import in_place, kmers, matches, ordered, packed, seeds
from ..params import Diagonal, Search

#: Queries of up to so many letters are extended in the task of their seeds, whose rows hold what the walks may need.
EXTENDED_IN_TASK = 1024
STAGES = ("kmers", "matches", "seeds", "extensions", "results")


class Stages(Mapping):
    """The frames of the stages by name, each planned when it is first asked for.

    ``dealt`` are matches with the task that holds all of a pair's, ``grown``
    extensions with it where they have one, ``totals``
    numbers of matches and k-mers of each pair. ``by_kmer``, ``by_query`` and
    ``by_db`` hold a row for each k-mer, query place or database place of a
    pair instead of one for each match. ``listed`` are live seeds without such
    rows. ``grown`` extensions have their letters and final_id, ``spelled`` the
    letters, ``numbered`` final_id, ``measured`` neither (each at the least).
    Seeds and extensions of few short queries are told in place; otherwise
    extensions take ``seeds``, which Spark knows to lie with their databases.
    """

    def __init__(self, made: dict[str, Callable[[], DataFrame]]) -> None:
        self._made, self._known = made, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._made[name]()
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(STAGES)

    def __len__(self) -> int:
        return len(STAGES)


def _stages(queries: DataFrame, databases: DataFrame, p: Search | Diagonal, seeded: Callable, grown: Callable, pieces: bool = False) -> Stages:
    known: dict[str, object] = {}

    def once(name: str, made: Callable[[], object]) -> object:
        if name not in known:
            known[name] = made()
        return known[name]

    def of_queries() -> packed.Sizes:
        return once("queries", lambda: packed.sizes(queries))

    def of_databases() -> packed.Sizes:
        return once("databases", lambda: packed.sizes(databases))

    def few() -> bool:
        return of_queries().letters <= packed.BROADCAST_LETTERS

    def parts() -> int:
        return packed.partitions_of(queries, of_queries().letters, of_databases().letters)

    def short() -> bool:
        return few() and of_queries().longest <= EXTENDED_IN_TASK

    def placed() -> bool:
        """Whether seeds and extensions are told where their databases lie."""
        return short() and in_place.fits(of_queries(), of_databases(), p)

    def met(counted: bool = False, fold: str = "") -> DataFrame:
        return packed.met(queries, databases, p.k, counted, few(), fold, parts() if few() else None)

    def beside() -> DataFrame | None:
        """The databases dealt as those of the seeds, where queries are few and short."""
        return packed.dealt(databases, parts()) if short() else None

    def told(teller: in_place.Teller, kinds: str, **given: object) -> DataFrame:
        return in_place.told(queries, databases, parts(), p, teller, kinds, **given)

    by_diagonal = isinstance(p, Diagonal)
    columns = in_place.by_diagonal if by_diagonal else in_place.live
    told_of = seeds.told_by_diagonal if by_diagonal else seeds.told_live

    def placed_seeds() -> DataFrame:
        return columns(told(in_place.seeds, in_place.PIECES if pieces else in_place.SEEDS, pieces=pieces), p)

    def extensions(texts: bool, ranked: bool) -> DataFrame:
        if placed():
            return told_of(in_place.extended(queries, databases, parts(), p, texts, ranked))
        rows = grown(out["seeds"], queries, databases, p, few(), beside())
        return seeds.ranked(rows) if ranked else rows

    def overlapping(of_grown: bool) -> DataFrame:
        if placed():
            return told(in_place.overlapping, in_place.OVERLAPS, grown=of_grown).drop("task")
        return seeds.overlapping_pairs(out["grown"] if of_grown else out["seeds"])

    def top(k: int) -> DataFrame:
        return told(in_place.top, in_place.TOP, k=k).drop("task") if placed() else seeds.top(out["results"], k).select("query_id", "db_id", "seed_id", "score", "rank")

    def of_matches(teller: in_place.Teller, kinds: str, **given: object) -> DataFrame:
        return in_place.told(queries, databases, parts(), Search(k=p.k), teller, kinds, bare=True, **given)

    def dense(window: int, least: float) -> DataFrame:
        if placed() and least > 0:
            return of_matches(in_place.dense, in_place.DENSE, window=window, least=least)
        places = out["by_db"].select(*packed.TASK, F.col("db_pos").cast("long").alias("db_pos"), F.col("query_n").alias("n"), F.col("length").cast("long").alias("length"))
        return matches.dense(places, None, p.k, window, least)

    out = Stages(
        {
            "own": lambda: of_queries().own and of_databases().own,
            "kmers": lambda: kmers.generate(queries, p.k),
            "met": met,
            "counted": lambda: met(True),
            "by_kmer": lambda: met(fold="query db"),
            "by_query": lambda: met(fold="db"),
            "by_db": lambda: met(fold="query"),
            "runs": lambda: packed.runs(out["met"], p.k, p.max_gap, True),
            "dealt": lambda: packed.matches(out["met"], p.k),
            "matches": lambda: out["dealt"].drop("task"),
            "totals": lambda: packed.totals(out["by_kmer"]),
            "statistics": lambda: packed.statistics(out["by_kmer"], out["runs"], p.k),
            "seeds": lambda: placed_seeds() if placed() else seeded(out),
            "listed": lambda: out["seeds"] if placed() or not few() else ordered.seeds(queries, databases, parts(), p),
            "grown": lambda: extensions(True, True),
            "spelled": lambda: extensions(True, False),
            "measured": lambda: extensions(False, False),
            "numbered": lambda: extensions(False, True),
            "second": lambda: columns(told(in_place.seeds, in_place.PIECES, pieces=True, only=1), p) if placed() else out["seeds"].filter("seed_id = 1"),
            "seed_statistics": lambda: told(in_place.statistics, in_place.STATISTICS).drop("task") if placed() else seeds.seed_statistics(out["seeds"]),
            "apart": lambda: columns(told(in_place.without_redundant, in_place.SEEDS, most=0.5), p).drop("task") if placed() else seeds.without_redundant(out["seeds"].drop("task")),
            "seed_overlaps": lambda: overlapping(False),
            "extension_overlaps": lambda: overlapping(True),
            "extension_statistics": lambda: told(in_place.extension_statistics, in_place.EXTENSION_STATISTICS).drop("task") if placed() else seeds.extension_statistics(out["grown"]),
            "summary": lambda: told(in_place.summary, in_place.SUMMARY).drop("task") if placed() else _summary(out),
            "top": lambda: top,
            "diagonals": lambda: of_matches(in_place.diagonals, in_place.DIAGONALS, gaps=False) if placed() else packed.diagonals(out["runs"]),
            "gaps": lambda: of_matches(in_place.diagonals, in_place.GAPS, gaps=True) if placed() else seeds.seed_gaps(out["matches"], p),
            "dense": lambda: dense,
            "uncrowded": lambda: of_matches(in_place.without_close, in_place.CLOSE) if placed() else matches.without_close(out["dealt" if out["own"] else "matches"]),
            "extensions": lambda: out["grown"].drop("task"),
            "results": lambda: seeds.results(out["extensions"]),
        }
    )
    return out


def search(queries: DataFrame, databases: DataFrame, p: Search = Search()) -> Stages:
    return _stages(queries, databases, p, lambda s: seeds.live(s["dealt"], p), seeds.extend_live)


def search_by_diagonal(queries: DataFrame, databases: DataFrame, p: Diagonal = Diagonal(), pieces: bool = False) -> Stages:
    """With ``pieces``, seeds have the runs that they are made of."""

    def seeded(s: Stages) -> DataFrame:
        # runs stand for matches where those of a run always follow each other, and no other sequence has the number
        whole = 1 - p.k <= p.max_gap and s["own"]
        return seeds.by_diagonal(packed.runs(s["met"], p.k, p.max_gap, p.min_matches < 2) if whole else s["dealt"], p, pieces)

    return _stages(queries, databases, p, seeded, seeds.extend_by_diagonal, pieces)


def summary(stages: Stages) -> DataFrame:
    """query_id, db_id: numbers of matches, seeds and results, and the best score (0 if none)."""
    return stages["summary"]


def top(stages: Stages, k: int) -> DataFrame:
    """query_id, db_id, seed_id, score, rank of the ``k`` highest results of each pair."""
    return stages["top"](k)


def dense_regions(stages: Stages, window: int, least: float) -> DataFrame:
    """query_id, db_id, start, density of the windows of databases whose matches are ``least`` of their width or more."""
    return stages["dense"](window, least)


def _summary(stages: Stages) -> DataFrame:
    pair = ["query_id", "db_id"]
    # each seed has one extension, so these tell of seeds and results both
    good = F.col("score") > 0
    e = stages["extensions"].groupBy(*pair).agg(F.count("*").alias("seeds"), F.count_if(good).alias("results"), F.max(F.when(good, F.col("score"))).alias("best_score"))
    out = stages["totals"].join(e, pair, "left")
    return out.select(*pair, "matches", "unique_kmers", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("seeds", "results")), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
