"""URL filter: rules indexed by their rarest literal token.

A rule is a regular expression on the host and one on the path, with literal
tokens that every matching URL holds. ``rule_index`` counts these tokens over
the URLs and files each rule under its rarest one. A URL's own tokens fetch
its candidate rules, and only the candidates run their expressions. Only
DataFrame functions are used. The rules come as a list of the driver, so up to
LITERALS of them stand in the plan as one literal map from token to rules, and
a URL is judged where it is read, without a shuffle. A longer list becomes a
table: the tokens that it holds join by token (broadcast only below
``spark.sql.autoBroadcastJoinThreshold``), and only hits are joined to the URLs.

Defined results: a null url or one without ``://`` has empty host and path and
gets the default verdict; repeated rows give repeated results; the longest
fitting rule wins, ties go to the smaller rule string; an empty table gives an
empty result; further columns of the input are ignored by ``judge``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("host_re", T.StringType()),
        T.StructField("path_re", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("named", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class ScopeRule:
    """Fits the host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """The method's own kind: expressions, and literal tokens that a match always holds."""

    verdict: str
    host_re: str
    path_re: str
    tokens: tuple[str, ...]


#: Production rules of the query.
SCOPES = (
    ScopeRule("allow", "com", "/"),
    ScopeRule("block", "example.com", "/en/"),
    ScopeRule("allow", "www.example.com", "/en/"),
    ScopeRule("block", "net", "/es/"),
    ScopeRule("block", "net", "/fr/"),
)
#: What the method says where no scope fits: these, else allow.
PATTERNS = (
    PatternRule("block", r"(^|[.-])casino([.-]|\z)", "", ("casino",)),
    PatternRule("block", r"(^|[.-])poker([.-]|\z)", "", ("poker",)),
    PatternRule("block", r"(^|[.-])porn([.-]|\z)", "", ("porn",)),
    PatternRule("block", r"(^|[.-])viagra([.-]|\z)", "", ("viagra",)),
    PatternRule("block", "", r"/wp-login\.php\z", ("wp", "login", "php")),
)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(_lower(rest), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, and '' (the token of rules without one)."""
    return F.array_union(F.array(F.lit("")), F.split(_lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"))


def _runs(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER))) if x]


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


#: Rules up to which the index is a literal of the plan.
LITERALS = 500


def rule_rows(scopes=SCOPES, patterns=PATTERNS) -> list[tuple]:
    """The rules in the columns of RULE_SCHEMA."""
    rows = []
    for r in scopes:
        # the last piece of the path may be a mere prefix of the url's piece
        whole = r.path[: max(map(len, re.findall(r"\A.*[^A-Za-z0-9\x80-\U0010ffff]", r.path, re.S)), default=0)]
        host_re = (r"(\A|\.)" + _quote(r.host) + r"\z") if r.host else r"\A"
        rows.append((r.host + r.path, r.verdict, host_re, r"\A" + _quote(r.path), _runs(r.host) + _runs(whole) or [""], True))
    for p in patterns:
        rows.append((f"{p.host_re} {p.path_re}", p.verdict, p.host_re, p.path_re, list(p.tokens) or [""], False))
    return rows


def rules_frame(spark: SparkSession, scopes=SCOPES, patterns=PATTERNS) -> DataFrame:
    return spark.createDataFrame(rule_rows(scopes, patterns), RULE_SCHEMA)


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under the token that the fewest urls hold."""
    pairs = rules.withColumn("token", F.explode(F.array_distinct("tokens")))
    held = urls.select(F.explode("url_tokens").alias("token")).join(pairs.select("token").distinct(), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("n_urls"))
    ranked = pairs.join(counts, "token", "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
    return ranked.groupBy("rule", "verdict", "host_re", "path_re", "named").agg(F.min(F.struct("n_urls", "token")).alias("least")).select(F.col("least.token").alias("token"), "rule", "verdict", "host_re", "path_re", "named")


def literal_index(urls: DataFrame, rows: list[tuple]) -> dict[str, list[tuple]]:
    """``rule_index`` of a short list: token -> rules. What comes to the driver is one count for each token of the rules."""
    tokens = sorted({t for r in rows for t in r[4]})
    held = urls.select(F.explode(F.array_intersect("url_tokens", F.array(*map(F.lit, tokens)))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[tuple]] = {}
    for r in rows:
        index.setdefault(min(set(r[4]), key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return index


def _hit(named: Column, rule: Column, verdict: Column) -> Column:
    """The least of these wins: scopes first, then the longest, then the smaller string."""
    return F.struct((~named).alias("unnamed"), (-F.length(rule)).alias("n"), rule.alias("rule"), verdict.alias("verdict"))


def hits_by_literals(urls: DataFrame, rows: list[tuple]) -> DataFrame:
    """``urls`` with ``hit``: the rule that wins, or null."""
    index = literal_index(urls, rows) if rows else {}
    if not index:
        return urls.withColumn("hit", F.lit(None).cast("struct<unnamed:boolean,n:int,rule:string,verdict:string>"))
    rule = lambda r: F.struct(*(F.lit(v).alias(n) for n, v in zip(("rule", "verdict", "host_re", "path_re", "named"), (*r[:4], r[5]))))
    pairs = F.create_map(*(x for t, own in index.items() for x in (F.lit(t), F.array(*map(rule, own)))))
    fetched = F.array_intersect("url_tokens", F.array(*map(F.lit, index)))
    tried = F.flatten(F.transform(fetched, lambda t: F.element_at(pairs, t)))
    fits = F.filter(tried, lambda r: F.rlike(F.col("host"), r.host_re) & F.rlike(F.col("path"), r.path_re))
    return urls.withColumn("hit", F.array_min(F.transform(fits, lambda r: _hit(r.named, r.rule, r.verdict))))


def hits_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules: only tokens that the index holds leave their URL."""
    index = rule_index(urls, rules)
    found = urls.select("host", "path", F.explode("url_tokens").alias("token")).join(index, "token")
    found = found.filter(F.rlike("host", F.col("host_re")) & F.rlike("path", F.col("path_re")))
    best = found.groupBy("host", "path").agg(F.min(_hit(F.col("named"), F.col("rule"), F.col("verdict"))).alias("hit"))
    return urls.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, scopes=SCOPES, patterns=PATTERNS, default: str = "allow", literals: int = LITERALS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("url_tokens", url_tokens(F.concat_ws("/", "host", "path")))
    rows = rule_rows(scopes, patterns)
    judged = hits_by_literals(urls, rows) if len(rows) <= literals else hits_by_join(urls, rules_frame(pages.sparkSession, scopes, patterns))
    return judged.select(
        "page_id", "host", "path",
        F.when(~F.col("hit.unnamed"), F.col("hit.rule")).alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.lit(default)).alias("verdict"),
    )
