from strandworks.llm import queries as Q
from strandworks.llm import url_filter as U

from ..oracle import check

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme.com/en/", "http://EXAMPLE.com/en/x?y", "https://www.example.com/en/", "http://a.www.example.com/en/z", "http://notexample.com/en/", "http://example.com", "http://example.com?/en/", "x://y.net/es/a#b", "x://net/fr/",
    "x://y.net/FR/", "http://my.casino-win.org/a", "http://casinos.org/", "http://h.org/wp-login.php", "http://com", "http://com/", "http://éx.com:80/en/", "ftp://a://b.com/x", "http:///path", "http://x.com/en\n/",
]


def test_against_sql(spark):
    check(spark, SF, Q.QUERIES["op10_url_filter"], Q.ORACLE_SQL["op10_url_filter"])


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_edges(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])], "page_id long, url string").selectExpr("*", "1 as rule", "2 as host", "3 as token", "4 as row")
    got = U.judge(rows).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            host, path = plain(URLS[r.page_id])
            fits = [s for s in U.SCOPES if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
            best = max(fits, key=lambda s: len(s.host + s.path), default=None)
            assert (r.host, r.path) == (host, path)
            assert r.rule == (best and best.host + best.path)
            assert r.verdict == (best.verdict if best else "block" if r.page_id in (12, 14) else "allow")
    assert U.judge(rows.limit(0)).count() == 0


def test_index_uses_the_rarest_token(spark):
    urls = spark.createDataFrame([(["", "a", "b"],)] * 5 + [(["", "a"],)] * 5, "url_tokens array<string>")
    rules = U.rules_frame(spark, [U.ScopeRule("block", "a.b", "/")], [U.PatternRule("allow", "x", "", ())])
    assert {r.rule: r.token for r in U.rule_index(urls, rules).collect()} == {"a.b/": "b", "x ": ""}


def test_ties_go_to_the_smaller_string(spark):
    """Two scopes of equal length, and both ways of fetching."""
    rows = spark.createDataFrame([(1, "http://a.com/bcd"), (2, "http://x.com/bcd"), (3, None)], "page_id long, url string")
    scopes = (U.ScopeRule("allow", "com", "/bcd"), U.ScopeRule("block", "a.com", "/b"))
    for literals in (0, 9):
        got = {r.page_id: (r.rule, r.verdict) for r in U.judge(rows, scopes, (), "none", literals).collect()}
        assert got == {1: ("a.com/b", "block"), 2: ("com/bcd", "allow"), 3: (None, "none")}


def test_table_of_rules_gives_the_same(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 3)], "page_id long, url string")
    short, long = (sorted(map(str, U.judge(rows, literals=n).collect())) for n in (500, 0))
    assert short == long and len(short) == 3 * len(URLS)
    assert U.judge(rows, (), (), "allow").filter("verdict = 'allow' and rule is null").count() == len(short)


def test_plan_has_no_exchange_for_a_short_list(spark):
    plan = U.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
