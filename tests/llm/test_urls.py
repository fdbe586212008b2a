import re

from compare import connect, difference
from offerrank.llm import urls


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(d + p), a, d + p) for a, d, p in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    low = url.lower()
    count = [sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in terms) for terms in (urls.STRICT, urls.SOFT)]
    own = "block" if count[0] or count[1] >= 2 else "allow"
    best = max(fits, default=(0, own, None))
    return host, path, best[2], best[1], *count


URLS = [None, "", "no scheme", "http://", "http://NET", "http://net/", "http://x.Net/en/", "https://example.net/en/a?b#c", "https://a.example.net/en",
        "http://notexample.net/en/x", "http://example.com/de/x", "http://EXAMPLE.com/DE/x", "http://a.org/fr/", "http://a.org?/fr/", "a://b://c/d",
        "http://free-bets.io/", "http://freebets.io/free", "http://a.io/free/free", "http://xxx.io", "http://xxxy.io", "http://a.io/?q=casino#x",
        "http://casinoé.io", "http://spam-farm.io", "http://a.io/" + "free/" * 20000 + "win", "http://ÄRGER.de/ß", "line\nhttp://a.net/x\ny"]


def test_cases(spark):
    rows = [(k, u, "z", 1) for k, u in enumerate(URLS)] + [(None, "http://a.net/", "z", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = {r[0]: tuple(r)[1:] for r in urls.judge(pages).collect()}
    assert got == {i: brute(u) for i, u, *_ in rows}
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.limit(0)).count() == 0


def test_equals_sql(spark, sf):
    assert difference(urls.op4(spark, sf), urls.SQL, connect(sf)) is None


def test_longest_rule_and_own_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    got = urls.judge(pages, rules=(("allow", "c", "/x/y"), ("block", "a.b.c", "/"))).first()
    assert (got.rule, got.verdict) == ("a.b.c/", "block")


def test_of_equally_long_rules_the_last_decides(spark):
    pages = spark.createDataFrame([(1, "http://b.c.de/xx")], "page_id long, url string")
    rules = (("allow", "c.de", "/xx"), ("block", "b.c.de", "/"))
    assert [urls.judge(pages, rules=r).first().verdict for r in (rules, rules[::-1])] == ["block", "allow"]
