from crawlspark.llm.queries import URL_RULES
from crawlspark.llm.url_filter import Rule, parse_rule, url_verdicts

URLS = [
    None, "", "example.net/en/", "http://example.net", "http://example.net/", "https://a.b.EXAMPLE.net/en/x", "http://example.net/en", "http://badexample.net/en/x", "http://notnet/x",
    "http://example.com/de/", "http://x.example.com/de/1?q=http://a.org/fr/", "http://example.com/DE/1", "http://a.org/fr/#x", "http://a.org/fr", "http://org/fr/", "ftp://net/",
    "http://u@example.net:80/en/", "http://example.net?/en/", "http://example.net#/", "x://y://net/", "http://exa\nmple.net/", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        tail = url.split("://", 1)[1]
        n = min([tail.index(c) for c in "/?#" if c in tail] or [len(tail)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in tail[:n]), tail[n:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.host + r.path), r.host + r.path, r.verdict), default=None)
    return (host, path, best and best.host + best.path, best.verdict if best else "allow")


def check(spark, rules):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(0, None, "c", "c"), (None, "http://net/", "c", "c")]
    out = url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), rules)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u, _, _ in rows), key=str)


def test_rules(spark):
    check(spark, URL_RULES)


def test_more_rules(spark):
    check(spark, [parse_rule("block", "example.net/e"), Rule("allow", "example.net", ""), parse_rule("block", "a.org/fr/"), parse_rule("allow", "org/fr/#"), Rule("block", "y://net", "/")])


def test_no_rules_and_empty_table(spark):
    check(spark, [])
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []


def test_main_path_is_native(spark):
    plan = url_verdicts(spark.createDataFrame([(1, "http://net/")], "page_id long, url string"), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
