import random

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import urls

BASE = "https://User:pw@Host.Example:8443/a/b/c.html?q=1#f"
PLAIN = "http://h.x/dir/page?x=1"
ROOT = "https://User:pw@host.example:8443"

#: (reference, page, absolute URL) by the URL standard.
PAIRS = [
    ("", PLAIN, "http://h.x/dir/page?x=1"), ("  \n", PLAIN, "http://h.x/dir/page?x=1"), ("#top", PLAIN, "http://h.x/dir/page?x=1#top"), ("?y", PLAIN, "http://h.x/dir/page?y"),
    ("p", PLAIN, "http://h.x/dir/p"), ("/p", PLAIN, "http://h.x/p"), ("//o.y/p", PLAIN, "http://o.y/p"), ("//o.y", PLAIN, "http://o.y/"), ("./p", PLAIN, "http://h.x/dir/p"),
    ("../p", PLAIN, "http://h.x/p"), ("../../../p", PLAIN, "http://h.x/p"), ("..", PLAIN, "http://h.x/"), (".", PLAIN, "http://h.x/dir/"), ("a/./b/../c", PLAIN, "http://h.x/dir/a/c"),
    ("a/b/..", PLAIN, "http://h.x/dir/a/"), ("a//b", PLAIN, "http://h.x/dir/a//b"), ("a//../b", PLAIN, "http://h.x/dir/a/b"), ("...", PLAIN, "http://h.x/dir/..."), (".p", PLAIN, "http://h.x/dir/.p"),
    ("%2e%2E/p", PLAIN, "http://h.x/p"), ("%2e/p", PLAIN, "http://h.x/dir/p"), (".%2e", PLAIN, "http://h.x/"), ("p?a/../b", PLAIN, "http://h.x/dir/p?a/../b"), ("p#a/../b", PLAIN, "http://h.x/dir/p#a/../b"),
    ("a b", PLAIN, "http://h.x/dir/a%20b"), ("für", PLAIN, "http://h.x/dir/f%C3%BCr"), ("日本/🚀", PLAIN, "http://h.x/dir/%E6%97%A5%E6%9C%AC/%F0%9F%9A%80"), ("a%20b%zz", PLAIN, "http://h.x/dir/a%20b%zz"),
    ('a"<b>`{c}', PLAIN, "http://h.x/dir/a%22%3Cb%3E%60%7Bc%7D"), ("a'b|c[d]", PLAIN, "http://h.x/dir/a'b|c[d]"), ("p?a b\"c<d>'e`{f}", PLAIN, "http://h.x/dir/p?a%20b%22c%3Cd%3E%27e`{f}"), ("p?ü=é", PLAIN, "http://h.x/dir/p?%C3%BC=%C3%A9"),
    ("p#a b`c\"", PLAIN, "http://h.x/dir/p#a%20b%60c%22"), ("a\tb\nc\r", PLAIN, "http://h.x/dir/abc"), ("a\x7fb\x01", PLAIN, "http://h.x/dir/a%7Fb"), ("a;b:c@d,e=f&g$h", PLAIN, "http://h.x/dir/a;b:c@d,e=f&g$h"),
    ("a\\b", PLAIN, "http://h.x/dir/a/b"), ("\\p", PLAIN, "http://h.x/p"), ("\\\\o.y\\p", PLAIN, "http://o.y/p"), ("p?a\\b", PLAIN, "http://h.x/dir/p?a\\b"), ("p#a\\b", PLAIN, "http://h.x/dir/p#a\\b"), ("/\\o.y/p", PLAIN, "http://o.y/p"),
    ("http:p", PLAIN, "http://h.x/dir/p"), ("http:/p", PLAIN, "http://h.x/p"), ("HTTP:?z", PLAIN, "http://h.x/dir/page?z"), ("http:", PLAIN, "http://h.x/dir/page?x=1"), ("https:p", PLAIN, "https://p/"), ("https:/o.y/p", PLAIN, "https://o.y/p"),
    ("http:///o.y//p", PLAIN, "http://o.y//p"), ("https:\\\\o.y\\p", PLAIN, "https://o.y/p"), ("////o.y", PLAIN, "http://o.y/"), ("HTTPS://O.Y/P", PLAIN, "https://o.y/P"), ("http://o.y:80/", PLAIN, "http://o.y/"),
    ("https://o.y:443/p", PLAIN, "https://o.y/p"), ("http://o.y:443/", PLAIN, "http://o.y:443/"), ("http://o.y:0080/", PLAIN, "http://o.y/"), ("http://o.y:/p", PLAIN, "http://o.y/p"), ("http://o.y:99999/", PLAIN, None), ("http://o.y:x/", PLAIN, None),
    ("http://", PLAIN, None), ("http://a b/", PLAIN, None), ("http://a%20b/", PLAIN, None), ("http://%6F.Y/p", PLAIN, "http://o.y/p"), ("http://müller.example/ü", PLAIN, "http://xn--mller-kva.example/%C3%BC"), ("http://BÜCHER.example", PLAIN, "http://xn--bcher-kva.example/"),
    ("http://u@o.y/", PLAIN, "http://u@o.y/"), ("http://u:p w@o.y/", PLAIN, "http://u:p%20w@o.y/"), ("http://@o.y/", PLAIN, "http://o.y/"), ("http://:@o.y/", PLAIN, "http://o.y/"), ("http://a@b@o.y/", PLAIN, "http://a%40b@o.y/"), ("http://[::1]:8080/p", PLAIN, "http://[::1]:8080/p"),
    ("p", BASE, ROOT + "/a/b/p"), ("/p", BASE, ROOT + "/p"), ("?z", BASE, ROOT + "/a/b/c.html?z"), ("#z", BASE, ROOT + "/a/b/c.html?q=1#z"), ("", BASE, ROOT + "/a/b/c.html?q=1"), ("//o.y", BASE, "https://o.y/"),
    ("p", "http://h.x", "http://h.x/p"), ("?q", "http://h.x", "http://h.x/?q"), ("mailto:a@b", PLAIN, "mailto:a@b"), ("javascript:x()", PLAIN, "javascript:x()"), ("ftp://o.y/a b", PLAIN, "ftp://o.y/a b"), ("1:2", PLAIN, "http://h.x/dir/1:2"),
]


@pytest.fixture(scope="module")
def resolved(spark):
    table = spark.createDataFrame([(i, h, b) for i, (h, b, _) in enumerate(PAIRS)], "i int, h string, b string").repartition(3)
    return {r.i: r.u for r in table.select("i", urls.resolve(F.col("h"), F.col("b")).alias("u")).collect()}


@pytest.mark.parametrize("i", range(len(PAIRS)))
def test_pair(resolved, i):
    assert resolved[i] == PAIRS[i][2], PAIRS[i]


PIECES = ["http:", "https:", "HTTPS:", "//", "/", "\\", "h.x", "H.x", "1.2", "a", "é", "日", "%20", "%2e", ".", "..", "?", "#", "@", ":80", "[", "|", "`", "^", " ", "\n", "\x7f", "q=1&r"]
PAGES = [PLAIN, BASE, "https://h.x", "http://1.2/p", "http://h.x:8080/d/", "http://É.x/", "no url", None]


def test_known_forms_resolve_as_any_reference(spark):
    rng = random.Random(19)
    refs = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7))) for _ in range(2000)]
    refs += [rng.choice(["http://h.x/", "https://h.x/a", "/", "/a"]) + "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 5))) for _ in range(3000)]
    table = spark.createDataFrame([(x, rng.choice(PAGES)) for x in refs] + [(None, PLAIN)], "h string, b string").withColumn("p", urls.base_parts(F.col("b")))
    both = table.select("h", "b", urls.resolve_on(F.col("h"), F.col("p")).alias("u"), urls._resolved(F.col("h"), F.col("p")).alias("v")).collect()
    assert [r for r in both if r.u != r.v] == [] and len({r.u for r in both}) > 2000


def test_known_forms_are_not_taken_apart(spark, monkeypatch):
    """URLs that are written out, and paths from the root of a page whose own root is."""
    monkeypatch.setattr(urls, "_resolved", lambda href, parts: F.lit("taken apart"))
    pairs = [("https://o.y/p?q=1#top", "https://o.y/p?q=1#top"), ("http://o.y/", "http://o.y/"), ("/p", "http://h.x/p"), ("/ü", "http://h.x/%C3%BC"), ("/", "http://h.x/"), *[(x, "taken apart") for x in ("//o.y", "/..", "p", "/p?q", "http://O.y/", "http://o.y/a/%2E/")]]
    table = spark.createDataFrame(pairs, "h string, u string")
    assert [(r.h, r.v) for r in table.select("h", urls.resolve(F.col("h"), F.lit(PLAIN)).alias("v")).collect()] == pairs


def test_has_http_host(spark):
    rng = random.Random(9)
    table = spark.createDataFrame([(rng.choice(["", "http://", "HTTPs://u@"]) + "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))),) for _ in range(3000)] + [(None,), ("http://h.x#a#b",)], "u string")
    old = urls.is_http(F.col("u")) & urls.host(F.col("u")).isNotNull()
    rows = table.select("u", urls.has_http_host(F.col("u")).alias("a"), old.alias("b"), urls.strip_fragment(F.col("u")).alias("c"), F.regexp_replace("u", r"(?s)#.*$", "").alias("d")).collect()
    assert [r for r in rows if (r.a or False) != (r.b or False) or r.c != r.d] == [] and sum(bool(r.a) for r in rows) > 20
