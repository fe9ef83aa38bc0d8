import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crawlspark import schedule
from crawlspark.functions.json_ld import json_ld
from crawlspark.functions import fetch, follow, html, python_html, text, urls
from crawlspark.sources import seeds


@pytest.fixture(scope="module")
def value(spark):
    """Evaluates a Column over one row of literals."""

    def run(build, *args):
        row = spark.createDataFrame([tuple(range(len(args)))] if not args else [args], [f"a{k}" for k in range(len(args))]) if all(a is not None for a in args) and args else None
        if row is None:
            row = spark.range(1)
            return row.select(build(*[F.lit(a) for a in args]).alias("v")).first()["v"]
        return row.select(build(*[F.col(f"a{k}") for k in range(len(args))]).alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    ("build", "args", "want"),
    [
        (text.format_bytes, (1023,), "1023 B"), (text.format_bytes, (1024,), "1 KB"), (text.format_bytes, (1572864,), "1.5 MB"),
        (text.percent, (1, 8), 13), (text.percent, (5, 0), 0),
        (text.html_escape, ('<a href="x">&',), "&lt;a href=&quot;x&quot;&gt;&amp;"),
        (text.bot_name, ("Mozilla/5.0 (compatible; bingbot/2.0; x)",), "bingbot"), (text.bot_name, ("DuckDuckBot/1.1; x",), "DuckDuckBot"), (text.bot_name, ("",), "*"),
        (lambda c: text.bot_name(c, compat=True), ("Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; GPTBot/1.1)",), "Mozilla"),
        (text.bot_name, ("Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; GPTBot/1.1)",), "GPTBot"),
        (text.count_lines, ("a\n\n \nb",), 2),
        (lambda c: text.export_filename(c, "csv"), ("a/b: c|d",), "a-b-_c-d.csv"),
        (text.completion_text, (5, 4), "5 URLs — 4 OK, 1 errors"), (text.completion_text, (5, 5), "5 URLs — 5 OK"),
        (urls.to_filename, ("https://a.b/c d?x=1",), "a.b_c_d_x_1.html"), (urls.to_filename, ("no url",), "bm8gdXJs.html"),
        (urls.origin, ("HTTPS://User@A.b:443/x",), "https://a.b"), (urls.origin, ("http://a.b:81?x",), "http://a.b:81"), (urls.origin, ("nope",), None),
        (urls.host, ("https://A.b:80/x",), "a.b"), (urls.normalised_origin, (" https://a.b/ ",), "https://a.b"),
        (html.title, ("<title>  A &amp; B \n</title>",), "A & B"), (html.title, ("<p>x</p>",), ""),
        (html.h1, ("<!-- <h1>no</h1> --><h1 class=x>a <b>b</b></h1>",), "a b"),
        (lambda c: html.meta(c, "description"), ("<meta content=' a ' name='description'>",), " a "),
        (lambda c: html.meta(c, "description"), ("<meta name=description content=x>",), "x"),
        (lambda c: html.meta(c, "og:title", "property"), ('<meta property="og:title" content="T">',), "T"),
        (html.canonical, ('<link href="/x" rel="canonical">',), "/x"),
        (lambda c: F.array_join(html.paragraphs(c), "|"), ("<p>a\t b</p><p> </p><p class=x>c</p>",), "a b|c"),
        (html.article_text, ("<body><nav>n</nav><article><h1>t</h1> x </article>f</body>",), "t x"),
        (fetch.type_bucket, ("text/html; charset=utf-8",), "text/html"), (fetch.type_bucket, ("",), "unknown"),
        (fetch.status_key, (None,), "0"), (fetch.status_key, (404,), "404"), (fetch.histogram_class, ("301",), "redirect"),
        (fetch.indexable, (True, "Text/HTML; charset=x", "NOINDEX"), False), (fetch.indexable, (True, "Text/HTML", ""), True),
        (schedule.interval_label, (60,), "Hourly"), (schedule.interval_label, (240,), "Every 4h"), (schedule.interval_label, (1440,), "Daily"),
        (schedule.interval_label, (10080,), "Weekly"), (schedule.interval_label, (2880,), "Every 2d"),
        (schedule.interval_text, (10080, "03:00", 3), "Weekly on Wednesday at 03:00"),
        (lambda *c: schedule.property_label(*c), ("", "", "", "\n b\nc", "t"), "b"), (lambda *c: schedule.property_label(*c), ("", "", "", "", ""), "–"),
        (seeds.first_url, ("", "x\n https://a/ \nhttps://b", "s"), "https://a/"),
    ],
)
def test_golden(value, build, args, want):
    assert value(build, *args) == want


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/p", "https://h.x/p"), ("q", "https://h.x/a/q"), ("../q", "https://h.x/q"), ("./", "https://h.x/a/"), ("../../..", "https://h.x/"), ("?z", "https://h.x/a/b?z"), ("//O.y", "https://o.y/"),
        ("HTTP://O.y:80/A?B", "http://o.y/A?B"), (" /s\n", "https://h.x/s"), ("", "https://h.x/a/b?c"), ("#f", "https://h.x/a/b?c#f"), ("a/./b/../c", "https://h.x/a/a/c"), ("mailto:x@y", "mailto:x@y"),
    ],
)
def test_resolve(value, href, want):
    assert value(lambda h: urls.resolve(h, F.lit("https://H.x/a/b?c#d")), href) == want


def test_resolve_like_the_standard_library(spark):
    rows = [(h, b) for b in ("http://a.b/c/d", "http://a.b/c/d/?q=1", "http://a.b/") for h in ("x", "../x", "./x/./y", "../../x/y/..", "/a/../b/", "?x=/../y", "z/..")]
    df = spark.createDataFrame(rows, "h string, b string")
    for r in df.select("h", "b", urls.resolve(F.col("h"), F.col("b")).alias("own"), python_html.url_join("h", "b").alias("lib")).collect():
        assert r.own == r.lib, r


@pytest.mark.parametrize(
    ("rel", "meta", "header", "want"),
    [("noopener UGC", "nofollow", None, ("ugc", "anchor")), ("", "noindex, nofollow", "ugc", ("nofollow", "meta")), (None, "", "ugc", ("ugc", "header")), (None, "none", "", ("follow", ""))],
)
def test_follow(spark, rel, meta, header, want):
    text_of = lambda v: F.lit(v).cast("string")
    assert tuple(spark.range(1).select(follow.resolved(text_of(rel), follow.of_page(text_of(meta), text_of(header))).alias("v")).first()["v"]) == want


def ld(*scripts):
    return "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)


def test_json_ld(spark):
    pages = [
        ld('{"headline":"H1"}', '{"headline":"H2","alternateHeadline":""}'), ld('{"author":[{"name":"A"},{}]}'), ld('{"publisher":{"@type":"Person","name":"P"}}'),
        ld('{"@graph":[{"@type":"Person","name":"P"}]}'), ld("no json", '{"author":{"name":"Z"},"publisher":{"@type":"Organization","name":"O"}}'), "<p>none</p>", ld('{"@graph":[{"headline":"G"}]}'),
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", json_ld(html.json_ld_scripts(F.col("html"))).alias("n"), python_html.schema_fields(html.json_ld_scripts(F.col("html"))).alias("p"))
    got = {r.i: (r.n.asDict(), r.p.asDict()) for r in df.collect()}
    want = {0: {"headline": "H2"}, 1: {"authors": "A, "}, 2: {}, 3: {"authors": "P"}, 4: {"authors": "Z", "publisher": "O"}, 5: {}, 6: {"headline": "G"}}
    blank = dict.fromkeys(("publisher", "dateModified", "datePublished", "authors", "headline", "alternateHeadline"), "")
    for i, fields in want.items():
        assert got[i] == (blank | fields, blank | fields), i


def test_json_ld_reset_and_depth():
    blank = python_html.schema_of([])
    assert python_html.schema_of(['{"headline":"H"}', "null"]) == blank
    assert python_html.schema_of(['{"author":{"name":"A"}}', "null"])["authors"] == "A"
    assert python_html.schema_of(['{"x":[{"y":{"headline":"deep"}}]}'])["headline"] == "deep"
    assert list(python_html.deep_values({"a": {"k": {"k": 1}}, "k": 2}, "k")) == [{"k": 1}, 2]


@pytest.mark.parametrize(
    ("now", "time", "minutes", "day", "want"),
    [
        ((2024, 1, 3, 4, 0), "03:00", 1440, None, (2024, 1, 4, 3, 0)), ((2024, 1, 3, 4, 30), "03:00", 120, None, (2024, 1, 3, 5, 0)), ((2024, 1, 3, 2, 0), "03:00", 60, None, (2024, 1, 3, 3, 0)),
        ((2024, 1, 3, 4, 0), "03:00", 10080, 3, (2024, 1, 10, 3, 0)), ((2024, 1, 3, 4, 0), "03:00", 10080, 5, (2024, 1, 5, 3, 0)), ((2024, 1, 3, 4, 0), "03:00", 60, None, (2024, 1, 3, 5, 0)),
    ],
)
def test_next_fire(spark, now, time, minutes, day, want):
    df = spark.createDataFrame([(dt.datetime(*now), minutes, time, day)], "now timestamp_ntz, minutes int, time string, day int")
    c = F.col
    assert df.select(schedule.next_fire(c("now"), c("minutes"), c("time"), c("day")).alias("v")).first()["v"] == dt.datetime(*want)


def test_dom_and_gzip(spark):
    import gzip

    page = "<title> A &amp; B</title><meta name=description content=' d '><h1>x<i>y</i></h1><a href=/1>1</a><area href=2>"
    row = spark.createDataFrame([(page, gzip.compress(b"text"), b"damaged")], "h string, z binary, d binary").select(python_html.dom_extract("h").alias("s"), python_html.gunzip_text("z").alias("z"), python_html.gunzip_text("d").alias("d")).first()
    assert row.s.asDict() == {"title": "A & B", "description": " d ", "h1": "xy", "canonical": "", "robots": "", "n_links": 2} and (row.z, row.d) == ("text", None)


def test_patterns_of_mark_up_begin_with_one_bracket(spark):
    """What is cut out and what counts as a tag is the same as with the bracket in each alternative, on odd mark-up too."""
    rng = random.Random(18)
    words = ["<", ">", "<!--", "-->", "<script", "</script>", "<STYLE>", "</style>", "<style", "<scripts>", "<meta", "<META ", " name=", "robots", '"', "'", "/", " ", "\n", "x", "é", "content=a", "</", "--"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<meta name=robots>a>", "<meta name=robots><meta name='robots' x>", "<meta\nname = \"robots\"/>", "<!-- <script> --></script>", "<script><!-- </script> -->", None]
    t = spark.createDataFrame([(x,) for x in texts], "h string")
    seen = F.regexp_replace("h", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    tag = F.regexp_extract("h", r"""(?is)<meta\b[^>]*\sname\s*=\s*["']?robots["'\s/>][^>]*>|<meta\b[^>]*\sname\s*=\s*["']?robots>""", 0)
    both = t.select("h", html.visible(F.col("h")).alias("a"), seen.alias("b"), html._tag(F.col("h"), "meta", "name", "robots").alias("c"), tag.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in both)
    assert sum(r.a != r.h for r in both) > 50 and sum(bool(r.c) for r in both) > 3


def test_an_attribute_is_searched_once(spark):
    """With the values that a search for each kind of quotes gives, on odd tags too."""
    rng = random.Random(19)
    words = ["<a", " href", "href", "=", " = ", '"', "'", " ", "\n", "/x", "é", '""', "''", "rel", ">", "HREF=", " href='a\"'", ' href="b\'"']
    tags = ["<a " + "".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None]
    pattern = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    each = F.when(F.col("t").rlike(pattern), F.concat(*[F.regexp_extract("t", pattern, k) for k in (1, 2, 3)]))
    t = spark.createDataFrame([(x,) for x in tags], "t string").select("t", html._attribute(F.col("t"), "href").alias("a"), each.alias("b"))
    both = t.collect()
    assert all(r.a == r.b for r in both) and len({r.a for r in both}) > 50 and "" in {r.a for r in both}
    plan = spark.range(1).select(html._attribute(F.lit("<a href=x>"), "href"))._jdf.queryExecution().logical().toString()
    assert plan.lower().count("regexp_extract") == 1 and "rlike" not in plan.lower()
