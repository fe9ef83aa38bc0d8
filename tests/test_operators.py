import gzip

import pytest
from pyspark.sql import functions as F

from crawlspark import catalog, decorated, schedule
from crawlspark.operators import issues, links, results, robots, stats
from crawlspark.plans.config import CrawlConfig
from crawlspark.sources import seeds, snapshot
from crawlspark.streaming.live_stats import live_summary

PAGES = [
    # href, status, content type, robots, crawlable, html
    ("https://a.x/", 200, "text/html", "", None, '<title>T</title><h1>h</h1><a href="/b">1</a><a href="/b#f" rel="nofollow">2</a><a href="#x">3</a><a href="javascript:x">4</a><a href="/${id}">5</a><a href="/{{x}}">6</a><a href="mailto:a@b">7</a>'),
    ("https://a.x/b", 404, "text/html", "", True, '<title>T</title><a href="https://a.x/b">self</a>'),
    ("https://a.x/c", 200, "text/html", "noindex", False, '<title>t</title><a href="/b">b</a><area href="https://o.y/d">'),
    ("https://o.y/d", 200, "application/pdf", "", True, ""),
    ("https://o.y/e", None, None, "", True, None),
]


@pytest.fixture(scope="module")
def crawled(spark):
    rows = [(k, h, h.split("/")[2], s, False, c, cr, x) for k, (h, s, c, _, cr, x) in enumerate(PAGES)]
    base = spark.createDataFrame(rows, "page_id long, href string, host string, status int, redirected boolean, content_type string, crawlable boolean, html string")
    records = snapshot.records(decorated.responses(base))
    robots_of = F.create_map(*[F.lit(v) for h, _, _, r, _, _ in PAGES for v in (h, r)])
    records = records.withColumn("robots", robots_of[F.col("href")])
    return records, links.edges(records)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_edges(crawled):
    assert rows(crawled[1], "source", "target", "follow") == [
        ("https://a.x/", "https://a.x/b", "follow"), ("https://a.x/c", "https://a.x/b", "follow"), ("https://a.x/c", "https://o.y/d", "follow"),
    ]
    assert rows(links.edges(crawled[0], scope="page_host"), "target") == [("https://a.x/b",)] * 2
    assert rows(links.edges(crawled[0], scope="start_host", start_host="o.y"), "target") == [("https://o.y/d",)]
    assert {r.source: len(r.links) for r in links.nested(crawled[1]).collect()} == {"https://a.x/": 1, "https://a.x/c": 2}


def test_results(crawled):
    table = results.results_table(*crawled)
    assert rows(table, "href", "outbound_count", "inbound_count", "broken_outbound", "indexable") == [
        ("https://a.x/", 1, None, 1, True), ("https://a.x/b", None, 2, None, False), ("https://a.x/c", 2, None, 1, False), ("https://o.y/d", None, 1, None, False), ("https://o.y/e", None, None, None, False),
    ]
    assert rows(results.search(table, "T"), "href")[:2] == [("https://a.x/",), ("https://a.x/b",)]
    assert results.drill_down(table, "crawlable", "!=", True).count() == 2 and results.column_filter(table, {"title": "t", "indexable": True}).count() == 1
    assert [r.href for r in results.page_of(table, [F.desc_nulls_last("fetch_status")], page=2, size=2).collect()] == ["https://a.x/c", "https://o.y/d"]
    assert rows(results.detail_inbound(crawled[1], "https://a.x/b"), "source") == [("https://a.x/",), ("https://a.x/c",)]
    assert rows(results.detail_outbound(crawled[1], crawled[0], "https://a.x/c"), "target", "target_status") == [("https://a.x/b", 404), ("https://o.y/d", 200)]
    assert ("fetch", "status", "404") in rows(results.detail_sections(crawled[0].drop("html", "anchors"), "https://a.x/b"), "section", "key", "value")


def test_flatten(spark):
    df = spark.createDataFrame([("k", [1, 2], {"x": 1}, [[1]]), ("l", [], {}, None), ("m", None, None, None)], "k string, a array<int>, m map<string,int>, d array<array<int>>")
    flat = results.flatten(df.withColumn("s", F.struct("k", "a")))
    assert flat.columns == ["k", "a_0", "a_1", "m", "s_k"] and rows(flat, "k", "a_0", "a_1") == [("k", 1, 2), ("l", None, None), ("m", None, None)]
    assert results.flatten(df.limit(0).select("k", "a")).columns == ["k"]


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}/settings.json"
    assert CrawlConfig.load(spark, path) == CrawlConfig()
    CrawlConfig(max_pages=7, order="queue").save(spark, path)
    assert CrawlConfig.load(spark, path) == CrawlConfig(max_pages=7, order="queue")
    (tmp_path / "settings.json").write_text('{"max_pages": 9, "colour": "red"}')
    assert CrawlConfig.load(spark, path) == CrawlConfig(max_pages=9)


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "href string, fetch_timestamp int, v string")
    assert rows(results.latest(df), "href", "v") == [("a", "z"), ("b", "q")]


def test_issues(crawled):
    found = rows(issues.issues(*crawled), "issue", "href", "detail")
    assert ("Broken pages (4xx / 5xx)", "https://a.x/b", "404 Not Found") in found
    assert [f for f in found if f[0] == "Duplicate titles"] == [("Duplicate titles", "https://a.x/", "T"), ("Duplicate titles", "https://a.x/b", "T")]
    assert [f[1:] for f in found if f[0] == "Blocked by robots.txt"] == [("https://a.x/c", "noindex")]
    assert ("Pages with broken outbound links", "https://a.x/c", "→ https://a.x/b (404)") in found
    assert [f[1] for f in found if f[0] == "Missing H1"] == ["https://a.x/c"]
    assert {r.issue: r["items"] for r in issues.issue_counts(issues.issues(*crawled)).collect()}["Missing canonical"] == 2


def test_stats(crawled):
    one = stats.summary(crawled[0], "a.x").first().asDict()
    assert one == {"encountered": 5, "crawled": 5, "blocked": 1, "internal": 3, "external": 2, "indexable": 1, "nonIndexable": 4}
    assert live_summary(crawled[0], "a.x", files=3).first().asDict() == one
    assert rows(stats.status_histogram(crawled[0]), "status", "pages") == [("0", 1), ("200", 3), ("404", 1)]
    assert rows(stats.type_histogram(crawled[0]), "content_type", "pages") == [("application/pdf", 1), ("text/html", 3), ("unknown", 1)]


def allowed(spark, robots_text, bot, *paths):
    table = spark.createDataFrame([(f"https://h.x{p}",) for p in paths], "url string")
    out = robots.allowed(table, spark.createDataFrame([("https://h.x", robots_text)], "origin string, text string"), bot)
    return [dict(rows(out, "url", "allowed"))[f"https://h.x{p}"] for p in paths]


def test_robots(spark):
    assert allowed(spark, "User-agent: *\nDisallow: /a\nAllow: /a/b", "Bot", "/a/b/c", "/a/x", "/") == [True, False, True]
    assert allowed(spark, "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nDisallow:", "Googlebot", "/x") == [True]
    assert allowed(spark, "user-agent: a\nuser-agent: B\ndisallow: /*.pdf$ # c\nUser-agent: b\nDisallow: /q?", "b", "/x.pdf", "/x.pdf?y", "/q?1", "/q") == [False, True, False, True]
    assert allowed(spark, "User-agent: *\nDisallow: /p\nAllow: /p", "x", "/p") == [True]
    assert allowed(spark, "", "x", "/p") == [True] and allowed(spark, "Disallow: /", "x", "/p") == [True]
    fetched = spark.createDataFrame([("o1", "Disallow: /"), ("o2", "t")], "origin string, text string")
    over = robots.upsert_override(spark.createDataFrame([("o3", "z")], "origin string, text string"), "o1", "")
    assert rows(robots.effective(fetched, over), "origin", "text", "has_override") == [("o1", "", True), ("o2", "t", False), ("o3", "z", True)]
    assert rows(robots.listing(fetched, robots.upsert_override(over, "o1", None)), "origin", "badge") == [("o1", "fetched"), ("o2", "fetched"), ("o3", "override")]


def test_seeds(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" https://a/1 \r\n\nftp://x\nhttp://b\n")
    assert rows(seeds.read_url_list(spark, str(tmp_path / "urls.txt")), "url") == [("http://b",), ("https://a/1",)]
    (tmp_path / "t.csv").write_text("URL,page,clicks\nu1,,1\n,u2,2\nu1,,3\n,,9\n")
    assert rows(seeds.read_csv(spark, str(tmp_path / "t.csv")), "url", "clicks") == [("u1", "3"), ("u2", "2")]
    table = spark.createDataFrame([("https://x/PROD/1",), ("https://x/prod/2",)], "url string")
    assert seeds.regex_filter(table, "/PROD/", "include").count() == 2 and seeds.resolve_seeds([table, table], "/PROD/", "include").count() == 1
    with pytest.raises(ValueError):
        seeds.regex_filter(table, "(", "include")
    assert seeds.regex_filter(table, "(", "include", on_invalid="ignore").count() == 2
    assert seeds.over_limit(table, 1).first().over_limit


def test_sitemaps(spark):
    index = b"<sitemapindex><sitemap><loc>m/1.xml.gz</loc></sitemap><sitemap><loc>m/gone.xml</loc></sitemap><sitemap><loc>m/i</loc></sitemap></sitemapindex>"
    files = [("m/i", index), ("m/1.xml.gz", gzip.compress(b"<urlset><url><loc> https://a/?x=1&amp;y </loc></url><url><LOC>https://b</LOC></url></urlset>"))]
    maps = seeds.sitemap_text(spark.createDataFrame(files, "url string, content binary"))
    assert rows(seeds.sitemap_urls(spark.createDataFrame([("m/i",)], "url string"), maps).distinct(), "url") == [("https://a/?x=1&y",), ("https://b",)]


def test_catalog(spark, tmp_path, crawled):
    saved = catalog.Catalog(spark, f"{tmp_path}/catalog")
    table = results.results_table(*crawled)
    saved.save("1", "one", table)
    saved.save("2", "two", table.limit(1))
    saved.rename("2", "zwei")
    assert rows(saved.list(), "id", "name") == [("1", "one"), ("2", "zwei")] and saved.load("1").count() == 5
    files = spark.createDataFrame([("2", "p", 100), ("3", "p", 2048), ("3", "q", 1)], "id string, path string, length long")
    view = catalog.manager_view(saved.list(), catalog.archive_stats(files)).collect()
    assert [(r.id, r.orphan, r.size) for r in view] == [("2", False, "100 B"), ("1", False, "0 B"), ("3", True, "2 KB")]
    saved.delete("1")
    assert saved.entry("1") is None
    assert rows(saved.list(), "id") == [("2",)]
    catalog.export_csv(table, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.count() == 5 and back.columns[:2] == ["url", "status"]
    presets = catalog.Presets(spark, f"file://{tmp_path}/p.json")
    presets.add(" a ", "x+", "include")
    presets.add("b", "y", "exclude")
    presets.delete("1")
    assert [p["name"] for p in presets.all()] == ["b"]
    for bad in (("", "x", "include"), ("n", "(", "include"), ("n", "x", "other")):
        with pytest.raises(Exception):
            presets.add(*bad)


def test_schedules(spark):
    table = spark.createDataFrame([("a", True, False, "2024-01-01"), ("b", False, False, "2024-01-01"), ("c", True, True, "2024-01-01")], "id string, enabled boolean, running boolean, next_run string")
    table = table.withColumns({c: F.lit(None).cast(t) for c, t in {"total": "long", "ok": "long", "errors": "long", "name": "string", "crawl_key": "string", "last_run": "timestamp"}.items()})
    assert rows(schedule.due(table, F.lit("2024-02-01")), "id") == [("a",)]
    assert rows(schedule.toggle(table, "b"), "enabled") == [(True,)] * 3
    assert schedule.upsert(schedule.remove(table, "a"), table.where("id = 'c'").withColumn("enabled", F.lit(False))).where("enabled").count() == 0
    summary = spark.createDataFrame([(5, 4, 1, "n")], "total long, ok long, errors long, name string")
    done = schedule.finish_run(table, "c", F.timestamp_millis(F.lit(1000)), summary).where("id = 'c'").first()
    assert (done.running, done.total, done.crawl_key) == (False, 5, "crawl-1000")
    queue = schedule.JobQueue()
    assert [queue.fire(x) for x in ("a", "b", "b", "c")] == [True, False, False, False] and [queue.finish() for _ in range(3)] == ["b", "c", None]
    assert rows(table.select(schedule.state(F.col("running"), F.col("enabled")).alias("s")), "s") == [("active",), ("paused",), ("running",)]
