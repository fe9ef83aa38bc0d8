"""URLs that a snapshot has several times, and what the queries' SQL says on odd pages."""

from pairs import differences
from pyspark.sql import functions as F

from crawlspark import catalog
from crawlspark.functions import html, python_html
from crawlspark.functions.article import article_of
from crawlspark.management_queries import ORACLES, QUERIES
from crawlspark.operators import links, robots
from crawlspark.plans.crawl import next_pages
from crawlspark.storage import Buckets


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_url_twice(spark):
    """A snapshot that has a URL twice: one edge per URL and target, by the first place of the link."""
    page = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    seen = [(0, "https://a.x/", page("#f", "/b", "/c"), ""), (1, "https://a.x/", page("/c"), "nofollow")]
    table = spark.createDataFrame(seen, "page_id long, href string, html string, robots string")
    given = table.select("href", "robots", html.anchors(F.col("html")).alias("anchors"), F.lit(True).alias("fetch_ok"), F.lit("text/html").alias("fetch_contentType"))
    assert rows(links.edges(given), "target", "follow", "pos") == [("https://a.x/b", "follow", 1), ("https://a.x/c", "nofollow", 0)]


def test_csv_quotes(spark, tmp_path):
    title = 'a "b", c\\'
    catalog.export_csv(spark.createDataFrame([("https://a.x/", title)], "href string, title string"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first()["title"] == title


def test_half_entity(spark):
    page = "<title>a &amp; b &amp</title><meta name='description' content='&lt; &lt'>"
    row = spark.createDataFrame([(page,)], "h string").select(python_html.dom_extract("h").alias("s")).first()["s"]
    assert (row["title"], row["description"]) == ("a & b &amp", "< &lt")


def test_queries_with_a_url_twice(spark, tmp_path):
    """Every page of the list has its row, and every page of a URL the row that its own answers give."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("url", F.when(F.col("page_id") == 40, F.lit("https://tw.ice/en/")).when(F.col("page_id") == 44, F.lit("https://tw.ice/en/")).otherwise(F.col("url")))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("crawl_list", "crawl_outbound", "crawl_retried", "csv_join"):
        more, fewer, (n, wanted) = differences(spark, tmp_path, QUERIES[name], ORACLES[name])
        assert (name, more, fewer) == (name, [], []) and n == wanted > 0


def _repeated(spark, tmp_path):
    """The small pages, of which two have one URL."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.withColumn("url", F.when(F.col("page_id").isin(41, 44), F.lit("https://tw.ice/en/")).otherwise(F.col("url"))).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    return tmp_path


def _same(spark, folder, name):
    more, fewer, (n, wanted) = differences(spark, folder, QUERIES[name], ORACLES[name])
    assert (name, more, fewer) == (name, [], []) and n == wanted > 0


def test_attempts_of_each_page(spark, tmp_path):
    _same(spark, _repeated(spark, tmp_path), "retry_gate")


def test_last_record_of_each_page(spark, tmp_path):
    _same(spark, _repeated(spark, tmp_path), "latest_records")


def test_records_of_links_once(spark, tmp_path):
    _same(spark, _repeated(spark, tmp_path), "error_records")


def test_header_of_each_answer(spark):
    edge = spark.createDataFrame([("a", "b", "follow", ""), ("a", "c", "nofollow", "meta")], "source string, target string, follow string, directive_source string")
    sent = spark.createDataFrame([("a", "noarchive, UGC"), ("a", None), ("z", "ugc")], "source string, header string")
    want = [("b", "follow", ""), ("b", "ugc", "header"), ("c", "nofollow", "meta"), ("c", "nofollow", "meta")]
    assert rows(links.with_header(edge, sent), "target", "follow", "directive_source") == want


def test_edges_of_each_answer(spark, tmp_path):
    _same(spark, _repeated(spark, tmp_path), "header_directive")


def test_advertising_is_no_article():
    html = "<html><body><div class='top ad'>Buy one two three four five six seven eight nine.</div><div id='x'><h1>Short.</h1><p>Short.</p></div></body></html>"
    assert article_of(html)[0] == "Short. Short."
    assert article_of("<p>&lt; &lt</p>")[0] == "< &lt"


def test_crawl_broadcasts_no_rules_and_no_visited_pages(spark, tmp_path):
    """Both grow with the input, and would go to the driver in every round."""
    rules = robots.rules_by_origin(spark.createDataFrame([("https://a.x", "User-agent: *\nDisallow: /b")], "origin string, text string"), "bot")
    seen = robots.allowed_by(spark.createDataFrame([("https://a.x/b",), ("https://a.x/c",)], "url string"), rules)
    assert rows(seen, "url", "allowed") == [("https://a.x/b", False), ("https://a.x/c", True)]
    visited = Buckets(spark, f"file://{tmp_path}/visited", "url string, round int", "url", 4, parts="round")
    try:
        graph = spark.createDataFrame([("https://a.x/", "https://a.x/b")], "source string, url string")
        sources = spark.createDataFrame([("https://a.x/", 0, 0)], "url string, depth int, rank long")
        new = next_pages(graph, sources, visited)
        for plan in (new, seen):
            assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        visited.close()
