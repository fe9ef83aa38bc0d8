"""Sources of seed URLs: lists, CSV files, sitemaps and a page's own links."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.python_html import gunzip_text
from ..functions.text import html_unescape, not_empty, trim_ws


def url_list(lines: DataFrame, base: str | None = None, column: str = "value") -> DataFrame:
    """(url) of a table of lines: trimmed, resolved if ``base`` is given, http and https only."""
    line = trim_ws(F.col(column))
    resolved = urls.resolve(line, F.lit(base)) if base else line
    return lines.select(resolved.alias("url")).where(urls.is_http(F.col("url")))


def prefixed_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(url) of a schedule's list: trimmed lines that begin with http, as they are."""
    return lines.select(trim_ws(F.col(column)).alias("url")).where(F.col("url").startswith("http"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_list(spark.read.text(path))


def csv_rows(table: DataFrame, order: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A CSV table of strings with ``url`` (the first of URL, page and Page that isn't empty); the last row of a URL counts.

    Rows that differ in the columns ``by`` are of different pages, also where these have the same URL.
    """
    named = [not_empty(F.col(c)) for c in ("URL", "page", "Page") if c in table.columns]
    rows = table.withColumn("url", F.coalesce(*named) if named else F.lit(None).cast("string"))
    rows = rows.withColumn("__row", order if order is not None else F.monotonically_increasing_id()).where("url is not null")
    kept = [c for c in rows.columns if c not in ("url", "__row", *by)]
    return rows.groupBy("url", *by).agg(F.max_by(F.struct(*kept), "__row").alias("r")).select("url", *by, "r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.caseSensitive", "true")  # page and Page are two columns
    try:
        return csv_rows(spark.read.option("header", True).csv(path))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


_LOC = r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\s]+?)\s*(?:\]\]>)?\s*</loc>"


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex")


def locations(xml: Column) -> Column:
    """Addresses of a sitemap's pages, entities decoded."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)" + _LOC.removeprefix("(?is)")), 1), html_unescape)


def children(xml: Column) -> Column:
    """Addresses of the sitemaps that an index names: the first of each entry."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?is)<sitemap\b[^>]*>.*?</sitemap>"), 0)
    return F.transform(entries, lambda e: html_unescape(F.regexp_extract(e, _LOC, 1)))


def sitemap_text(files: DataFrame) -> DataFrame:
    """(url, content bytes) -> (url, xml); content of .gz addresses is unpacked."""
    packed = F.col("url").contains(".gz")
    plain = F.decode("content", "UTF-8")
    return files.select("url", F.when(packed, gunzip_text(F.when(packed, F.col("content")))).otherwise(plain).alias("xml"))


def sitemap_urls(start: DataFrame, sitemaps: DataFrame, depth: int = 5) -> DataFrame:
    """(url) of all pages that the sitemaps in ``start`` (url) reach among (url, xml) ``sitemaps``, through indexes too.

    Sitemaps that can't be found give nothing. ``depth`` ends chains of indexes, which may be cyclic.
    """
    found, level = [], start.select("url").distinct()
    for _ in range(depth):
        read = level.join(sitemaps, "url")
        found.append(read.where(~is_index(F.col("xml"))).select(F.explode(locations(F.col("xml"))).alias("url")))
        level = read.where(is_index(F.col("xml"))).select(F.explode(children(F.col("xml"))).alias("url")).distinct()
    return reduce(DataFrame.union, found)


def spider(pages: DataFrame, seed: str) -> DataFrame:
    """(url) of the seed and all links of its page."""
    page = pages.where(F.col("href") == seed)
    linked = page.select(F.explode(html.anchors(F.col("html"))).alias("a"), "href").select(urls.strip_fragment(urls.resolve(F.col("a.href"), F.col("href"))).alias("url"))
    own = pages.sparkSession.createDataFrame([(seed,)], "url string")
    return own.union(linked.where(urls.is_http(F.col("url")))).distinct()


def regex_filter(table: DataFrame, pattern: str, kind: str, url: str = "url", ignore_case: bool = True, on_invalid: str = "error") -> DataFrame:
    """kind: 'include', 'exclude' or ''. An empty pattern filters nothing; an invalid one raises, or filters nothing."""
    if not pattern or not kind:
        return table
    try:
        re.compile(pattern)
    except re.error:
        if on_invalid == "ignore":
            return table
        raise ValueError(f"invalid pattern: {pattern}") from None
    fits = F.col(url).rlike(("(?i)" if ignore_case else "") + pattern)
    return table.where(fits if kind == "include" else ~fits)


def resolve_seeds(parts: Sequence[DataFrame], pattern: str = "", kind: str = "") -> DataFrame:
    """Union of the sources, each URL once, filtered with regard to case."""
    return regex_filter(reduce(DataFrame.union, [p.select("url") for p in parts]).distinct(), pattern, kind, ignore_case=False)


def over_limit(lines: DataFrame, max_pages: int) -> DataFrame:
    """(urls, over_limit) of a list; a list is not cut."""
    return lines.agg(F.count(F.lit(1)).alias("urls")).withColumn("over_limit", F.col("urls") > max_pages)


def first_url(spider_url: Column, list_text: Column, sitemap_url: Column) -> Column:
    """The spider's URL, else the first http line of the list, else the sitemap's."""
    listed = F.get(F.filter(F.transform(F.split(list_text, "\n"), trim_ws), lambda x: x.startswith("http")), F.lit(0))
    return F.coalesce(not_empty(spider_url), listed, not_empty(sitemap_url))
