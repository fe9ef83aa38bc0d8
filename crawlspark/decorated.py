"""Test inputs of the queries: responses, head fields and links between pages, added to plain pages by arithmetic on page_id."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Valid in Spark and DuckDB.
DECORATED = """
WITH n AS (SELECT count(*) AS n FROM pages),
base AS (
  SELECT page_id, html, regexp_replace(url, '#.*$', '') AS href,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host
  FROM pages),
nxt AS (SELECT page_id, lead(href) OVER (PARTITION BY host ORDER BY page_id) AS next_same_host FROM (SELECT page_id, href, host FROM base)),
tgt AS (SELECT b.*, next_same_host, (b.page_id * 7 + 1) % (SELECT n FROM n) AS far_id FROM base b JOIN nxt ON b.page_id = nxt.page_id),
deco AS (
  SELECT t.page_id, t.href, t.host,
    CASE WHEN t.page_id % 20 = 7 THEN 404 WHEN t.page_id % 50 = 13 THEN 500 WHEN t.page_id % 60 = 31 THEN 0 ELSE 200 END AS status,
    t.page_id % 10 = 3 AS redirected,
    CASE WHEN t.page_id % 15 = 4 THEN 'application/pdf' WHEN t.page_id % 3 = 0 THEN 'text/html; charset=utf-8' ELSE 'text/html' END AS content_type,
    CASE WHEN t.page_id % 17 = 8 THEN false WHEN t.page_id % 17 = 9 THEN CAST(NULL AS BOOLEAN) ELSE true END AS crawlable,
    replace(replace(
      CASE WHEN t.page_id % 25 = 2 THEN regexp_replace(t.html, '<title>[^<]*</title>', '')
           WHEN t.page_id % 25 = 6 THEN replace(replace(t.html, '<h1>', '<h2>'), '</h1>', '</h2>') ELSE t.html END,
      '</head>',
      CASE WHEN t.page_id % 4 <> 1 THEN '<meta name="description" content="desc ' || CAST(t.page_id AS STRING) || '">' ELSE '' END ||
      CASE WHEN t.page_id % 5 <> 2 THEN '<link rel="canonical" href="' || t.href || '">' ELSE '' END ||
      CASE WHEN t.page_id % 11 = 5 THEN '<meta name="robots" content="NOINDEX, follow">' WHEN t.page_id % 11 = 6 THEN '<meta name="robots" content="index,nofollow">' ELSE '' END ||
      CASE WHEN t.page_id % 6 = 0 THEN '<meta property="og:title" content="OG ' || CAST(t.page_id % 9 AS STRING) || '"><meta property="og:site_name" content="' || t.host || '">' ELSE '' END ||
      CASE WHEN t.page_id % 8 = 1 THEN '<script type="application/ld+json">{"@type":"Article","headline":"H' || CAST(t.page_id AS STRING) || '","datePublished":"2024-01-0' || CAST(t.page_id % 9 + 1 AS STRING) || '","author":[{"name":"A"},{"name":"B"}],"publisher":{"@type":"Organization","name":"Pub"}}</script>'
           WHEN t.page_id % 8 = 3 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","headline":"G' || CAST(t.page_id AS STRING) || '"},{"@type":"Article","author":{"@type":"Person","name":"Ann"},"publisher":{"@type":"Organization","name":"Deep"},"dateModified":"2024-02-0' || CAST(t.page_id % 9 + 1 AS STRING) || '"}]}</script>'
           WHEN t.page_id % 8 = 5 THEN '<script type="application/ld+json">{"@type":"WebPage","mainEntity":{"@type":"Article","headline":"M &amp; ' || CAST(t.page_id AS STRING) || '","alternateHeadline":"alt"},"@graph":[{"@type":"Person","name":"Pat"},{"@type":"Person","name":"Sam"}]}</script>'
           WHEN t.page_id % 8 = 7 THEN '<script type="application/ld+json">{"@type":"Article","author":{"name":"A","headline":"X' || CAST(t.page_id AS STRING) || '"},"publisher":{"@type":"Organization","name":"P","dateModified":"2024"}}</script>' ELSE '' END ||
      '</head>'),
      '</nav>',
      CASE WHEN t.next_same_host IS NOT NULL THEN '<a href="' || t.next_same_host || '#x" rel="' || CASE t.page_id % 5 WHEN 0 THEN 'noopener nofollow' WHEN 1 THEN 'ugc' WHEN 2 THEN 'sponsored' ELSE 'noopener' END || '">n</a>' ELSE '' END ||
      '<a href="' || f.href || '">far</a><a href="' || t.href || '">self</a><a href="#frag">f</a><a href="javascript:void(0)">j</a><a href="mailto:x@example.com">m</a></nav>') AS html
  FROM tgt t JOIN base f ON f.page_id = t.far_id)
"""


def decorated_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, href, host, status, redirected, content_type, crawlable, html) from plain pages."""
    view = f"pages_{zlib.crc32(str(id(pages)).encode())}"
    pages.createOrReplaceTempView(view)
    out = spark.sql(DECORATED.replace("FROM pages", f"FROM {view}") + "SELECT * FROM deco")
    out.schema  # analysed: the view isn't needed any more
    spark.catalog.dropTempView(view)
    return out


def responses(pages: DataFrame) -> DataFrame:
    """Decorated pages with what a fetch reports."""
    status, redirected = F.col("status"), F.col("redirected")
    return pages.select(
        "page_id", "href", "host", "html", "crawlable",
        F.col("status").alias("fetch_status"),
        F.when(status == 404, "Not Found").when(status == 500, "Server Error").when(status == 200, "OK").otherwise("").alias("fetch_statusText"),
        status.between(200, 299).alias("fetch_ok"),
        redirected.alias("fetch_redirected"),
        F.when(redirected, F.concat("href", F.lit("?r=1"))).alias("fetch_finalUrl"),
        F.col("content_type").alias("fetch_contentType"),
        (F.col("page_id") * 37 % 900).cast("int").alias("fetch_duration"),
        F.octet_length("html").cast("long").alias("fetch_decodedBodySize"),
    )

def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the decorated pages of a data folder."""
    return responses(decorated_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")))
