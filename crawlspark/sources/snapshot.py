"""A crawl's raw material: pages with their responses. Fetching is a lookup in this snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fetch, html, urls
from ..functions.article import article
from ..functions.json_ld import json_ld
from ..functions.text import built_once, iso_timestamp

#: Columns that ``fetched`` looks for in a table of fetches, beside url and html (or body).
FETCH_COLUMNS = {
    "status": "int", "status_text": "string", "headers": "map<string,string>", "final_url": "string", "duration": "int", "transfer_size": "long",
    "encoded_size": "long", "protocol": "string", "timestamp": "timestamp", "crawlable": "boolean",
}


def fetched(table: DataFrame, charset: str = "utf-8") -> DataFrame:
    """Responses from a table of one's own: url, and html (text) or body (bytes in ``charset``), and any of FETCH_COLUMNS.

    What the table lacks is NULL, but for the status (200 where there is a page, else 0). Other columns pass through,
    unless they have a name of the result. A URL keeps its query and loses its fragment.
    """
    plain = table if "html" in table.columns else table.withColumn("html", F.decode("body", charset))
    given = lambda c: (F.col(c) if c in table.columns else F.lit(None)).cast(FETCH_COLUMNS[c])
    href, headers = urls.strip_fragment(F.col("url")), given("headers")
    status = F.coalesce(given("status"), F.when(F.col("html").isNotNull(), 200).otherwise(0))
    size = F.octet_length("body" if "body" in table.columns else "html").cast("long")
    final = F.nullif(given("final_url"), href)
    out = {
        "href": href, "host": urls.host(href), "html": F.coalesce("html", F.lit("")), "crawlable": given("crawlable"),
        "fetch_status": status, "fetch_statusText": F.coalesce(given("status_text"), F.lit("")), "fetch_ok": status.between(200, 299),
        "fetch_redirected": final.isNotNull(), "fetch_finalUrl": final, "fetch_contentType": F.coalesce(fetch.header(headers, "content-type"), F.lit("")),
        "fetch_duration": given("duration"), "fetch_decodedBodySize": size,
        "fetch_encodedBodySize": fetch.encoded_size(given("encoded_size"), fetch.header(headers, "content-length").try_cast("long"), size),
        "fetch_deliveryType": fetch.delivery_type(given("transfer_size"), given("duration")),
        "fetch_contentEncoding": F.coalesce(fetch.header(headers, "content-encoding"), F.lit("")), "fetch_nextHopProtocol": given("protocol"),
        "fetch_timestamp": iso_timestamp(given("timestamp")),
        "x_robots": fetch.header(headers, "x-robots-tag"),
    }
    known = {c.lower() for c in [*out, *FETCH_COLUMNS, "url", "body"]}
    others = [F.col(f"`{c}`") for c in table.columns if c.lower() not in known]
    return plain.select(*others, *[c.alias(k) for k, c in out.items()])


def latest_headers(events: DataFrame) -> DataFrame:
    """(request_id, url, status, status_line, headers, timestamp): of each request the last event, by time and then URL."""
    row = F.struct("url", "status", "status_line", "headers", "timestamp")
    return events.groupBy("request_id").agg(F.max_by(row, F.struct("timestamp", "url")).alias("r")).select("request_id", "r.*")


def settled(attempts: DataFrame, max_retries: int = 2, by: tuple[str, ...] = ("url",)) -> DataFrame:
    """(url, attempts, ok): where the crawl leaves a URL, from a log of (url, attempt from 1, ok).

    A failed fetch is repeated while there were fewer than ``max_retries`` attempts; the first good one ends it. Later
    rows of the log, which such a crawl wouldn't have made, count for nothing. Where a log has several fetches of a URL,
    ``by`` names what tells them apart, and each has its row.
    """
    tried = attempts.where(F.col("attempt") <= max(1, max_retries))
    good = F.min(F.when(F.col("ok"), F.col("attempt")))
    return tried.groupBy(*by).agg(F.coalesce(good, F.max("attempt")).alias("attempts"), good.isNotNull().alias("ok"))


def records(responses: DataFrame, readability: bool = False) -> DataFrame:
    """The page record: response facts, head fields, Open Graph, structured data and raw links; the article's text and paragraphs if wanted."""
    with_ld = responses.withColumn("__ld", html.json_ld_scripts(F.col("html"))).withColumn("__ld", _structured())
    if not readability:
        return with_ld.select(*responses.columns, *_fields())
    read = with_ld.select(*responses.columns, *_fields(), article("html").alias("__article"))
    return read.select("*", "__article.content", "__article.paragraphs").drop("__article")


@built_once
def _structured() -> Column:
    return json_ld(F.col("__ld"))


@built_once
def _fields() -> list[Column]:
    page = F.col("html")
    fields = {name: html.meta(page, name) for name in ("description", "robots")}
    og = {f"og_{k}": html.meta(page, f"og:{k}", "property") for k in ("image", "title", "site_name", "description")}
    return [
        html.title(page).alias("title"), html.h1(page).alias("h1"), html.canonical(page).alias("canonical"), html.meta(page, "keywords").alias("keyword"),
        *[c.alias(k) for k, c in {**fields, **og}.items()],
        *[F.col(f"__ld.{k}").alias(f"schema_{k}") for k in ("publisher", "dateModified", "datePublished", "authors", "headline", "alternateHeadline")],
        html.anchors(page).alias("anchors"),
    ]


def flat_records(frontier: DataFrame, pages: DataFrame, timestamp: Column, url: str = "url") -> DataFrame:
    """What a schedule's fetch of each URL gives: (url, status, ok, timestamp, title, description, h1, canonical, ogTitle, ogDescription, error).

    A URL that the snapshot (records) doesn't have failed: status 0, an empty title and an error.
    """
    fields = {"title": "title", "description": "description", "h1": "h1", "canonical": "canonical", "ogTitle": "og_title", "ogDescription": "og_description"}
    missing = F.col("href").isNull()
    met = frontier.select(F.col(url).alias("__url")).join(pages.select("href", "fetch_status", "fetch_ok", *fields.values()), F.col("__url") == F.col("href"), "left")
    return met.select(
        F.col("__url").alias("url"), F.coalesce("fetch_status", F.lit(0)).alias("status"), F.coalesce("fetch_ok", F.lit(False)).alias("ok"), timestamp.alias("timestamp"),
        *[(F.when(missing, F.lit("")).otherwise(F.col(c)) if k == "title" else F.col(c)).alias(k) for k, c in fields.items()],
        F.when(missing, "Failed to fetch").alias("error"),
    )


def error_record(frontier: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Lookup of URLs in a snapshot: a miss is a record with status 0 and an error."""
    missing = F.col("href").isNull()
    joined = frontier.join(pages, F.col(url) == F.col("href"), "left")
    return joined.select(
        F.col(url).alias("href"),
        F.when(missing, 0).otherwise(F.col("fetch_status")).alias("fetch_status"),
        F.when(missing, False).otherwise(F.col("fetch_ok")).alias("fetch_ok"),
        F.when(missing, "Failed to fetch").alias("error"),
    )
