"""The audit: nine checks over the records and edges of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fetch
from ..functions.text import or_empty
from ..storage import Scratch
from . import links

#: Title and severity of the checks, in the order of the report.
CHECKS = {
    "broken_pages": ("Broken pages (4xx / 5xx)", "error"),
    "redirected": ("Redirected pages", "warning"),
    "blocked": ("Blocked by robots.txt", "warning"),
    "missing_title": ("Missing title", "warning"),
    "missing_h1": ("Missing H1", "info"),
    "missing_description": ("Missing meta description", "info"),
    "missing_canonical": ("Missing canonical", "info"),
    "duplicate_titles": ("Duplicate titles", "warning"),
    "broken_links": ("Pages with broken outbound links", "error"),
}


def _issue(rows: DataFrame, check: str, detail: Column) -> DataFrame:
    title, severity = CHECKS[check]
    return rows.select(F.lit(title).alias("issue"), F.lit(severity).alias("severity"), "href", detail.alias("detail"))


def _of_page() -> dict[str, tuple[Column, Column]]:
    """Condition and detail of the checks that one record decides."""
    status = F.col("fetch_status")
    html_ok = fetch.ok_html(status, F.col("fetch_contentType"))
    missing = {"missing_title": "title", "missing_h1": "h1", "missing_description": "description", "missing_canonical": "canonical"}
    return {
        "broken_pages": (F.coalesce(status, F.lit(0)) >= 400, F.trim(F.concat_ws(" ", status.cast("string"), "fetch_statusText"))),
        "redirected": (F.col("fetch_redirected"), status.cast("string")),
        "blocked": (F.col("crawlable").eqNullSafe(F.lit(False)), or_empty(F.col("robots"))),
        **{name: (html_ok & (or_empty(F.col(c)) == ""), F.lit("")) for name, c in missing.items()},
    }


def _duplicate_titles(records: DataFrame) -> DataFrame:
    named = records.where(or_empty(F.col("fetch_contentType")).contains("text/html") & (or_empty(F.col("title")) != "")).select("href", "title")
    # A written table, so that the pages of a very common title can be dealt over tasks.
    often = Scratch(records.sparkSession).save(named.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title"), "titles")
    return _issue(named.join(often, "title"), "duplicate_titles", F.col("title"))


def _broken_links(records: DataFrame, edge_table: DataFrame) -> DataFrame:
    broken = links.broken_edges(edge_table, records).withColumnRenamed("source", "href")
    return _issue(broken, "broken_links", F.format_string("→ %s (%d)", "target", "target_status"))


def check(records: DataFrame, edge_table: DataFrame, name: str) -> DataFrame:
    if name == "duplicate_titles":
        return _duplicate_titles(records)
    if name == "broken_links":
        return _broken_links(records, edge_table)
    condition, detail = _of_page()[name]
    return _issue(records.where(condition), name, detail)


def issues(records: DataFrame, edge_table: DataFrame) -> DataFrame:
    """All checks; those that a record decides come out of one scan."""
    found = F.array(*[F.when(c, F.struct(F.lit(CHECKS[k][0]).alias("issue"), F.lit(CHECKS[k][1]).alias("severity"), d.alias("detail"))) for k, (c, d) in _of_page().items()])
    of_pages = records.select("href", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.issue", "x.severity", "href", "x.detail")
    return of_pages.unionByName(_duplicate_titles(records)).unionByName(_broken_links(records, edge_table))


def issue_counts(issue_table: DataFrame) -> DataFrame:
    """Checks without a finding are left out."""
    return issue_table.groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("items"))
