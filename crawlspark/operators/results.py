"""The wide results table and what is asked of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fetch
from ..storage import Scratch
from . import links, ranking

#: Display title and column of the results table, in the table's order.
COLUMNS = [
    ("url", "href"), ("status", "fetch_status"), ("depth", "depth"), ("duration (ms)", "fetch_duration"), ("redirected", "fetch_redirected"),
    ("redirect target", "fetch_finalUrl"), ("encoded size", "fetch_encodedBodySize"), ("canonical", "canonical"), ("title", "title"),
    ("description", "description"), ("keyword", "keyword"), ("robots", "robots"), ("h1", "h1"), ("content-type", "fetch_contentType"),
    ("decoded size", "fetch_decodedBodySize"), ("deliveryType", "fetch_deliveryType"), ("content-encoding", "fetch_contentEncoding"),
    ("next hop protocol", "fetch_nextHopProtocol"), ("timestamp", "fetch_timestamp"), ("ok", "fetch_ok"), ("og:image", "og_image"),
    ("og:title", "og_title"), ("og:site", "og_site_name"), ("og:description", "og_description"), ("publisher", "schema_publisher"),
    ("dateModified", "schema_dateModified"), ("datePublished", "schema_datePublished"), ("authors", "schema_authors"),
    ("headline", "schema_headline"), ("altHeadline", "schema_alternateHeadline"), ("content", "content"), ("outbound", "isOutbound"),
    ("crawlable", "crawlable"), ("indexable", "indexable"), ("outbound links", "outbound_count"), ("inbound links", "inbound_count"),
    ("broken outbound", "broken_outbound"), ("clicks", "clicks"), ("impressions", "impressions"), ("html", "opfs_path"),
]


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns become columns a_b and arrays a_0, a_1 and so on, as many as the longest has; what is nested deeper is left out."""
    plain = lambda t: t.typeName() not in ("struct", "array", "map")
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array" and plain(f.dataType.elementType)]
    longest = df.agg(*[F.max(F.size(F.col(f"`{a}`"))).alias(a) for a in arrays]).first().asDict() if arrays else {}
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            out += [F.get(F.col(f"`{f.name}`"), F.lit(i)).alias(f"{f.name}_{i}") for i in range(longest.get(f.name) or 0)]
        elif f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}_{x.name}") for x in f.dataType.fields if plain(x.dataType)]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def results_table(records: DataFrame, edge_table: DataFrame, csv: DataFrame | None = None, crawled: DataFrame | None = None, stored: DataFrame | None = None, csv_by: Sequence[str] = ()) -> DataFrame:
    """Records with indexable, link counts and, if given, the clicks and impressions of an imported CSV table.

    csv_by: further columns that rows of the table and records have in common. crawled: (url, depth, is_outbound) of the crawl, 0 and NULL where it has no row. stored: (href, path) of the archive.

    Columns of the table that the records don't have are left out; so are links and html.
    """
    outbound = edge_table.groupBy(F.col("source").alias("href")).agg(F.count(F.lit(1)).alias("n"))
    page_has_links = F.col("fetch_ok") & fetch.type_bucket(F.col("fetch_contentType")).contains("html")
    wide = (
        records.drop("html", "anchors")
        .join(outbound, "href", "left")
        .join(links.inbound_counts(edge_table), "href", "left")
        .join(links.broken_counts(edge_table, records), "href", "left")
        .withColumn("outbound_count", F.when(page_has_links, F.coalesce("n", F.lit(0))))
        .withColumn("indexable", fetch.indexable(F.col("fetch_ok"), F.col("fetch_contentType"), F.col("robots")))
    )
    if csv is not None:
        wide = wide.join(csv.select(F.col("url").alias("href"), *csv_by, "clicks", "impressions"), ["href", *csv_by], "left")
    if crawled is not None:
        met = crawled.select(F.col("url").alias("href"), F.col("depth"), F.when(F.col("is_outbound"), True).alias("isOutbound"))
        wide = wide.drop("depth", "isOutbound").join(met, "href", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    if stored is not None:
        wide = wide.drop("opfs_path").join(stored.select("href", F.col("path").alias("opfs_path")).distinct(), "href", "left")
    return wide.select(*[c for _, c in COLUMNS if c in wide.columns])


def search(results: DataFrame, text: str, columns: Sequence[str] = ("href", "title", "h1")) -> DataFrame:
    """Rows with the text, in any case, in one of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False))
    return results.where(found)


def column_filter(results: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """All conditions hold: a text is contained in any case, a boolean or number is equal, None leaves a column alone."""
    for c, v in wanted.items():
        if v is None:
            continue
        results = results.where(F.lower(F.col(c)).contains(v.lower()) if isinstance(v, str) else F.col(c) == v)
    return results


def drill_down(results: DataFrame, field: str, comparison: str, value: object) -> DataFrame:
    """comparison: '=', '!=' (NULL is different from any value) or 'like'."""
    c = F.col(field)
    tests: dict[str, Column] = {"=": c == F.lit(value), "!=": ~c.eqNullSafe(F.lit(value)), "like": F.lower(c).contains(str(value).lower())}
    return results.where(tests[comparison])


def page_of(results: DataFrame, order: Sequence[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page of the sorted table; the key breaks ties. A deep page costs no more than the first."""
    return ranking.page_of(results, [*order, F.col("href")], page, size, Scratch(results.sparkSession))


def detail_outbound(edge_table: DataFrame, results: DataFrame, href: str) -> DataFrame:
    """A page's links with the status of their targets."""
    status = results.select(F.col("href").alias("target"), F.col("fetch_status").alias("target_status"))
    return edge_table.where(F.col("source") == href).join(status, "target", "left").select("target", "follow", "directive_source", "target_status")


def detail_inbound(edge_table: DataFrame, href: str) -> DataFrame:
    """Other pages that link to a page."""
    return edge_table.where((F.col("target") == href) & (F.col("source") != href)).select("source", "follow", "directive_source")


def detail_sections(records: DataFrame, href: str) -> DataFrame:
    """A record as (section, key, value): plain fields, then nested ones by their prefix; empty values are left out."""
    skipped = ("href", "html", "anchors", "links", "paragraphs", "fetch_finalUrl", "page_id")
    fields = [c for c in records.columns if c not in skipped]
    section = lambda c: c.split("_")[0] if c.startswith(("fetch_", "og_", "schema_")) else ""
    rows = F.array(*[F.struct(F.lit(section(c)).alias("section"), F.lit(c.removeprefix(section(c) + "_") if section(c) else c).alias("key"), F.col(c).cast("string").alias("value")) for c in fields])
    return records.where(F.col("href") == href).select(F.explode(rows).alias("r")).select("r.*").where(F.coalesce(F.col("value"), F.lit("")) != "")


def redirects(records: DataFrame) -> DataFrame:
    return records.where("fetch_redirected").select("href", "fetch_status", "fetch_finalUrl")


def latest(records: DataFrame, key: str = "href", by: str = "fetch_timestamp") -> DataFrame:
    """The last record of each URL, or of what else ``key`` names."""
    return records.groupBy(key).agg(F.max_by(F.struct(*[c for c in records.columns if c != key]), by).alias("r")).select(key, "r.*")
