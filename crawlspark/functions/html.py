"""Fields of HTML pages by regular expressions, all in the JVM. First match by order in the document; absent is ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_unescape, not_empty, once, or_empty, trim_ws


def _attribute(tag: Column, name: str) -> Column:
    """The attribute's value in double, single or no quotes; NULL without the attribute. One search a tag."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    quoted = lambda v: (F.length(v) > 1) & ((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'")))
    return once(found, lambda v: F.when(quoted(v), v.substr(F.lit(2), F.length(v) - 2)).when(v != "", v))


def visible(html: Column) -> Column:
    """Without comments, scripts and styles, whose text may look like mark-up."""
    return F.regexp_replace(html, r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>)", "")  # one test for each character that is no <


def _tag(html: Column, element: str, attribute: str, value: str) -> Column:
    quoted = value.replace(".", r"\.")
    return F.regexp_extract(html, rf"(?is)<{element}\b[^>]*\s{attribute}\s*=\s*[\"']?{quoted}(?:[\"'\s/>][^>]*>|>)", 0)


def _title(html: Column) -> Column:
    return or_empty(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def _h1(html: Column) -> Column:
    inner = F.regexp_extract(visible(html), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return or_empty(F.regexp_replace(inner, r"(?s)<[^>]*>", ""))


def _meta(html: Column, name: str, attribute: str = "name") -> Column:
    return or_empty(_attribute(_tag(html, "meta", attribute, name), "content"))


def title(html: Column) -> Column:
    return trim_ws(html_unescape(_title(html)))


def h1(html: Column) -> Column:
    return trim_ws(html_unescape(_h1(html)))


def meta(html: Column, name: str, attribute: str = "name") -> Column:
    """content of the first meta tag of that name; not trimmed."""
    return html_unescape(_meta(html, name, attribute))


def canonical(html: Column) -> Column:
    """href as written, not resolved."""
    return html_unescape(or_empty(_attribute(_tag(html, "link", "rel", "canonical"), "href")))


def json_ld_scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)


def anchors(html: Column) -> Column:
    """array<struct<href, rel>> of the a and area elements with an href, in order."""
    tags = F.regexp_extract_all(visible(html), F.lit(r"(?is)<(?:a|area)\s[^>]*>"), 0)
    both = F.transform(tags, lambda t: F.struct(html_unescape(_attribute(t, "href")).alias("href"), _attribute(t, "rel").alias("rel")))
    return F.filter(both, lambda x: x["href"].isNotNull())


def paragraphs(html: Column) -> Column:
    """Texts of the p elements with single spaces, without empty ones."""
    inner = F.regexp_extract_all(visible(html), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    texts = F.transform(inner, lambda p: trim_ws(F.regexp_replace(html_unescape(F.regexp_replace(p, r"(?s)<[^>]*>", "")), r"\s+", " ")))
    return F.filter(texts, lambda t: t != "")


def article_text(html: Column) -> Column:
    """Text of the article (else main, else body) without header, footer and navigation."""
    body = F.regexp_replace(visible(html), r"(?is)<(header|footer|nav)\b.*?</(header|footer|nav)>", "")
    block = F.coalesce(*[not_empty(F.regexp_extract(body, rf"(?is)<{e}\b[^>]*>(.*)</{e}>", 1)) for e in ("article", "main", "body")], body)
    return trim_ws(F.regexp_replace(html_unescape(F.regexp_replace(block, r"(?s)<[^>]*>", " ")), r"\s+", " "))
