"""What regular expressions can't do on HTML and JSON, as Arrow UDFs with Python's own parsers."""

from __future__ import annotations

import gzip
import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whole_entities

DOM_FIELDS = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "h1", "canonical", "robots")] + [T.StructField("n_links", T.IntegerType())])
SCHEMA_FIELDS = T.StructType([T.StructField(c, T.StringType()) for c in ("publisher", "dateModified", "datePublished", "authors", "headline", "alternateHeadline")])


class _Page(HTMLParser):
    """Collects head fields and links; first match by order in the document."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.within: list[str] = []
        self.links = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("name", "").lower()) in ("description", "robots"):
            self.found.setdefault(name, a.get("content", ""))
        elif tag == "link" and a.get("rel") == "canonical":
            self.found.setdefault("canonical", a.get("href", ""))
        elif tag in ("a", "area") and "href" in a:
            self.links += 1
        elif tag in ("title", "h1") and tag not in self.found:
            self.found[tag] = ""
            self.within.append(tag)

    def handle_endtag(self, tag):
        if tag in self.within:
            self.within.remove(tag)

    def handle_data(self, data):
        for tag in self.within:
            self.found[tag] += data


@F.pandas_udf(DOM_FIELDS)
def dom_extract(html: pd.Series) -> pd.DataFrame:
    rows = []
    for text in html:
        page = _Page()
        page.feed(whole_entities(text or ""))
        page.close()
        rows.append([page.found.get(k, "").strip() if k in ("title", "h1") else page.found.get(k, "") for k in ("title", "description", "h1", "canonical", "robots")] + [page.links])
    return pd.DataFrame(rows, columns=["title", "description", "h1", "canonical", "robots", "n_links"])


def deep_values(obj, key: str):
    """Values of a key at any depth, in order of the document; what is below a hit is not searched."""
    if isinstance(obj, dict):
        for k, v in obj.items():
            if k == key:
                yield v
            else:
                yield from deep_values(v, key)
    elif isinstance(obj, list):
        for v in obj:
            yield from deep_values(v, key)


def _names(value) -> str | None:
    """None where the authors that were found before stay."""
    if isinstance(value, list):
        return ", ".join(str(x.get("name") or "") if isinstance(x, dict) else "" for x in value)
    return str(value["name"]) if isinstance(value, dict) and value.get("name") else None


_BLANK = dict.fromkeys(("publisher", "dateModified", "datePublished", "authors", "headline", "alternateHeadline"), "")


def schema_of(scripts: list[str]) -> dict:
    """The structured data of a page: the last script's value that isn't empty wins.

    A script that is no JSON is passed over. One that is JSON's null ends with blanks in all fields, unless authors were
    found before it.
    """
    out = dict(_BLANK)
    for script in scripts:
        try:
            data = json.loads(script)
        except ValueError:
            continue
        first = lambda key, data=data: next(deep_values(data, key), None)
        publisher = first("publisher")
        if isinstance(publisher, dict) and publisher.get("@type") == "Organization":
            out["publisher"] = publisher.get("name")
        for key in ("headline", "alternateHeadline", "dateModified", "datePublished"):
            value = first(key)
            if value or isinstance(value, dict | list):
                out[key] = json.dumps(value) if isinstance(value, bool) else value if isinstance(value, str | int | float) else None
        if (names := _names(first("author"))) is not None:
            out["authors"] = names
        if not out["authors"]:
            if data is None:
                return dict(_BLANK)
            graph = data.get("@graph") if isinstance(data, dict) else None
            out["authors"] = ", ".join(str(x["name"]) for x in (graph if isinstance(graph, list) else []) if isinstance(x, dict) and x.get("@type") == "Person" and x.get("name"))
    return out


@F.pandas_udf(SCHEMA_FIELDS)
def schema_fields(scripts: pd.Series) -> pd.DataFrame:
    """From the array of a page's JSON-LD scripts (html.json_ld_scripts)."""
    rows = [{k: None if v is None else str(v) for k, v in schema_of(list(s) if s is not None else []).items()} for s in scripts]
    return pd.DataFrame(rows, columns=list(_BLANK))


@F.pandas_udf(T.StringType())
def gunzip_text(data: pd.Series) -> pd.Series:
    """The text in gzip bytes; NULL if they are damaged."""

    def one(x):
        try:
            return None if x is None else gzip.decompress(bytes(x)).decode("utf-8", "replace")
        except (OSError, EOFError):
            return None

    return data.map(one)


@F.pandas_udf(T.StringType())
def url_join(href: pd.Series, base: pd.Series) -> pd.Series:
    """Resolution by the standard library, to hold urls.resolve against."""
    return pd.Series([urljoin(b, h) if h is not None and b is not None else None for h, b in zip(href, base, strict=True)])


def decoded(data: Column, charset: str = "utf-8") -> Column:
    return F.decode(data, charset)
