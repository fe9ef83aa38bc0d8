"""Facts of a response as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import not_empty, or_empty, trim_ws


def type_bucket(content_type: Column) -> Column:
    """Without parameters; 'unknown' if empty."""
    return F.coalesce(not_empty(trim_ws(F.regexp_replace(or_empty(content_type), r"(?s);.*$", ""))), F.lit("unknown"))


def status_key(status: Column) -> Column:
    """NULL and 0 are one bucket."""
    return F.coalesce(status, F.lit(0)).cast("string")


def indexable(ok: Column, content_type: Column, robots: Column) -> Column:
    html = F.lower(content_type).contains("text/html")
    return F.coalesce(ok & html & ~F.lower(or_empty(robots)).contains("noindex"), F.lit(False))


def ok_html(status: Column, content_type: Column) -> Column:
    return (F.coalesce(status, F.lit(0)) < 400) & or_empty(content_type).contains("text/html")


def row_class(status: Column) -> Column:
    return F.when(status >= 400, "error").when(status >= 300, "warning").otherwise("")


def histogram_class(key: Column) -> Column:
    return F.when(key.startswith("2"), "ok").when(key.startswith("3"), "redirect").when(key.rlike("^[45]"), "error").otherwise("other")


def delivery_type(transfer_size: Column, duration: Column) -> Column:
    """By the timing entry if there is one; else under 12 ms it was the cache."""
    return F.when(transfer_size == 0, "cache").when(transfer_size.isNull() & (duration < 12), "cache").otherwise("network")


def encoded_size(measured: Column, content_length: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(measured, F.lit(0)), F.nullif(content_length, F.lit(0)), raw)


def header(headers: Column, name: str) -> Column:
    """A header's value; names are the same in any case. The first counts, an empty one is NULL."""
    fitting = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return not_empty(trim_ws(F.get(fitting, F.lit(0))["value"]))


def user_agent_rule(user_agent: Column) -> Column:
    """The request headers that a crawl sets: its User-Agent, or none if there is none to set."""
    named = not_empty(user_agent)
    return F.when(named.isNotNull(), F.create_map(F.lit("User-Agent"), named)).otherwise(F.create_map().cast("map<string,string>"))
