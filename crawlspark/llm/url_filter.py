"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule names a host and the beginning of a path; it fits the host and all its subdomains. Each rule is filed under
one of the tokens that any URL it fits must contain: the one that the fewest URLs have. The tokens of a URL fetch the
rules filed under them, and only the regular expressions of those candidates run. Everything is DataFrame operations.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path, and no rule with a host
fits it; equal URLs are judged once; repeated rows stay repeated; of two fitting rules of the same length the one that
sorts first by (text, verdict) wins; an empty rule list leaves the default verdict everywhere.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A larger rule table is joined by shuffle instead of being broadcast.
MAX_BROADCAST_RULES = 50_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parse_rule(verdict: str, text: str) -> Rule:
    """``example.net/en/`` -> host ``example.net``, path ``/en/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _literals(rule: Rule) -> list[str]:
    """Tokens that every URL the rule fits has: the labels of the host, and the path's segments that end in ``/``."""
    labels = [f"h:{x}" for x in rule.host.split(".") if x]
    segments = [f"p:{x}" for x in rule.path.split("/")[1:-1] if x]
    return labels + segments or [""]


def _pattern(rule: Rule) -> str:
    quote = lambda x: "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" if x else ""
    if not rule.host:
        return "^[^/]*" + quote(rule.path)
    return "^(?:[^/]*\\.)?" + quote(rule.host) + ("" if rule.path else "(?=/|\\z)") + quote(rule.path)


def _url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, re.escape(".")), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments, F.array(F.lit(""))))


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    parsed = pages.select(F.col(url).alias("__url")).distinct().select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    tokens = parsed.select("__url", F.concat("host", "path").alias("__target"), F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("__token"))

    rows = [(f"{r.host}{r.path}", r.verdict, len(r.host + r.path), _pattern(r), _literals(r)) for r in rules]
    table = spark.createDataFrame(rows, "rule string, verdict string, length int, pattern string, literals array<string>")
    literals = sorted({x for r in rows for x in r[4]})
    hint = F.broadcast if len(rows) <= MAX_BROADCAST_RULES else lambda x: x
    wanted = hint(spark.createDataFrame([(x,) for x in literals], "__token string"))
    seen = tokens.join(wanted, "__token", "left_semi").groupBy("__token").agg(F.count(F.lit(1)).alias("seen"))
    filed = (
        table.withColumn("__token", F.explode("literals"))
        .join(seen, "__token", "left")
        .groupBy("rule", "verdict", "length", "pattern")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("__token"))).alias("rarest"))
        .select(F.col("rarest.__token").alias("__token"), "rule", "verdict", "length", "pattern")
    )
    found = (
        tokens.join(hint(filed), "__token")
        .where(F.expr("__target rlike pattern"))
        .groupBy("__url")
        .agg(F.min(F.struct((-F.col("length")).alias("n"), "rule", "verdict")).alias("__best"))
    )
    clash = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    return (
        pages.drop(*clash)
        .join(found, F.col(url) == F.col("__url"), "left")
        .select(
            *[F.col(c) for c in pages.columns if c not in clash],
            host_of(F.col(url)).alias("host"),
            path_of(F.col(url)).alias("path"),
            F.col("__best.rule").alias("rule"),
            F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
        )
    )
