"""Counters and histograms; the same aggregates serve batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fetch
from ..functions.text import percent


def summary(records: DataFrame, start_host: str, total: Column | None = None) -> DataFrame:
    """One row: encountered, crawled, blocked, internal, external, indexable and nonIndexable."""
    indexable = fetch.indexable(F.col("fetch_ok"), F.col("fetch_contentType"), F.col("robots"))
    internal = F.coalesce(F.col("host") == start_host, F.lit(False))
    n = F.count(F.lit(1))
    return records.agg(
        (total if total is not None else n).alias("encountered"),
        n.alias("crawled"),
        F.count_if(F.col("crawlable").eqNullSafe(F.lit(False))).alias("blocked"),
        F.count_if(internal).alias("internal"),
        F.count_if(~internal).alias("external"),
        F.count_if(indexable).alias("indexable"),
        F.count_if(~indexable).alias("nonIndexable"),
    )


def status_histogram(records: DataFrame) -> DataFrame:
    out = records.groupBy(fetch.status_key(F.col("fetch_status")).alias("status")).agg(F.count(F.lit(1)).alias("pages"))
    return out.withColumn("class", fetch.histogram_class(F.col("status"))).orderBy(F.desc("pages"), "status")


def type_histogram(records: DataFrame) -> DataFrame:
    out = records.groupBy(fetch.type_bucket(F.col("fetch_contentType")).alias("content_type")).agg(F.count(F.lit(1)).alias("pages"))
    return out.orderBy(F.desc("pages"), "content_type")


def schedule_summary(records: DataFrame) -> DataFrame:
    """total, ok and errors of a run."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if("fetch_ok").alias("ok"), F.count_if(~F.coalesce("fetch_ok", F.lit(False))).alias("errors"))


def progress(crawled: DataFrame, queue: DataFrame) -> DataFrame:
    both = crawled.select(F.lit(1).alias("c")).unionAll(queue.select(F.lit(0).alias("c"))).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("crawled"), F.count("c").alias("total"))
    return both.select("crawled", "total", percent(F.col("crawled"), F.col("total")).alias("percent"))
