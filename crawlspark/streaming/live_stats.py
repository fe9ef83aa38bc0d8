"""Counters of a crawl while it runs: the batch aggregates over a stream of page records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import stats
from ..storage import Scratch


def record_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 4) -> DataFrame:
    """Records as files of a folder that the crawl adds to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_summary(stream: DataFrame, start_host: str, out: str, checkpoint: str) -> None:
    """Takes in what has come and keeps the counters in ``out``; goes on from ``checkpoint`` after a restart."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stats.summary(stream, start_host).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()


def live_summary(records: DataFrame, start_host: str, files: int = 8) -> DataFrame:
    """The summary by way of a stream: records are written as ``files`` files and read as they come."""
    spark = records.sparkSession
    scratch = Scratch(spark)
    folder, out = scratch.path("records"), scratch.path("summary")
    records.select("host", "fetch_ok", "fetch_contentType", "robots", "crawlable").repartition(files).write.parquet(folder)
    run_summary(record_stream(spark, folder, spark.read.parquet(folder).schema), start_host, out, scratch.path("checkpoint"))
    return spark.read.parquet(out)
