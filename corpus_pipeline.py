"""A pipeline from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the
next stage's documents. All stages but the last return the columns that they got.

Defined results, beside those of the operators: a stage on an empty table gives an empty table; rows without an id pass
the filters; columns that the stages don't know pass through up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspark.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from crawlspark.llm.scratch import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    It learns from the labels of every fold, so labelled documents are judged by a model that has seen their labels.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = toxicity.score(docs.withColumnsRenamed({c: f"__{c}" for c in ("score", "predicted") if c in docs.columns}), model)
    return scored.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({f"__{c}": c for c in ("score", "predicted")})


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many share; n_chars follows the text. A null text becomes an empty one."""
    others = {c: f"__{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(others))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in others.items()}).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, then text hash, then JSON of all columns.

    Rows are told apart by (doc_id, hash of the text). Rows without an id or without words are in no group and all stay.
    """
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("doc"), th.alias("th"))).alias("key"), "text")
    groups = Scratch(spark).save(jaccard_join.near_duplicates(keyed, "key"), "groups").where("key is not null and n_shingles > 0")
    fates = groups.groupBy("key").agg(F.bool_or(F.col("component_id") == F.col("key")).alias("__stays"), F.count(F.lit(1)).alias("__n")).where("not __stays or __n > 1")
    fates = Scratch(spark).save(fates.select(F.col("key.doc").alias("__doc"), F.col("key.th").alias("__key_th"), "__stays"), "fates")
    named = docs.where("doc_id is not null").withColumn("__th", th)
    same = (F.col("doc_id") == F.col("__doc")) & (F.col("__th") == F.col("__key_th"))
    alone = named.join(fates.hint("merge"), same, "left_anti").select(*docs.columns)
    # Equal keys that stay: partial minima leave one row of each, however often it is repeated.
    repeated, row = named.join(fates.where("__stays").hint("merge"), same), F.struct(*docs.columns)
    one = repeated.groupBy("__doc", "__key_th").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return alone.unionByName(one).unionByName(docs.where("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, which may be not at all; rows with one id are rows of their own."""
    scratch = Scratch(spark)
    numbered = scratch.save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    taken = scratch.save(mixing.mix_sources(numbered.select("doc_id", "text", "source", "__row"), carry=["__row"]), "taken")
    times = taken.where("taken > 0").select("__row", (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    met = numbered.join(times.hint("merge"), "__row")
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    out = packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("jaccard_join", one_of_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained classifier and a tokeniser can't be expressed in SQL; tests/llm hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
