"""Removal of lines that many documents share.

Lines are exploded and normalised, their keys are hashed to 128 bits, and the rows that hold each hash are counted with
partial sums. The frequent hashes are a written table; joined with the exploded hashes (no text is shuffled for that) it
gives the positions that each document may lose, and of these few the distinct documents of each hash are counted: rows
that repeat an id are one document. The last join brings the positions to the documents, whose other lines are put
together again by position.

Defined results: a null text is one empty line, and so is an empty one; the document with the largest id keeps its
lines with the key (all rows that have this id do); a null id is smaller than any other; a repeated row counts as one
more document; an empty table gives an empty table; other columns pass through, and those named like a result column
are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The characters stripped at both ends of a line: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and with n_lines and n_dropped."""
    scratch = Scratch(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (id_col, text, "n_lines", "n_dropped")]
    whole = F.coalesce(F.col(text), F.lit(""))
    #: Rows with one id but different texts are told apart by a hash of the text.
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(whole).alias("__th"), whole.alias("__text"))
    lines = rows.select("__id", "__th", F.posexplode(F.split("__text", "\n", -1)).alias("__pos", "__line"))
    keys = lines.select("__id", "__th", "__pos", line_key(F.col("__line")).alias("__key")).where(F.char_length("__key") >= min_chars)
    hashed = keys.select("__id", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"))

    candidates = F.filter(F.transform(F.split("__text", "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    pairs = F.array_distinct(F.transform(candidates, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))
    frequent = (
        rows.select("__id", F.explode(pairs).alias("__p"))
        .groupBy(F.col("__p.h1").alias("__f1"), F.col("__p.h2").alias("__f2"))
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__keeper"))
        .where(F.col("__n") >= min_docs)
        .select("__f1", "__f2", "__keeper")
    )
    frequent = scratch.save(frequent, "frequent")
    met = hashed.join(frequent, (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2"))).drop("__h1", "__h2")
    met = scratch.save(met, "met")
    few = met.groupBy("__f1", "__f2").agg(F.count_distinct(F.struct("__id")).alias("__n")).where(F.col("__n") < min_docs).drop("__n")
    few = scratch.save(few, "few")  # written, so that the hot keys of the join below are split
    lost = (
        met.where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .join(few.hint("merge"), ["__f1", "__f2"], "left_anti")
        .groupBy("__id", "__th")
        .agg(F.collect_set("__pos").alias("__lost"))
        .withColumnsRenamed({"__id": "__lost_id", "__th": "__lost_th"})
    )
    whole_lines = docs.select(id_col, *rest, F.xxhash64(whole).alias("__th"), F.split(whole, "\n", -1).alias("__lines"))
    lost = scratch.save(lost, "lost")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__lost", F.array().cast("array<int>")))
    return (
        whole_lines.join(lost, F.col(id_col).eqNullSafe(F.col("__lost_id")) & (F.col("__th") == F.col("__lost_th")), "left")
        .select(
            id_col,
            F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n").alias(text),
            *rest,
            F.size("__lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )
