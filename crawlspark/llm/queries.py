"""One query for each operator, over its whole table, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .jaccard_join import near_duplicates
from .line_dedup import line_dedup
from .merkle import folded, leaf_digest, merkle_paths, proof_digest
from .mixing import mix_sources
from .packing import pack_documents
from .periodic import periodic_runs
from .scratch import Scratch
from .sketch_dedup import sketch_duplicates
from .suffix_dedup import repeated_bytes
from .topk import top_k_inner_product
from .toxicity import fold, score, train
from .url_filter import parse_rule, url_verdicts
from .warc_bundle import read_records, resolve_revisits, write_bundles

URL_RULES = [parse_rule("block", "net/"), parse_rule("allow", "example.net/en/"), parse_rule("block", "example.com/de/"), parse_rule("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(fold("doc_id") != 0).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    index = write_bundles(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch.path("warc"), scratch)
    out = resolve_revisits(read_records(index), scratch)
    return out.select(F.col("id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner_product(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A repeated passage of over 50 words may be shorter than 400 bytes.
    out = repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=51)
    digest = [F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return out.select("doc_id", "n_bytes", "n_removed", *digest, (F.col("n_passages") > 0).cast("int").alias("repeats_passage"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return exact_dedup(docs, carry=["text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").isNotNull()
    lowered = leaf_digest("doc_id", "source", "lang", "n_chars", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    leaves = docs.select("doc_id", "lang", leaf_digest("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), F.when(changed, lowered).alias("tampered"))
    out = merkle_paths(leaves, "lang", ["doc_id"], carry=["doc_id", "tampered"])
    out = out.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"))).withColumn("proof_sha256", proof_digest())
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The contract's texts of op13: every tenth document repeats p of its words from word a on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    a, p = F.col("__g") % F.col("__n"), 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))
    chosen = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__words")).withColumn("__g", F.floor(h / 10))
    chosen = chosen.withColumn("__a", F.when(F.col("__n") > 0, a)).withColumn("__p", p)
    places = F.sequence(F.lit(0), F.col("__n") - 1)
    place = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")
    repeated = F.array_join(F.transform(places, lambda i: F.get("__words", place(i))), " ")
    return chosen.select("doc_id", F.when(F.col("__n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_period(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Runs are in the order of the ties, so the first of the greatest is the one that is asked for.
    greater = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), greater)
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM g
"""

OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS tok FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, s.sh
"""

#: As for op5, with shingles of four words.
OP11_SQL = (
    OP5_SQL.split("SELECT s.doc_id, CAST")[0].replace("len(ws) < 5", "len(ws) < 4").replace("len(ws) - 4", "len(ws) - 3").replace("i:i + 4", "i:i + 3")
    + """, c AS (SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id)) AS component_id
  FROM s LEFT JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, s.sh)
SELECT *, doc_id = component_id AS kept FROM c
"""
)

OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail
  FROM pages),
q AS (
  SELECT page_id,
         translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS rn
  FROM q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM q LEFT JOIN m ON q.page_id = m.page_id AND m.rn = 1
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: CRC-32 of an id as text; its polynomial is a fixed value.
CRC32_SQL = """CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(unicode(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS BIGINT)"""


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


_LOWERED_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD_SQL = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))

OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({_HEAD_SQL} || {_field_sql("text")}) AS leaf,
         CASE WHEN {CRC32_SQL} % 3 = 0 THEN sha256({_HEAD_SQL} || {_field_sql(_LOWERED_SQL)}) END AS tampered
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM d),
n AS (
  SELECT 0 AS level, tree, place, size, leaf AS digest FROM l
  UNION ALL
  SELECT level + 1, tree, place // 8, CAST(ceil(max(size) / 8) AS BIGINT), sha256(string_agg(digest, '' ORDER BY place)) FROM n WHERE size > 1 GROUP BY level, tree, place // 8),
u AS (SELECT tree AS lang_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM n WHERE size = 1),
t AS (
  SELECT 0 AS level, place, size, digest FROM u
  UNION ALL
  SELECT level + 1, place // 8, CAST(ceil(max(size) / 8) AS BIGINT), sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE size > 1 GROUP BY level, place // 8),
s AS (
  SELECT a.level, a.tree, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM n a JOIN n b ON a.level = b.level AND a.tree = b.tree AND a.place // 8 = b.place // 8 WHERE a.size > 1 GROUP BY a.level, a.tree, a.place),
st AS (
  SELECT a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM t a JOIN t b ON a.level = b.level AND a.place // 8 = b.place // 8 WHERE a.size > 1 GROUP BY a.level, a.place),
f AS (
  SELECT l.tree, l.place AS leaf_place, 0 AS level, l.place, coalesce(tampered, leaf) AS folded, '' AS proof FROM l
  UNION ALL
  SELECT f.tree, leaf_place, f.level + 1, f.place // 8, sha256(before || folded || after), proof || before || after
  FROM f JOIN s ON f.level = s.level AND f.tree = s.tree AND f.place = s.place),
ft AS (
  SELECT f.tree, leaf_place, 0 AS level, u.place, folded, proof FROM (SELECT tree, leaf_place, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM f GROUP BY tree, leaf_place) f JOIN u ON f.tree = u.lang_tree
  UNION ALL
  SELECT tree, leaf_place, ft.level + 1, ft.place // 8, sha256(before || folded || after), proof || before || after
  FROM ft JOIN st ON ft.level = st.level AND ft.place = st.place),
r AS (SELECT digest AS root FROM t WHERE size = 1)
SELECT doc_id, leaf, u.digest AS subroot, root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = root AS verified
FROM l JOIN u ON l.tree = u.lang_tree CROSS JOIN r
JOIN (SELECT tree, leaf_place, max_by(folded, level) AS folded, max_by(proof, level) AS proof FROM ft GROUP BY tree, leaf_place) g ON l.tree = g.tree AND l.place = g.leaf_place
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, {CRC32_SQL} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i, a, p FROM p),
r AS (
  SELECT w.doc_id, w.n, w.i, o.word FROM w JOIN w o ON w.doc_id = o.doc_id AND o.i = CASE WHEN w.i >= w.a THEN w.a + (w.i - w.a) % w.p ELSE w.i END),
e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
m AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM m GROUP BY doc_id),
z AS (SELECT x.* FROM m x WHERE NOT EXISTS (
  SELECT 1 FROM m y WHERE x.doc_id = y.doc_id AND (y.length * x.period > x.length * y.period
    OR (y.length * x.period = x.length * y.period AND (y.start < x.start OR (y.start = x.start AND y.period < x.period)))))),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM m),
c AS (SELECT r.doc_id, string_agg(word, ' ' ORDER BY r.i) AS collapsed FROM r LEFT JOIN x ON r.doc_id = x.doc_id AND r.i = x.i WHERE x.i IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, z.start, z.length, z.period, 1000 * z.length // z.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN z ON d.doc_id = z.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_line_dedup": op3_line_dedup,
        "op4_mixing": op4_mixing,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_topk": op6_topk,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_url_filter": op8_url_filter,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_packing": op10_packing,
        "op11_minhash": op11_minhash,
        "op12_merkle": op12_merkle,
        "op13_periodic": op13_periodic,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op6_topk": OP6_SQL, "op8_url_filter": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_minhash": OP11_SQL, "op12_merkle": OP12_SQL, "op13_periodic": OP13_SQL}
