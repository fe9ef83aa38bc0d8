import corpus_pipeline
from crawlspark.llm import toxicity

CLEAN = "rivers run along green fields where small birds sing every morning in the month of may and children play".split()


def rows():
    out = []
    for i in range(60):
        words = [CLEAN[(i * 7 + k * (i % 5 + 1) + k * k) % len(CLEAN)] + str((i * 31 + k) % 97) for k in range(50)]
        out.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    out += [(100 + i, " ".join([*out[i][1].split(), "one", "more"]), "en", "s1", 0) for i in range(5)]  # near copies
    out += [(200 + i, f"vilexx scumzz {CLEAN[i % 9]} vilexx {i}", "en", "s2", 0) for i in range(20)]
    out += [(300 + i, f"{CLEAN[i]} own {i} text\nThis very long line stands in a good many of the documents", "en", None, 9) for i in range(6)]
    return out + [(400, None, None, None, None), (401, "", "en", "s0", 0)]


def write(spark, path, data):
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", __import__("pyspark").sql.functions.lit("own")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 300)) for i, *_ in data], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    write(spark, tmp_path, rows())
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    assert set(ids["toxicity"]) == {i for i, *_ in rows() if not 200 <= i < 300}
    texts = {r.doc_id: r for r in kept["line_dedup"]}
    assert all("\n" not in texts[300 + i].text and texts[300 + i].n_chars == len(texts[300 + i].text) for i in range(5)) and "\n" in texts[305].text
    assert set(ids["jaccard_join"]) == set(ids["line_dedup"]) - {100, 101, 102, 103, 104} and {r.score for r in kept["mixing"]} == {"own"}
    words = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert abs(words(kept["mixing"]) - words(kept["jaccard_join"])) < 200
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 3
    assert {(r.doc_id) for r in kept["packing"]} == set(ids["mixing"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids_crc32").collect())) == sorted(str(r) for r in docs.select("doc_id", "start", "ids_crc32").collect())


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_labels_stay_out_of_the_score(spark):
    """The model only sees hashed n-grams of texts."""
    assert set(toxicity.Model._fields) == {"buckets", "weights", "intercept"}


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_repeated_ids_near_duplicates(spark, tmp_path):
    clean = [r[1] for r in rows()]
    near = clean[0] + " one more"
    data = [(i, clean[i], "en", "s", 0) for i in range(3)]
    data += [(1, clean[1], "en", "s", 0)] * 3 + [(2, clean[2], "de", "s", 0)]  # rows repeated, one with another column
    data += [(7, near, "en", "s", 0), (7, clean[9], "en", "s", 0)]  # one id, a near copy and a clean text
    data += [(8, "", "en", "s", 0)] * 2 + [(None, clean[0], "en", "s", 0)] * 2
    data += [(9, clean[20] + " one more", "en", "s", 0), (9, clean[20], "en", "s", 0)]  # near copies of one id
    out = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.one_of_near_duplicates(spark, table(spark, data), str(tmp_path)).collect()), key=str)
    of_nine = [r for r in out if r[0] == 9]
    assert len(of_nine) == 1 and of_nine[0][1].startswith(clean[20])
    want = [(0, clean[0], "en"), (1, clean[1], "en"), (2, clean[2], "de"), (7, clean[9], "en"), (8, "", "en"), (8, "", "en"), (None, clean[0], "en"), (None, clean[0], "en")]
    assert sorted([r for r in out if r[0] != 9], key=str) == sorted(want, key=str)


def test_repeated_ids_mixing(spark, tmp_path):
    from crawlspark.llm import mixing

    data = [(i % 4, " ".join(f"w{i}x{k}" for k in range(1 + i % 9)), "en", f"s{i % 3}", 0) for i in range(90)] + [(5, "a b c", "en", "s0", 0)] * 5 + [(None, "d e", "en", "s1", 0)] * 4
    docs = table(spark, data)
    want = sum(r.taken for r in mixing.mix_sources(docs.select("doc_id", "text", "source")).collect())
    out = corpus_pipeline.mixed(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in out.collect()) == want
