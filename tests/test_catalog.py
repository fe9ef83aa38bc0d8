import random
import zipfile

import pytest
from pyspark.sql import functions as F

from crawlspark import catalog, zip_export
from crawlspark.storage import children


def test_a_save_replaces_a_crawl_at_once(spark, tmp_path):
    saved = catalog.Catalog(spark, f"file://{tmp_path}/c")
    assert saved.list().count() == 0
    saved.save("1", "old", spark.range(5).toDF("x"))
    reading = saved.load("1")
    saved.save("1", "new", spark.range(7).toDF("x"))
    assert reading.count() == 5 and saved.load("1").count() == 7
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("x"))
    with pytest.raises(Exception, match="no"):
        saved.save("1", "broken", broken)
    assert saved.load("1").count() == 7 and [tuple(r) for r in saved.list().collect()] == [("1", "new")]
    saved.save("1", "newest", spark.range(2).toDF("x"))
    assert len(children(spark, f"{saved.root}/crawls/1")) == 2  # this version and the one before
    for bad in ("", "a/b", "../x"):
        with pytest.raises(ValueError):
            saved.save(bad, "n", spark.range(1))
    for absent in (saved.load, lambda i: saved.rename(i, "n")):
        with pytest.raises(KeyError):
            absent("9")


def records(spark, rows):
    return spark.createDataFrame([(h, True, x, t) for h, x, t in rows], "href string, fetch_ok boolean, html string, t int")


def test_archive(spark, tmp_path):
    root, pages = f"file://{tmp_path}/a", [(f"https://h.x/{i}", f"<p>{i}", 0) for i in range(50)]
    catalog.write_archive(records(spark, [*pages, ("http://h.x/7", "later", 1), ("https://h.x/e", "", 0), ("https://h.x/n", None, 0)]), root, "9", order=["t"], folders=8)
    assert catalog.read_archive(spark, root, "9").count() == 50
    one = catalog.read_page(spark, root, "9", "h.x_7.html")
    assert [(r.href, r.html, r.length) for r in one.collect()] == [("http://h.x/7", "later", 5)]
    assert len(one.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(folder" in one._jdf.queryExecution().executedPlan().toString()
    assert catalog.read_page(spark, root, "9", "gone.html").count() == 0
    catalog.write_archive(records(spark, pages[:3]), root, "10")
    assert {(r.id, r.files, r.bytes) for r in catalog.archive_stats(catalog.scan_archive(spark, root)).collect()} == {("9", 50, 49 * 5 - 10 + 5 + 1), ("10", 3, 12)}
    assert catalog.scan_archive(spark, f"{root}/none").count() == 0


@pytest.mark.parametrize("zip64_from", [zip_export.FULL, 1000])
def test_zip(spark, tmp_path, zip64_from):
    rng = random.Random(3)
    files = {f"f{i}_é.html": bytes(rng.randrange(32, 90) for _ in range(rng.randrange(0, 900))) for i in range(60)} | {"empty": b"", "long": b"x" * 2_000_000}
    rows = spark.createDataFrame([(k, v.decode()) for k, v in files.items()] + [(None, "no name")], "path string, html string").repartition(5)
    path = f"file://{tmp_path}/out.zip"
    pieces = zip_export.write_zip_pieces(rows, f"file://{tmp_path}/pieces", zip64_from=zip64_from)
    assert len(pieces) > 5
    zip_export.join_pieces(spark, pieces, path)
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == files
    got = zip_export.read_zip(spark, path, tasks=3).collect()
    assert {r.path: bytes(r.data) for r in got} == files and len(got) == len(files)


def test_empty_zip_and_many_members(spark, tmp_path):
    none = spark.createDataFrame([], "path string, html string")
    catalog.export_zip(none, f"file://{tmp_path}/none.zip")
    assert zipfile.ZipFile(tmp_path / "none.zip").namelist() == []
    many = spark.range(70_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("html"))
    catalog.export_zip(many, f"file://{tmp_path}/many.zip")
    with zipfile.ZipFile(tmp_path / "many.zip") as z:
        assert len(z.namelist()) == 70_000 and z.read("n69999") == b"x"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["many.zip", "none.zip"]
