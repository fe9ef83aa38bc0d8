"""The second round's rows are compared slice by slice: the same groups, and no table of bitmaps or texts is left behind."""

from pathlib import Path

from crawlspark.llm import jaccard_join
from crawlspark.storage import shared_dir


def test_slices_leave_no_bitmaps(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    root = Path(shared_dir(spark).removeprefix("file://"))
    once = sorted(tuple(r) for r in jaccard_join.near_duplicates(docs).collect())
    monkeypatch.setattr(jaccard_join, "SLICE", 0.2)
    before = set(root.glob("scratch-*"))
    out = jaccard_join.near_duplicates(docs)
    (folder,) = set(root.glob("scratch-*")) - before
    left = {p.name.split("-", 1)[1] for p in folder.iterdir()}
    assert left.isdisjoint({"rows", "nodes", "texts", "pairs", "slice", "dealt"}) and sorted(tuple(r) for r in out.collect()) == once
    assert sum(p.name.endswith("-least") for p in folder.iterdir()) > 0
