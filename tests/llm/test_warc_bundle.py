import hashlib

from crawlspark.llm import warc_bundle
from crawlspark.llm.queries import op2_warc
from crawlspark.llm.scratch import Scratch
from crawlspark.llm.warc_bundle import BundleReader, parse_record, read_records, resolve_revisits, write_bundles

BIG = "<p>" + "payload é " * 200
ROWS = [(1, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (3, "http://c/", "small"), (4, "http://d/", "small"), (5, "http://e/\r\nX: y", None), (6, None, ""), (7, "u", "z" * 3_000_000), (8, "u", "WARC/1.1\r\n\r\n" * 100)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark):
    scratch = Scratch(spark)
    index = write_bundles(table(spark, ROWS + [(9, None, BIG)]), scratch.path("warc"), scratch, frame_bytes=4000, bundle_bytes=20_000)
    back = read_records(index).collect()
    html = {i: (h or "").encode() for i, _, h in ROWS}
    assert len(back) == 10
    for r in back:
        if r.id in (1, 2):
            assert r.type == "revisit" and r.refers_to == 9 and bytes(r.payload) == b""
        else:
            assert r.type == "response" and r.refers_to is None and bytes(r.payload) == html[r.id]
        assert r.digest == hashlib.sha1(html[r.id]).hexdigest()
    facts = {r.id: r for r in resolve_revisits(read_records(index), scratch).collect()}
    assert all(facts[i].n_bytes == len(html[i]) and facts[i].digest == hashlib.sha1(html[i]).hexdigest() for i in html)

    # One record by its place in the index, and the whole bundle by its seek table.
    row = index.where("id = 8").first()
    reader = BundleReader(row.bundle)
    headers, payload = reader.record(row.frame, row.offset)
    assert headers["X-Page-Id"] == "8" and payload == html[8]
    data, at, seen = b"".join(reader.frame(k) for k in range(len(reader.frames))), 0, 0
    while at < len(data):
        _, _, at = parse_record(data, at)
        seen += 1
    assert seen == index.where(index.bundle == row.bundle).count()


def test_rows_without_id(spark):
    scratch = Scratch(spark)
    index = write_bundles(table(spark, [(None, "u", BIG), (None, "v", BIG), (1, "w", BIG)]), scratch.path("warc"), scratch)
    facts = resolve_revisits(read_records(index), scratch).collect()
    assert sorted((str(r.id), r.type, r.n_bytes) for r in facts) == [(i, "response", len(BIG.encode())) for i in ("1", "None", "None")]


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert op2_warc(spark, str(tmp_path)).collect() == []


def test_a_second_attempt_of_a_task_leaves_the_first_alone(tmp_path):
    first, second = (warc_bundle.BundleWriter(f"file://{tmp_path}", 3, 1000, 10_000) for _ in range(2))
    rows = []
    for writer, ids in ((first, (1, 2)), (second, (2, 1))):
        for i in ids:
            rows += writer.add(i, warc_bundle.make_record(i, f"http://h/{i}", b"x" * i, f"{i}" * 40, None))
        rows += writer.end()
    assert len({bundle for _, bundle, *_ in rows}) == 2
    for i, bundle, frame, offset, _ in rows:
        reader = warc_bundle.BundleReader(bundle)
        assert reader.record(frame, offset)[1] == b"x" * i
        reader.close()
