import json
import os
import random
import subprocess
import sys
from collections import deque

import pytest
from pyspark.sql import functions as F

from crawlspark.operators.ranking import page_of, ranked
from crawlspark.plans.config import CrawlConfig
from crawlspark.plans.control import CrawlActive, CrawlControl
from crawlspark.plans.crawl import CrawlJob, crawl, next_pages
from crawlspark.storage import Buckets, Scratch, create_text, read_text, replace_text


def graph(spark):
    e = [("s", "a"), ("s", "b"), ("a", "c"), ("b", "c"), ("c", "s"), ("c", "d"), ("d", "e")]
    url = lambda x: f"https://{'o' if x == 'e' else 'h'}.x/{x}"
    edges = spark.createDataFrame([(url(a), url(b)) for a, b in e], "source string, target string")
    known = spark.createDataFrame([(url(x),) for x in "sabcde"], "href string")
    return spark.createDataFrame([(url("s"),)], "url string"), edges, known


def reached(df):
    return {r.url.rsplit("/", 1)[1]: r.depth for r in df.collect()}


def test_crawl(spark):
    g = graph(spark)
    assert reached(crawl(*g, CrawlConfig(crawl_mode="recursive"))) == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 3, "e": 4}
    assert reached(crawl(*g, CrawlConfig(crawl_mode="recursive", stay_on_hostname=True))) == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert reached(crawl(*g, CrawlConfig(crawl_mode="recursive", max_pages=2))) == {"s": 0, "a": 1}
    assert reached(crawl(*g, CrawlConfig(crawl_mode="recursive", filter_regex="/A$", filter_type="exclude"))) == {"s": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert reached(crawl(*g, CrawlConfig())) == {"s": 0}
    assert reached(crawl(*g, CrawlConfig(fetch_outbound=True))) == {"s": 0, "a": 1, "b": 1}
    texts = spark.createDataFrame([("https://h.x", "User-agent: *\nDisallow: /a\nDisallow: /b")], "origin string, text string")
    blocked = crawl(*g, CrawlConfig(crawl_mode="recursive"), robots=texts)
    assert reached(blocked) == {"s": 0, "a": 1, "b": 1} and blocked.where("not crawlable").count() == 2
    assert len(reached(crawl(*g, CrawlConfig(crawl_mode="recursive", respect_robots=False), robots=texts))) == 6


def test_crawl_goes_on(spark, tmp_path):
    job, config = CrawlJob(f"file://{tmp_path}/job"), CrawlConfig(crawl_mode="recursive")
    job.stop()
    assert reached(crawl(*graph(spark), config, job=job)) == {"s": 0}
    job.stopped = False
    assert len(reached(crawl(*graph(spark), config, job=job))) == 6
    with pytest.raises(ValueError):
        CrawlConfig(crawl_mode="sideways")


def test_crawl_recovers_from_its_levels(spark, tmp_path):
    config, path = CrawlConfig(crawl_mode="recursive"), f"file://{tmp_path}/job"
    assert len(reached(crawl(*graph(spark), config, job=CrawlJob(path), max_depth=1))) == 3
    half = tmp_path / "job" / "visited" / "round=2"
    half.mkdir()  # a round that was never finished
    (half / "part-00000-x_00000.c000.snappy.parquet").write_bytes(b"half a file")
    assert reached(crawl(*graph(spark), config, job=CrawlJob(path))) == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 3, "e": 4}


def random_graph(rng, n):
    """Links of each page, in order, without repetition."""
    return {f"https://h{i % 2}.x/{i}": [f"https://h{j % 2}.x/{j}" for j in rng.sample(range(n + 3), rng.randint(0, 4))] for i in range(n)}


def tables(spark, links, seed):
    e = [(s, t, p) for s, ts in links.items() for p, t in enumerate(ts)]
    edges = spark.createDataFrame(e, "source string, target string, pos int").repartition(5)
    return spark.createDataFrame([(seed,)], "url string"), edges, spark.createDataFrame([(x,) for x in links], "href string")


@pytest.mark.parametrize(("cap", "own_host", "known"), [(10**6, False, True), (17, False, False), (9, True, False), (1, False, True)])
def test_queue_order(spark, cap, own_host, known):
    links, seed = random_graph(random.Random(cap), 40), "https://h0.x/0"
    queue, seen, taken = deque([seed]), {seed}, []
    while queue and len(taken) < cap:
        url = queue.popleft()
        taken.append(url)
        for link in links.get(url, []):
            if link not in seen and (not own_host or link[:10] == url[:10]) and (not known or link in links):
                seen.add(link)
                queue.append(link)
    config = CrawlConfig(crawl_mode="recursive", order="queue", max_pages=cap, stay_on_hostname=own_host, known_only=known)
    got = crawl(*tables(spark, links, seed), config).orderBy("rank").collect()
    assert [r.url for r in got] == taken and [r.rank for r in got] == list(range(len(taken)))


def test_attempts(spark):
    rng = random.Random(8)
    links = random_graph(rng, 40)
    need = {url: rng.choice([1, 1, 1, 2, 3, 4, None]) for url in links}  # None: no answer at all
    need["https://h0.x/0"] = 2
    log = [(u, a, 200 if a >= n else 503, a >= n) for u, n in need.items() if n for a in range(1, 6)]
    answers = spark.createDataFrame(log, "url string, attempt int, status int, ok boolean")
    now, again, last, depth, rounds = ["https://h0.x/0"], [], {}, {"https://h0.x/0": 0}, 0
    while now or again:
        asked = [(u, 1) for u in now] + again
        again, found = [], {}
        for url, attempt in asked:
            n = need[url]
            ok = None if n is None else attempt >= n
            last[url] = (depth[url], attempt, ok)
            if ok:
                for t in links[url]:
                    if t in links and t not in depth:
                        found[t] = min(found.get(t, 99), depth[url] + 1)
            elif ok is False and attempt < 3:
                again.append((url, attempt + 1))
        depth |= found
        now, rounds = list(found), rounds + 1
    out = crawl(*tables(spark, links, "https://h0.x/0"), CrawlConfig(crawl_mode="recursive", max_retries=3), answers=answers)
    assert {r.url: (r.depth, r.attempt, r.ok) for r in out.collect()} == last
    listed = crawl(*tables(spark, links, "https://h0.x/0"), CrawlConfig(max_retries=3), answers=answers).collect()
    assert [(r.url, r.attempt, r.ok) for r in listed] == [("https://h0.x/0", 2, True)]


def test_a_round_does_not_shuffle_the_graph(spark, tmp_path):
    links = random_graph(random.Random(1), 30)
    _, edges, _ = tables(spark, links, "https://h0.x/0")
    graph = Buckets(spark, f"file://{tmp_path}/graph", "source string, url string", "source", 4)
    graph.append(edges.select("source", F.col("target").alias("url")))
    visited = Buckets(spark, f"file://{tmp_path}/visited", "url string, depth int, rank long, round int", "url", 4, parts="round")
    visited.append(edges.select("source").distinct().limit(5).selectExpr("source as url", "0 as depth", "cast(null as long) as rank", "0 as round"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = next_pages(graph.table(), visited.table().where("round = 0"), visited)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(url" in plan and "BroadcastExchange" not in plan
    graph.close()
    visited.close()


@pytest.mark.parametrize(("per_bucket", "buckets"), [(100_000, 1), (10, None)])
def test_buckets_follow_the_size_of_the_crawl(spark, tmp_path, monkeypatch, per_bucket, buckets):
    """Neither the session's partitions nor those of a job that goes on say how many files a round opens."""
    links, seed = random_graph(random.Random(3), 60), "https://h0.x/0"
    depth, now = {seed: 0}, [seed]
    while now:
        found = {t for s in now for t in links[s] if t in links and t not in depth}
        depth |= dict.fromkeys(found, depth[now[0]] + 1)
        now = list(found)
    links[seed] = [*links[seed], seed]
    followed = len({(s, t) for s, ts in links.items() for t in ts if t in links and t != s})
    config, path = CrawlConfig(crawl_mode="recursive", max_pages=10**9), tmp_path / "job"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    monkeypatch.setattr("crawlspark.plans.crawl.ROWS_PER_BUCKET", per_bucket)
    try:
        assert len(crawl(*tables(spark, links, seed), config, job=CrawlJob(f"file://{path}"), max_depth=1).collect()) == sum(d <= 1 for d in depth.values())
        monkeypatch.setattr("crawlspark.plans.crawl.ROWS_PER_BUCKET", 7)
        out = crawl(*tables(spark, links, seed), config, job=CrawlJob(f"file://{path}")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.url: r.depth for r in out} == depth and len(out) == len(depth)
    wanted = buckets or -(-followed // 10)
    assert json.loads((path / "job.json").read_text())["buckets"] == wanted
    assert all(len(list(p.glob("*.parquet"))) <= wanted for p in (path / "visited").iterdir() if p.is_dir())


def test_links_are_filtered_before_they_are_made_distinct(spark, monkeypatch):
    """Links that lead out of the snapshot aren't shuffled twice; a link that is given twice counts once."""
    plans, save = [], Scratch.save

    def seen(self, df, name):
        if name == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = save(self, df, name)
        if name == "links":
            assert sorted(tuple(x.rsplit("/", 1)[1] for x in r) for r in out.select("source", "url").collect()) == [("a", "c"), ("b", "c"), ("c", "d"), ("c", "s"), ("s", "a"), ("s", "b")]
        return out

    monkeypatch.setattr(Scratch, "save", seen)
    seeds, edges, known = graph(spark)
    more = edges.union(edges).union(spark.createDataFrame([("https://h.x/s", "https://h.x/out")], edges.schema))
    assert reached(crawl(seeds, more, known, CrawlConfig(crawl_mode="recursive", filter_regex="/E$", filter_type="exclude"))) == {"s": 0, "a": 1, "b": 1, "c": 2, "d": 3}
    assert len(plans) == 1 and plans[0].index("Aggregate") < plans[0].index("LeftSemi")


def test_ranks_and_pages(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "k long, v string").repartition(6)
    got = ranked(rows, ["k"], Scratch(spark), start=5).orderBy("rank").collect()
    assert [(r.k, r["rank"]) for r in got] == [(i, i + 5) for i in range(1000)]
    page = page_of(rows, [F.desc("k")], 7, 100, Scratch(spark))
    assert [r.k for r in page.collect()] == list(range(399, 299, -1)) and page_of(rows, ["k"], 12, 100, Scratch(spark)).count() == 0
    assert "PushedFilters: [" in (plan := page._jdf.queryExecution().executedPlan().toString()) and "GreaterThanOrEqual(__at" in plan
    assert ranked(rows.limit(0), ["k"], Scratch(spark)).count() == 0


def test_small_files(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    assert read_text(spark, path) is None and create_text(spark, path, "one") and not create_text(spark, path, "two")
    replace_text(spark, path, "drei ü")
    assert read_text(spark, path) == "drei ü" and [p.name for p in tmp_path.glob("*.json")] == ["x.json"]


OTHER_PROCESS = """
import json, sys
from pyspark.sql import SparkSession
from crawlspark.plans.control import CrawlActive, CrawlControl
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
control = CrawlControl(spark, sys.argv[1])
try:
    control.start("second")
    refused = False
except CrawlActive:
    refused = True
before = control.state()
control.tell("stop")
print(json.dumps([refused, before]))
"""


def test_orders_from_another_process(spark, tmp_path):
    root = f"file://{tmp_path}/control"
    control = CrawlControl(spark, root, poll_seconds=0.05)
    assert control.state()["status"] == "idle"
    with pytest.raises(RuntimeError):
        control.tell("stop")
    control.start("first")
    with pytest.raises(CrawlActive):
        CrawlControl(spark, root).start("again")
    control.tell("pause")
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")}
    out = subprocess.run([sys.executable, "-c", OTHER_PROCESS, root], capture_output=True, text=True, timeout=120, env=env, check=True)
    refused, before = json.loads(out.stdout.strip().splitlines()[-1])
    assert refused and before["status"] == "running" and before["crawl_id"] == "first"
    done = crawl(*graph(spark), CrawlConfig(crawl_mode="recursive"), job=CrawlJob(control=control))
    assert reached(done) == {"s": 0}  # it was told to stop before the second round
    assert control.state() == {"crawl_id": "first", "status": "stopped", "crawled": 1, "levels": 1}
    other = CrawlControl(spark, root)
    other.start("next")
    assert reached(crawl(*graph(spark), CrawlConfig(crawl_mode="recursive"), job=CrawlJob(control=other)))["e"] == 4
    assert other.state() == {"crawl_id": "next", "status": "done", "crawled": 6, "levels": 6}
    control.start("lost")
    CrawlControl(spark, root).start("taken over", takeover=True)
    assert not control.goes_on(0, 0)
