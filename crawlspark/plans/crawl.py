"""The crawl loop over a snapshot: breadth first, one round at a time, each round a written part of a bucketed table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import robots as robots_txt
from ..operators.ranking import ranked
from ..sources.seeds import regex_filter
from ..storage import Buckets, Scratch, children, delete, read_text, replace_text
from .config import CrawlConfig
from .control import CrawlControl

VISITED = "url string, depth int, crawlable boolean, is_outbound boolean, rank long, attempt int, status int, ok boolean"
_COLUMNS = [c.split()[0] for c in VISITED.split(", ")] + ["round"]
#: Rows of the graph, or seeds, that a bucket is made for. A round opens a file of every earlier round in every bucket, so
#: their number follows the crawl's size.
ROWS_PER_BUCKET = 100_000


class CrawlJob:
    """A crawl's visited pages, in buckets by URL and parts by round; ``stop`` ends it after the round at hand.

    With a ``path`` in a shared store, a new job over the same path, in another process, goes on from the rounds that
    were written whole; ``job.json`` names them, so what a broken round has left is deleted. A ``control`` takes orders
    from other processes between rounds.
    """

    def __init__(self, path: str | None = None, control: CrawlControl | None = None):
        self.path, self.control, self.stopped = path, control, False
        self.rounds = 0
        self.visited: Buckets | None = None

    def stop(self) -> None:
        self.stopped = True

    def recall(self, spark: SparkSession, scratch: Scratch) -> None:
        """Reads what an earlier job has recorded."""
        self._folder = self.path.rstrip("/") if self.path else scratch.path("job")
        self._record = f"{self._folder}/job.json"
        known = json.loads(read_text(spark, self._record) or "{}")
        self.rounds, self._buckets = known.get("rounds", 0), known.get("buckets")

    def open(self, spark: SparkSession, rows: int) -> None:
        """Opens the visited pages: in the recorded number of buckets, or else in as many as a crawl of ``rows`` links and seeds needs."""
        for part in children(spark, f"{self._folder}/visited"):
            if part.startswith("round=") and int(part.removeprefix("round=")) >= self.rounds:
                delete(spark, f"{self._folder}/visited/{part}")
        n = self._buckets or -(-max(rows, 1) // ROWS_PER_BUCKET)
        self.visited = Buckets(spark, f"{self._folder}/visited", f"{VISITED}, round int", "url", n, parts="round")

    def add(self, rows: DataFrame) -> tuple[int, int]:
        """Writes the next round, which ``commit`` ends; says how many rows it has, and how many of them are new pages."""
        self.visited.append(rows.withColumn("round", F.lit(self.rounds)).select(*_COLUMNS))
        counts = self.visited.table().where(F.col("round") == self.rounds).agg(F.count(F.lit(1)), F.count(F.when(F.col("attempt") == 1, 1))).first()
        return counts[0], counts[1]

    def take_back(self) -> None:
        """Drops the round that was added, but not committed."""
        self.visited.drop_part(f"round={self.rounds}")

    def commit(self) -> None:
        self.rounds += 1
        if self.path:
            replace_text(self.visited.spark, self._record, json.dumps({"rounds": self.rounds, "buckets": self.visited.n}))

    def taken(self) -> int:
        return self.visited.table().where("attempt = 1").count()


def answers_by_url(answers: DataFrame, max_retries: int) -> DataFrame:
    """(url, attempt from 1, status, ok) -> (url, answers): a map from attempt to answer, as many as a crawl asks for."""
    asked = answers.where(F.col("attempt").between(1, max(1, max_retries)))
    one = asked.groupBy("url", "attempt").agg(F.max(F.struct("status", "ok")).alias("a"))
    return one.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("attempt", "a"))).alias("answers"))


def crawl(
    seeds: DataFrame, edges: DataFrame, known: DataFrame, config: CrawlConfig, robots: DataFrame | None = None, bot: str = "Googlebot", job: CrawlJob | None = None,
    max_depth: int | None = None, answers: DataFrame | None = None,
) -> DataFrame:
    """(url, depth, crawlable, is_outbound, rank, attempt, status, ok) of the pages that a crawl takes.

    seeds: (url); edges: (source, target, and pos for ``order='queue'``) of the pages whose links are followed; known:
    (href) of the snapshot; robots: (origin, text); answers: (url, attempt, status, ok).

    * Order. With ``order='url'`` depth is the least number of links and the cap takes pages by (depth, url). With
      ``order='queue'`` pages come first in, first out: within a round by the place of the page that found them first,
      then by the place of the link in it; ``rank`` is the place in the queue, and the cap takes the first of it.
    * Attempts. With ``answers`` a page that was answered, but not well, is asked again in the next round, while it was
      asked fewer than ``max_retries`` times; links are followed once it is ok. A page without an answer for an attempt
      failed to be fetched and isn't asked again. Rounds are no depths then: a page's depth is that of the page that
      found it in the earliest round (of several, the least) plus one. Without ``answers`` all pages count as fetched.
    * Seeds keep no order of their own: they are ranked by URL.

    The graph (by source), the visited pages and the answers (by URL) lie in as many buckets, so a round joins them
    bucket by bucket: what it shuffles is the links of the frontier, never the graph, and nothing goes to the driver but
    counts. How many buckets there are follows the number of links and seeds, not the session's number of partitions.
    """
    spark = seeds.sparkSession
    job, scratch = job or CrawlJob(), Scratch(spark)
    job.recall(spark, scratch)
    opened: list[Buckets] = []
    queued, capped = config.order == "queue", config.crawl_mode == "recursive"

    def in_buckets(rows: DataFrame, name: str, by: str) -> DataFrame:
        table = Buckets(spark, scratch.path(name), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes), by, visited.n)
        opened.append(table)
        table.append(rows)
        return table.table()

    def admitted(found: DataFrame) -> DataFrame:
        """Filters that need no join come first."""
        if capped and config.stay_on_hostname:
            found = found.where(urls.host(F.col("url")) == urls.host(F.col("source")))
        found = regex_filter(found, config.filter_regex, config.filter_type, on_invalid=config.on_invalid)
        return found.join(known.select(F.col("href").alias("url")).hint("merge"), "url", "left_semi") if config.known_only else found

    def add(new: DataFrame, again: DataFrame | None, left: int | None) -> tuple[int, int]:
        """Writes a round: new (url, depth, and its key in queued order), capped and ranked, and pages that are asked again."""
        if queued:
            new = ranked(new, ["key"], scratch, start=taken)
            new = new.where(F.col("rank") < taken + left) if left is not None else new
        n, fresh = write(new, again)
        if left is not None and fresh > left:  # only a round that has to be cut is ranked by URL
            found = scratch.save(visited.table().where((F.col("round") == job.rounds) & (F.col("attempt") == 1)).select("url", "depth"), "uncut")
            job.take_back()
            n, fresh = write(ranked(found, ["url"], scratch).where(F.col("rank") < left), again)
        job.commit()
        return n, fresh

    def write(new: DataFrame, again: DataFrame | None) -> tuple[int, int]:
        new = new.select("url", "depth", (F.col("rank") if queued else F.lit(None).cast("long")).alias("rank"))
        if robots is None:
            new = new.withColumn("crawlable", F.lit(None).cast("boolean"))
        else:
            new = robots_txt.allowed_by(new, rules).withColumnRenamed("allowed", "crawlable")
        outbound = F.lit(True if job.rounds and not capped else None).cast("boolean")
        rows = new.withColumns({"is_outbound": outbound, "attempt": F.lit(1)})
        if again is not None:
            rows = rows.unionByName(again)
        if answered is None:
            return job.add(rows.withColumns({"status": F.lit(None).cast("int"), "ok": F.lit(None).cast("boolean")}))
        asked = rows.repartition(visited.n, "url").join(answered, "url", "left")
        answer = F.when(_fetched(config), F.try_element_at("answers", F.col("attempt")))
        return job.add(asked.withColumns({"status": answer["status"].cast("int"), "ok": answer["ok"]}))

    try:
        first = links = None
        if not job.rounds:
            first = seeds.select("url").distinct()
            if config.crawl_mode == "list":
                first = regex_filter(first, config.filter_regex, config.filter_type, on_invalid=config.on_invalid)
            if config.known_only:
                first = first.join(known.select(F.col("href").alias("url")), "url", "left_semi")
            first = scratch.save(first, "seeds")
        expands = capped or config.fetch_outbound
        if expands:
            links = edges.select("source", F.col("target").alias("url"), *(["pos"] if queued else [])).where("source <> url")  # a page that is followed was visited
            links = admitted(links)  # most links lead out of the snapshot: only what is left is made distinct
            links = scratch.save(links if queued else links.distinct(), "links")
        job.open(spark, max([0, *[table.count() for table in (first, links) if table is not None]]))
        visited = job.visited
        opened.append(visited)
        rules = None if robots is None else scratch.save(robots_txt.rules_by_origin(robots, bot), "rules")  # read in every round
        answered = None if answers is None else in_buckets(answers_by_url(answers, config.max_retries), "answers", "url")
        taken = job.taken() if job.rounds else 0
        n = 1
        if first is not None:
            n, taken = add(first.select("url", F.lit(0).alias("depth"), *([F.col("url").alias("key")] if queued else [])), None, config.max_pages if capped else None)
        if expands:
            graph = in_buckets(links, "graph", "source")
            scratch.drop(links)
        while n and not job.stopped and (max_depth is None or job.rounds <= max_depth):
            if job.control and not job.control.goes_on(taken, job.rounds):
                break
            last = visited.table().where(F.col("round") == job.rounds - 1)
            again = None
            if answers is not None:
                again = last.where((F.col("ok") == F.lit(False)) & (F.col("attempt") < config.max_retries))
                again = again.select("url", "depth", "rank", "crawlable", "is_outbound", (F.col("attempt") + 1).alias("attempt"))
            # Links of listed pages are fetched, but not followed.
            follows = expands and (not capped or taken < config.max_pages)
            if not follows and again is None:
                break
            left = max(config.max_pages - taken, 0) if capped else None
            sources = last.where(F.coalesce("ok", F.lit(True)) if answers is None else F.col("ok")).where(_fetched(config) & (F.lit(capped) | F.col("is_outbound").isNull()))
            if follows:
                new = next_pages(graph, sources, visited, queued)
            else:
                new = spark.createDataFrame([], "url string, depth int, key string")
            n, fresh = add(new, again, left)
            taken += fresh
        if job.control:
            job.control.finish(taken, job.rounds)
        out = visited.files()
        if answers is not None:  # what the last attempt gave
            row = F.struct(*[c for c in _COLUMNS if c not in ("url", "round")])
            out = scratch.save(visited.table().groupBy("url").agg(F.max_by(row, "attempt").alias("r")).select("url", "r.*"), "last")
        return out.drop("round")
    finally:
        for table in opened:
            table.close()


def _fetched(config: CrawlConfig):
    """Pages that robots.txt forbids are recorded, but not fetched."""
    return ~F.col("crawlable").eqNullSafe(F.lit(False)) if config.respect_robots else F.lit(True)


def next_pages(graph: DataFrame, sources: DataFrame, visited: Buckets, queued: bool = False) -> DataFrame:
    """(url, depth, and key in queued order) of the pages that the sources link to and that weren't visited."""
    frontier = sources.select(F.col("url").alias("source"), "depth", "rank").hint("shuffle_hash")
    met = graph.join(frontier, "source").repartition(visited.n, "url")
    if queued:
        found = met.groupBy("url").agg(F.min(F.struct("rank", "pos", "depth")).alias("key"))
        found = found.select("url", (F.col("key.depth") + 1).alias("depth"), "key")
    else:
        found = met.groupBy("url").agg((F.min("depth") + 1).alias("depth"))
    return found.join(visited.table().select("url").hint("merge"), "url", "left_anti")  # grows with the crawl: never broadcast
