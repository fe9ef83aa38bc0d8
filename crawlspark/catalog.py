"""Saved crawls, HTML archives and exports."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import format_bytes, percent
from .functions.urls import to_filename
from .operators.results import COLUMNS
from .storage import children, delete, read_text, replace_text
from .zip_export import join_pieces, write_zip_pieces

ARCHIVE = "path string, href string, html string, length long, folder int"


class Catalog:
    """Saved crawls below one folder.

    A save writes a new version of the crawl and then puts its entry in place by one rename, so a reader finds the old
    crawl or the new one, and a save that fails changes nothing. The version before stays for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entry_path(self, id_: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", id_):
            raise ValueError(f"id is {id_!r}")
        return f"{self.root}/meta/{id_}.json"

    def entry(self, id_: str) -> dict | None:
        text = read_text(self.spark, self._entry_path(id_))
        return json.loads(text) if text else None

    def _commit(self, entry: dict) -> None:
        replace_text(self.spark, self._entry_path(entry["id"]), json.dumps(entry))

    def save(self, id_: str, name: str, results: DataFrame) -> None:
        old, folder = self.entry(id_), f"{self.root}/crawls/{id_}"
        version = f"v-{uuid.uuid4().hex}"
        results.drop("crawl_id").write.parquet(f"{folder}/{version}")
        self._commit({"id": id_, "name": name, "version": version})
        for left in children(self.spark, folder):
            if left not in (version, (old or {}).get("version")):
                delete(self.spark, f"{folder}/{left}")

    def rename(self, id_: str, name: str) -> None:
        entry = self.entry(id_)
        if entry is None:
            raise KeyError(id_)
        self._commit({**entry, "name": name})

    def list(self) -> DataFrame:
        """(id, name) of the committed crawls."""
        names = [f"{self.root}/meta/{n}" for n in children(self.spark, f"{self.root}/meta") if n.endswith(".json")]
        if not names:
            return self.spark.createDataFrame([], "id string, name string")
        return self.spark.read.schema("id string, name string").json(names)

    def load(self, id_: str) -> DataFrame:
        """The crawl that is committed now, with its crawl_id."""
        entry = self.entry(id_)
        if entry is None:
            raise KeyError(id_)
        return self.spark.read.parquet(f"{self.root}/crawls/{id_}/{entry['version']}").withColumn("crawl_id", F.lit(id_))

    def delete(self, id_: str) -> None:
        delete(self.spark, self._entry_path(id_))
        delete(self.spark, f"{self.root}/crawls/{id_}")


def manager_view(meta: DataFrame, archive_stats: DataFrame) -> DataFrame:
    """(id, name, orphan, files, size, actions): crawls and archive folders; folders without a crawl are orphans, at the end."""
    joined = meta.join(archive_stats, "id", "full_outer")
    orphan = F.col("name").isNull()
    actions = F.when(orphan, "delete files").when(F.col("files").isNull(), "rename, delete").otherwise("rename, export, delete files, delete both")
    out = joined.select("id", "name", orphan.alias("orphan"), "files", F.col("bytes"), format_bytes(F.coalesce("bytes", F.lit(0))).alias("size"), actions.alias("actions"))
    return out.orderBy("orphan", F.desc("id"))


def archive(records: DataFrame) -> DataFrame:
    """(path, href, html) of the pages that were fetched with success and aren't empty."""
    return records.where(F.col("fetch_ok") & (F.col("html") != "")).select(to_filename(F.col("href")).alias("path"), "href", "html")


def archive_stats(files: DataFrame) -> DataFrame:
    """(id, path, length) -> files and bytes per folder."""
    return files.groupBy("id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def scan_archive(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, length) of the pages in the archives root/crawl-<id>; their contents are not read."""
    folders = [n for n in children(spark, root) if n.startswith("crawl-")]
    if not folders:
        return spark.createDataFrame([], "id string, path string, length long")
    files = spark.read.schema("path string, length long").option("recursiveFileLookup", True).parquet(*[f"{root}/{n}" for n in folders])
    return files.select(F.regexp_extract("_metadata.file_path", r"/crawl-([^/]+)/[^/]*/[^/]*$", 1).alias("id"), "path", "length")


def storage_estimate(files: DataFrame, quota: int) -> DataFrame:
    used = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("used"))
    return used.select("used", F.lit(quota).alias("quota"), percent(F.col("used"), F.lit(quota)).alias("percent"))


def _folder_of(path: Column, folders: int) -> Column:
    return F.pmod(F.hash(path), F.lit(folders)).alias("folder")


def write_archive(pages: DataFrame, root: str, crawl_id: str, order: Sequence[str] = (), folders: int = 64) -> None:
    """Pages (records) as an archive in folders by a hash of the file name, sorted by it.

    Of pages with the same file name the last by ``order`` stays (then by URL), as if each had been written over the one before.
    """
    stored = pages.where(F.col("fetch_ok") & (F.col("html") != "")).withColumn("path", to_filename(F.col("href")))
    last = stored.groupBy("path").agg(F.max_by(F.struct("href", "html"), F.struct(*order, "href")).alias("r"))
    rows = last.select("path", "r.*", F.octet_length("r.html").cast("long").alias("length"), _folder_of(F.col("path"), folders))
    place = f"{root.rstrip('/')}/crawl-{crawl_id}"
    rows.repartition(folders, "folder").sortWithinPartitions("folder", "path").write.mode("overwrite").partitionBy("folder").parquet(place)
    replace_text(pages.sparkSession, f"{place}/_archive.json", json.dumps({"folders": folders}))


def read_archive(spark: SparkSession, root: str, crawl_id: str) -> DataFrame:
    """(path, href, html, length) of all pages of an archive."""
    return spark.read.schema(ARCHIVE).parquet(f"{root.rstrip('/')}/crawl-{crawl_id}").drop("folder")


def read_page(spark: SparkSession, root: str, crawl_id: str, path: str) -> DataFrame:
    """One page of an archive by its file name: only its folder is read."""
    place = f"{root.rstrip('/')}/crawl-{crawl_id}"
    folders = json.loads(read_text(spark, f"{place}/_archive.json"))["folders"]
    stored = spark.read.schema(ARCHIVE).parquet(place)
    return stored.where((F.col("folder") == _folder_of(F.lit(path), folders)) & (F.col("path") == path)).drop("folder")


def export_csv(results: DataFrame, path: str) -> None:
    """All rows and columns but the stored page's, with the table's titles, as a folder of parts that each have the header; a quotation mark is doubled."""
    titled = [F.col(c).alias(t) for t, c in COLUMNS if c in results.columns and c != "opfs_path"]
    results.select(*titled).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_zip(archive_rows: DataFrame, path: str) -> None:
    """One ZIP file of (path, html) rows, packed by tasks; a file of the store that ``path`` names."""
    pieces = write_zip_pieces(archive_rows, f"{path}.pieces-{uuid.uuid4().hex}")
    join_pieces(archive_rows.sparkSession, pieces, path)
    delete(archive_rows.sparkSession, pieces[-1][0].rsplit("/", 1)[0])


class Presets:
    """Named regular expressions of one settings file in the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> list[dict]:
        return json.loads(read_text(self.spark, self.path) or "[]")

    def get(self, name: str) -> dict:
        """The preset of that name; KeyError without one."""
        for preset in self.all():
            if preset["name"] == name:
                return preset
        raise KeyError(name)

    def _write(self, presets: list[dict]) -> None:
        replace_text(self.spark, self.path, json.dumps(presets))

    def add(self, name: str, regex: str, kind: str) -> None:
        if not name.strip():
            raise ValueError("a preset needs a name")
        if kind not in ("include", "exclude"):
            raise ValueError(f"kind is {kind!r}")
        re.compile(regex)
        presets = self.all()
        self._write([*presets, {"id": str(1 + max((int(p["id"]) for p in presets), default=0)), "name": name.strip(), "regex": regex, "type": kind}])

    def delete(self, id_: str) -> None:
        self._write([p for p in self.all() if p["id"] != id_])
