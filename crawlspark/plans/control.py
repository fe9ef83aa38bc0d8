"""Starting, pausing and stopping a crawl from another process, by small files in the shared store."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from ..storage import create_text, delete, read_text, replace_text


class CrawlActive(RuntimeError):
    """There is an active crawl already."""


class CrawlControl:
    """The record of the one active crawl of a store: who runs it, what it was told, and how far it is.

    ``active.json`` is made only if there is none, so that of several starts one succeeds; it goes when the crawl
    finishes. ``told.json`` holds the last order, which the loop reads between levels; ``state.json`` is what the loop
    says after each level. Each is put in place whole. A crawl whose process has died stays active until ``start``
    is called with ``takeover``; with a path of its own it then goes on from its last whole level.
    """

    def __init__(self, spark: SparkSession, root: str, poll_seconds: float = 1.0):
        self.spark, self.root, self.poll_seconds = spark, root.rstrip("/"), poll_seconds
        self.token: str | None = None

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}.json"

    def _read(self, name: str) -> dict:
        return json.loads(read_text(self.spark, self._path(name)) or "{}")

    def _write(self, name: str, value: dict) -> None:
        replace_text(self.spark, self._path(name), json.dumps(value))

    def start(self, crawl_id: str, takeover: bool = False) -> None:
        token = uuid.uuid4().hex
        if takeover:
            delete(self.spark, self._path("active"))
        if not create_text(self.spark, self._path("active"), json.dumps({"crawl_id": crawl_id, "token": token})):
            raise CrawlActive(f"crawl {self._read('active').get('crawl_id')} is active")
        self.token = token
        self._write("told", {"order": "run"})
        self._write("state", {"crawl_id": crawl_id, "status": "running", "crawled": 0, "levels": 0})

    def tell(self, order: str) -> None:
        """'pause', 'run' (which resumes) or 'stop', from any process."""
        if order not in ("pause", "run", "stop"):
            raise ValueError(f"order is {order!r}")
        if not self._read("active"):
            raise RuntimeError("no crawl is active")
        self._write("told", {"order": order})

    def state(self) -> dict:
        """crawl_id, status (idle, running, paused, stopped or done), crawled and levels, from any process."""
        return self._read("state") or {"status": "idle", "crawled": 0, "levels": 0}

    def goes_on(self, crawled: int, levels: int) -> bool:
        """What the loop asks between levels: waits while it is paused, False when it was told to stop or lost its record."""
        said = None
        while True:
            active, order = self._read("active"), self._read("told").get("order", "run")
            if active.get("token") != self.token:
                return False
            status = {"run": "running", "pause": "paused", "stop": "stopped"}[order]
            if status != said:
                self._write("state", {"crawl_id": active["crawl_id"], "status": status, "crawled": crawled, "levels": levels})
                said = status
            if order != "pause":
                return order == "run"
            time.sleep(self.poll_seconds)

    def finish(self, crawled: int, levels: int) -> None:
        active = self._read("active")
        if active.get("token") == self.token:
            status = "stopped" if self._read("told").get("order") == "stop" else "done"
            self._write("state", {"crawl_id": active["crawl_id"], "status": status, "crawled": crawled, "levels": levels})
            delete(self.spark, self._path("active"))
