"""Settings of a crawl."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession

from ..storage import read_text, replace_text


@dataclass(frozen=True)
class CrawlConfig:
    """delay, max_connections, credentials and cache concern the network and change nothing on a snapshot."""

    stay_on_hostname: bool = False
    crawl_mode: str = "list"
    max_pages: int = 500
    filter_regex: str = ""
    filter_type: str = ""
    on_invalid: str = "error"
    respect_robots: bool = True
    fetch_outbound: bool = False
    known_only: bool = True
    order: str = "url"
    readability: bool = False
    charset: str = "utf-8"
    max_retries: int = 2
    delay: int = 0
    max_connections: int = 5
    credentials: str = "omit"
    cache: str = "no-store"

    def __post_init__(self):
        if self.order not in ("url", "queue"):
            raise ValueError(f"order is {self.order!r}")
        if self.crawl_mode not in ("list", "recursive"):
            raise ValueError(f"crawl_mode is {self.crawl_mode!r}")
        if self.filter_type not in ("", "include", "exclude"):
            raise ValueError(f"filter_type is {self.filter_type!r}")

    def save(self, spark: SparkSession, path: str) -> None:
        """Replaces the settings file as a whole."""
        replace_text(spark, path, json.dumps(asdict(self)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CrawlConfig:
        """What was saved; defaults for what it lacks, or without a file. Settings of other names are passed over."""
        saved = json.loads(read_text(spark, path) or "{}")
        return cls(**{f.name: saved[f.name] for f in fields(cls) if f.name in saved})
