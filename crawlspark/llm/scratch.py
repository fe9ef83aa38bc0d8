"""Intermediate tables in the folder that all executors share."""

from crawlspark.storage import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
