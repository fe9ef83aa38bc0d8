"""Intermediate tables and small files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes a query's shuffle files when the query has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and Spark is local (tests), a temporary one is made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="crawlspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Writes tables below one new folder of the shared directory and drops them when they are used up.

    A written table cuts the lineage: if an executor is lost, only what was read from the table is computed again.
    With ``drop_shuffles`` the shuffle files of a table's job go when the table is written; nothing reads them later.
    """

    def __init__(self, spark: SparkSession, drop_shuffles: bool = False):
        self.spark = spark
        self.drop_shuffles = drop_shuffles
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(DROP_SHUFFLES)
        try:
            if self.drop_shuffles:
                self.spark.conf.set(DROP_SHUFFLES, "true")
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(DROP_SHUFFLES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes the files of a table that save() returned; nothing may read it afterwards."""
        delete(self.spark, df._scratch_path)


class Buckets:
    """A table in buckets by one column: joins on that column with others of as many buckets shuffle neither.

    Its files lie at ``path``; the session's catalogue knows it under a name of its own until ``close``, which leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, by: str, n: int, parts: str | None = None):
        self.spark, self.path, self.by, self.n, self.columns = spark, path, by, n, columns
        self.name = f"buckets_{uuid.uuid4().hex}"
        partitioned = f"PARTITIONED BY ({parts})" if parts else ""
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet {partitioned} CLUSTERED BY ({by}) INTO {n} BUCKETS LOCATION '{path}'")
        if parts and exists(spark, path):
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds rows (columns in the table's order), one file a bucket."""
        rows.repartition(self.n, self.by).write.insertInto(self.name)

    def drop_part(self, part: str) -> None:
        """Removes the rows of a part, such as day=3."""
        column, value = part.split("=")
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({column}={value})")
        delete(self.spark, f"{self.path}/{part}")

    def files(self) -> DataFrame:
        """The same rows, without the catalogue."""
        return self.spark.read.schema(self.table().schema).parquet(self.path)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _file(spark: SparkSession, path: str):
    """(the file system, the path) in Hadoop's terms: any store that Spark can use."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _small_file(spark: SparkSession, path: str):
    """As ``_file``; on a local file system without the files of checksums beside it, which are not replaced with a file at once."""
    fs, target = _file(spark, path)
    return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), target


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder of any store that Spark can write."""
    fs, target = _file(spark, path)
    return fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder."""
    fs, target = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless there is one; False if there is. Of several who try, one succeeds."""
    fs, target = _small_file(spark, path)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place by one rename: readers see the old file or the new one, never a part."""
    jvm = spark.sparkContext._jvm
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    create_text(spark, draft, text)
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fs, target = _file(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(draft)), fs.makeQualified(target), renames)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, target = _small_file(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
