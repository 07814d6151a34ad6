"""Shared intermediate storage.

Intermediate tables that cut lineage go to the folder the cluster names in
``spark.checkpoint.dir``, which every executor can read, so that a lost executor
loses none of them.  Only a local session without that setting (tests) gets a
folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one for a purely local session."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="mnemospark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders of intermediate tables that this process made and has not swept.
_made: list[str] = []


def _at(spark: SparkSession, path: str):
    """The file system of a path and the path as Hadoop's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is no such folder."""
    fs, p = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file at once: under another name, then renamed."""
    fs, p = _at(spark, path)
    hidden = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), "." + p.getName())
    out = fs.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(hidden, p)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Puts a folder in the place of another."""
    fs, p = _at(spark, old)
    fs.delete(p, True)
    fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows of the given columns, which the optimizer knows to be empty."""
    columns = [c.strip().split(" ", 1) for c in schema.split(",")]
    return spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in columns]).filter(F.lit(False))


def sweep(spark: SparkSession) -> int:
    """Deletes the intermediate tables of all queries so far; to be called when their results were stored."""
    n = len(_made)
    while _made:
        delete(spark, _made.pop())
    return n


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of each query that runs within as soon as it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Names, writes, re-reads and drops intermediate Parquet tables of one query."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _made.append(self.root)

    def folder(self) -> str:
        """A new folder of the query's own."""
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """Write ``df`` once, cut into folders by the columns ``by``, and return it read back, without its lineage."""
        path = self.folder()
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table made by ``keep`` that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(self.spark, path)
