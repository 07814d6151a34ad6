"""The memory store on disk: versioned snapshots, a write-ahead log, upserts, shards and tiers.

Plain Parquet has no in-place updates, so every change is a new version: a folder
``version=N`` for each table with a marker that is written last.  Readers take the
newest marked version, so a writer that dies leaves the old one in force.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark import store


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class SnapshotStore:
    """Versions of named tables under one folder."""

    spark: SparkSession
    root: str

    def versions(self) -> list[int]:
        """The finished versions, oldest first."""
        jvm, p, fs = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))

    def save(self, tables: dict[str, DataFrame]) -> int:
        """Writes all tables as the next version and marks it finished; returns its number."""
        n = (self.versions() or [0])[-1] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/version={n}/{name}")
        sums = {name: checksum(self.spark.read.parquet(f"{self.root}/version={n}/{name}")) for name in tables}
        store.write_text(self.spark, f"{self.root}/done-{n}", json.dumps(sums))
        return n

    def verify(self, at: int) -> bool:
        """Whether every table of a version still has the rows it was saved with."""
        sums = json.loads(store.read_text(self.spark, f"{self.root}/done-{at}"))
        return all(checksum(self.spark.read.parquet(f"{self.root}/version={at}/{name}")) == s for name, s in sums.items())

    def load(self, name: str, at: int | None = None) -> DataFrame:
        """A table of the newest finished version, not later than ``at``."""
        known = [v for v in self.versions() if at is None or v <= at]
        if not known:
            raise FileNotFoundError(f"no finished version under {self.root}")
        return self.spark.read.parquet(f"{self.root}/version={known[-1]}/{name}")

    def rollback(self, to: int) -> None:
        """Makes ``to`` the newest version; later ones are dropped."""
        for v in self.versions():
            if v > to:
                self._drop(v)

    def clean(self, keep: int) -> list[int]:
        """Drops all but the newest ``keep`` versions; returns those dropped."""
        old = self.versions()[:-keep] if keep > 0 else self.versions()
        for v in old:
            self._drop(v)
        return old

    def _drop(self, v: int) -> None:
        # the marker goes first, so a half-dropped version is never read
        for name in (f"done-{v}", f"version={v}"):
            jvm, p, fs = _fs(self.spark, f"{self.root}/{name}")
            fs.delete(p, True)


def checksum(df: DataFrame) -> str:
    """The number of rows and the sum of their hashes, whatever their order."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(text).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def upserted(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of the same key; delta keys must be unique."""
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def deleted(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def replayed(base: DataFrame, log: DataFrame, key: str, since: float) -> DataFrame:
    """``base`` after the log's operations later than ``since``.

    The log has seq, at, op (put or remove), the key and a struct ``row`` like base's
    rows.  Of a key the operation of the greatest seq counts.
    """
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))
    ops = log.filter(F.col("at") > since).withColumn("_rn", last).filter("_rn = 1")
    kept = base.join(ops.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(ops.filter("op = 'put'").select("row.*").select(*base.columns))


def bucket(at: Column, unit: str = "quarter") -> Column:
    """The label of a time bucket: quarter, week or month."""
    ts = F.timestamp_seconds(at)
    return {
        "quarter": F.concat(F.year(ts).cast("string"), F.lit("_Q"), F.quarter(ts).cast("string")),
        "week": F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("_W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")),
        "month": F.date_format(ts, "yyyy-MM"),
    }[unit]


def save_sharded(df: DataFrame, path: str, domain: Column, at: str = "created_at", unit: str = "quarter", rows_per_file: int = 1_000_000) -> None:
    """Writes a table by domain and time bucket; readers that ask for some of them read only those.

    Rows are spread by both columns and a hash, so that a domain of a third of all
    rows is written by several tasks.
    """
    salted = df.withColumns({"domain": domain, "bucket": bucket(F.col(at), unit), "_salt": F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))})
    spread = salted.repartition("domain", "bucket", "_salt").drop("_salt")
    spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("domain", "bucket").parquet(path)


def tiered(df: DataFrame, level: Column) -> dict[str, DataFrame]:
    """The rows of each storage tier; archived texts keep their first 200 characters."""
    out = df.withColumn("tier", level)
    return {
        "memory": out.filter("tier = 'memory'"), "disk": out.filter("tier = 'disk'"), "index": out.filter("tier = 'index'").withColumn("text", F.lit(None).cast("string")),
        "archive": out.filter("tier = 'archive'").withColumn("text", F.substring("text", 1, 200)),
        "audit": out.filter("tier = 'audit'").select("id", F.sha2("text", 256).alias("digest"), "tier"),
    }
