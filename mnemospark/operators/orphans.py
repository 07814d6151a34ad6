"""References to records that do not exist (problem 3).

Method: keyed state of pending orphans is maintained incrementally.  Three tables are
carried from batch to batch: the *parent index* (when each key first and last arrived
and was last deleted), the *pending* references (those that were orphans when they came
or are now) and the *log* of all others, which only grows.  ``advance`` applies one
batch: new references probe the index, arriving parents resolve waiting orphans,
deletions reopen the references of the log they leave behind.  Applying all records in
one batch or in any split gives the same state.  ``snapshot`` counts the orphans.

``OrphanStore`` keeps the state in a shared folder, cut into buckets by a hash of the
key referred to.  A batch reads and rewrites only the buckets of its keys; of the log it
reads only the buckets with a deletion and writes only what is new.  A manifest names the
files of every batch, so a stopped stream starts again where it was.

A key that a third of all references share is no problem: the parent index has one row
for each key, so the join is many-to-one, its reference side is what adaptive execution
splits, and nothing is gathered by key on the reference side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import store
from mnemospark.functions import notation
from mnemospark.store import Scratch

#: Columns of references, parents and deletions.
REFERENCE = "ref_field string, record_key string, target string, missing_key string, seen_at timestamp"
PARENT = "target string, key string, at timestamp"
INDEX = "target string, key string, first_at timestamp, last_at timestamp, gone_at timestamp"
PENDING = REFERENCE + ", first_at timestamp, present boolean"

#: What makes a reference another one.
IDENTITY = ("ref_field", "record_key", "target", "missing_key")

#: Parts that the stored state is cut into by key.
BUCKETS = 32


@dataclass(frozen=True)
class OrphanState:
    """The parent index, the references that were orphans when they came or are now, and the log of the others.

    Pending references carry the time their parent first came and whether it is there.
    """

    index: DataFrame
    pending: DataFrame
    log: DataFrame
    is_empty: bool = False

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        return OrphanState(*(store.empty(spark, s) for s in (INDEX, PENDING, REFERENCE)), is_empty=True)


def _arrivals(parents: DataFrame, deletions: DataFrame) -> DataFrame:
    """A batch's part of the index: first and last arrival and last deletion of each key that it names."""
    none = F.lit(None).cast("timestamp")
    came = parents.select("target", "key", F.col("at").alias("first_at"), F.col("at").alias("last_at"), none.alias("gone_at"))
    went = deletions.select("target", "key", none.alias("first_at"), none.alias("last_at"), F.col("at").alias("gone_at"))
    return _combined(came.unionByName(went).filter("key is not null"))


def _combined(rows: DataFrame) -> DataFrame:
    """One row for each key; only least and greatest times are kept, so what comes and goes often stays one row."""
    return rows.groupBy("target", "key").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("gone_at").alias("gone_at"))


def _probed(references: DataFrame, index: DataFrame) -> DataFrame:
    """The references, once each with their earliest time, with what the index says of their key and whether they are pending."""
    there = F.col("last_at").isNotNull() & (F.col("gone_at").isNull() | (F.col("last_at") >= F.col("gone_at")))
    known = index.select("target", F.col("key").alias("missing_key"), "first_at", there.alias("there"))
    once = references.groupBy(*IDENTITY).agg(F.min("seen_at").alias("seen_at"))
    probed = once.join(known, ["target", "missing_key"], "left").select(*IDENTITY, "seen_at", "first_at", F.coalesce("there", F.lit(False)).alias("present"))
    return probed.withColumn("open", F.expr("not present or coalesce(first_at > seen_at, first_at is null)"))


def _to_probe(state: OrphanState, references: DataFrame, deletions: DataFrame) -> DataFrame:
    """The new references, the pending ones, and those of the log whose parent a deletion names."""
    rows = references.filter("missing_key is not null").select(*IDENTITY, "seen_at").unionByName(state.pending.select(*IDENTITY, "seen_at"))
    gone = deletions.select("target", F.col("key").alias("missing_key")).distinct()
    return rows.unionByName(state.log.join(gone, ["target", "missing_key"], "left_semi").select(*IDENTITY, "seen_at"))


def advance(state: OrphanState, references: DataFrame, parents: DataFrame, deletions: DataFrame | None = None) -> OrphanState:
    """The state after one batch.

    references: ref_field, record_key, target, missing_key (the key referred to), seen_at.
    parents, deletions: target, key, at.  Null keys are no references and no parents;
    repeated rows count once, with their earliest time.
    """
    deletions = deletions if deletions is not None else store.empty(references.sparkSession, PARENT)
    index = _combined(state.index.unionByName(_arrivals(parents, deletions)))
    probed = _probed(_to_probe(state, references, deletions), index)
    return OrphanState(index, probed.filter("open").drop("open"), state.log.unionByName(probed.filter("not open").select(*IDENTITY, "seen_at")))


def orphans(state: OrphanState) -> DataFrame:
    """References whose parent was missing when they came: (ref_field, record_key, missing_key)."""
    return state.pending.filter("first_at is null or first_at > seen_at").select("ref_field", "record_key", "missing_key")


def snapshot(state: OrphanState, unit: str = "week") -> DataFrame:
    """Counts per referring table, field and load period.

    waiting: no parent so far; reopened: the parent was deleted; resolved: it arrived
    later.  A reference without a time counts under a null period.
    """
    kind = F.when(F.col("present"), "resolved").when(F.col("first_at").isNull(), "waiting").otherwise("reopened")
    return (
        state.pending.withColumn("kind", kind)
        .groupBy(F.split_part("ref_field", F.lit("."), F.lit(1)).alias("ref_table"), "ref_field", F.date_trunc(unit, "seen_at").alias("period"), "kind")
        .agg(F.count("*").alias("n"), F.countDistinct("missing_key").alias("n_keys"))
    )


class OrphanStore:
    """The state in a shared folder, in ``BUCKETS`` parts, advanced by numbered batches.

    A batch that was already applied is skipped, so a replay changes nothing.  Files that
    only the batch before the last needs are deleted one batch late.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        done = sorted(int(n.removesuffix(".json")) for n in store.names(spark, f"{root}/manifest") if n.endswith(".json") and n[0] != ".")
        #: number of the last batch; by bucket the batches whose files hold the index, the pending references and the log
        self.manifest: dict = json.loads(store.read_text(spark, f"{root}/manifest/{done[-1]}.json")) if done else {"batch": -1, "index": {}, "pending": {}, "log": {}}

    @property
    def batch(self) -> int:
        return self.manifest["batch"]

    def _path(self, what: str, number: int, bucket: str = "") -> str:
        folder = {"index": f"index/{number}", "pending": f"refs/{number}/open=true", "log": f"refs/{number}/open=false"}[what]
        return f"{self.root}/{folder}" + (f"/bucket={bucket}" if bucket else "")

    def _read(self, what: str, schema: str, buckets: set[str] | None) -> DataFrame:
        paths = [
            self._path(what, n, b)
            for b, numbers in self.manifest[what].items()
            if buckets is None or b in buckets
            for n in (numbers if isinstance(numbers, list) else [numbers])
        ]
        return self.spark.read.schema(schema).parquet(*paths) if paths else store.empty(self.spark, schema)

    def state(self, buckets: set[str] | None = None, deleted: set[str] | None = None) -> OrphanState:
        """The state, or those buckets of it (of the log those with deletions)."""
        return OrphanState(self._read("index", INDEX, buckets), self._read("pending", PENDING, buckets), self._read("log", REFERENCE, deleted if buckets is not None else None))

    def start(self, state: OrphanState) -> None:
        """Takes a state over, as batch 0."""
        came = state.index.select("target", "key", F.col("first_at").alias("at")).unionByName(state.index.select("target", "key", F.col("last_at").alias("at")))
        went = state.index.select("target", "key", F.col("gone_at").alias("at"))
        self.apply(0, state.pending.select(*IDENTITY, "seen_at").unionByName(state.log), came.filter("at is not null"), went.filter("at is not null"))

    def apply(self, number: int, references: DataFrame, parents: DataFrame, deletions: DataFrame | None = None) -> None:
        """Applies one batch; the inputs are read twice."""
        if number <= self.batch:
            return
        deletions = deletions if deletions is not None else store.empty(self.spark, PARENT)
        bucket = lambda key: F.pmod(F.xxhash64("target", key), F.lit(BUCKETS)).cast("string").alias("b")
        named = references.filter("missing_key is not null").select(bucket("missing_key"), F.lit(False).alias("gone"))
        named = named.union(parents.filter("key is not null").select(bucket("key"), F.lit(False))).union(deletions.filter("key is not null").select(bucket("key"), F.lit(True)))
        found = named.distinct().collect()  # at most two rows for each bucket
        touched, deleted = {r.b for r in found}, {r.b for r in found if r.gone}
        before = self.state(touched, deleted)
        index = _combined(before.index.unionByName(_arrivals(parents, deletions))).withColumn("bucket", bucket("key"))
        index.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/index/{number}")
        index = self.spark.read.schema(INDEX + ", bucket string").parquet(f"{self.root}/index/{number}")
        probed = _probed(_to_probe(before, references, deletions), index).withColumn("bucket", bucket("missing_key"))
        probed.hint("rebalance", "open", "bucket").write.mode("overwrite").partitionBy("open", "bucket").parquet(f"{self.root}/refs/{number}")
        new = json.loads(json.dumps(self.manifest)) | {"batch": number}
        for what in ("index", "pending", "log"):
            there = {n.removeprefix("bucket=") for n in store.names(self.spark, self._path(what, number)) if n.startswith("bucket=")}
            for b in touched:
                if what == "log":
                    new[what][b] = new[what].get(b, []) + [number] * (b in there)
                elif b in there:
                    new[what][b] = number
                else:
                    new[what].pop(b, None)
        store.write_text(self.spark, f"{self.root}/manifest/{number}.json", json.dumps(new))
        self._clean(self.manifest, new)
        self.manifest = new

    def _clean(self, old: dict, new: dict) -> None:
        """Deletes what neither of the two last manifests names."""
        for what in ("index", "pending"):
            used = set(old[what].values()) | set(new[what].values())
            folder = self._path(what, 0).split("/0")[0]
            for n in store.names(self.spark, folder):
                if n.isdigit() and int(n) < old["batch"] and int(n) not in used:
                    store.delete(self.spark, self._path(what, int(n)))
        for n in store.names(self.spark, f"{self.root}/manifest"):
            if n.removesuffix(".json").isdigit() and int(n.removesuffix(".json")) < old["batch"]:
                store.delete(self.spark, f"{self.root}/manifest/{n}")


def _as_references(field: str, target: str) -> Column:
    """The keys of an array column named like the field as references to ``target``."""
    return F.transform(F.col(f"`{field}`"), lambda k: F.struct(F.lit(field).alias("ref_field"), F.lit(target).alias("target"), k.alias("missing_key")))


def memory_references(edges: DataFrame, anchors: DataFrame, schemas: DataFrame) -> DataFrame:
    """The references among the tables of a memory store, with the record's first load.

    Records are distinct ids, however many rows each has; their time is the earliest of
    all their rows, also of rows without a reference.  Rows without an id are no records.
    """
    e = edges.filter("edge_id is not null").select(
        F.col("edge_id").cast("string").alias("record_key"), notation.key("source").alias("source"), notation.key("target").alias("target"), "loaded_at"
    )
    ends = e.groupBy("record_key").agg(F.min("loaded_at").alias("seen_at"), F.collect_set("source").alias("edges.source"), F.collect_set("target").alias("edges.target"))
    of_edges = ends.select(
        "record_key", "seen_at",
        F.explode(F.concat(*[
            _as_references(field, "anchors") for field in ("edges.source", "edges.target")
        ])).alias("r"),
    ).select("r.ref_field", "record_key", "r.target", "r.missing_key", "seen_at")
    a = anchors.select(notation.key("id").alias("record_key"), notation.key("schema_ref").alias("k"), "loaded_at").filter("record_key is not null")
    of_anchors = a.groupBy("record_key").agg(F.min("loaded_at").alias("seen_at"), F.collect_set("k").alias("ks"))
    s = schemas.select(notation.key("id").alias("record_key"), notation.ids("instance_ids_json").alias("ks"), "loaded_at").filter("record_key is not null")
    of_schemas = s.groupBy("record_key").agg(F.min("loaded_at").alias("seen_at"), F.array_distinct(F.flatten(F.collect_set("ks"))).alias("ks"))
    listed = lambda df, field, target: df.select(
        F.lit(field).alias("ref_field"), "record_key", F.lit(target).alias("target"), F.explode("ks").alias("missing_key"), "seen_at"
    )
    return of_edges.unionByName(listed(of_anchors, "anchors.schema_ref", "schemas")).unionByName(listed(of_schemas, "schemas.instance_ids_json", "anchors"))


def memory_parents(anchors: DataFrame, schemas: DataFrame) -> DataFrame:
    """Arrivals of anchors and schemas: the earliest load of each key."""
    one = lambda df, name: df.groupBy(F.lit(name).alias("target"), notation.key("id").alias("key")).agg(F.min("loaded_at").alias("at"))
    return one(anchors, "anchors").unionByName(one(schemas, "schemas")).filter("key is not null")


def memory_arrivals(anchors: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every load of anchors and schemas, once for each key and time: what was pruned may come again."""
    one = lambda df, name: df.select(F.lit(name).alias("target"), notation.key("id").alias("key"), F.col("loaded_at").alias("at"))
    return one(anchors, "anchors").unionByName(one(schemas, "schemas")).filter("key is not null").distinct()


def memory_deletions(ghosts: DataFrame) -> DataFrame:
    """Anchors that were pruned, at the time of pruning; ghosts without a time are left out."""
    return ghosts.select(F.lit("anchors").alias("target"), notation.key("id").alias("key"), F.timestamp_seconds("pruned_at").alias("at")).filter("key is not null and at is not null")


def periods(
    state: OrphanState, references: DataFrame, parents: DataFrame, deletions: DataFrame, unit: str = "month", scratch: Scratch | None = None
) -> Iterator[tuple[datetime | None, OrphanState]]:
    """Replays load periods in order as batches of an ``OrphanStore`` and yields (period, state) after each.

    Rows without a time are a batch of their own, the first, with a null period.  The
    inputs are written once, by period, and every batch reads its own part.  A given
    state is the first batch.  The number of periods is that of calendar units in the
    data, not of rows.
    """
    spark = references.sparkSession
    scratch = scratch or Scratch(spark, "orphans")
    inputs, found = [], set()
    for df, c in ((references.select(*IDENTITY, "seen_at"), "seen_at"), (parents.select("target", "key", "at"), "at"), (deletions.select("target", "key", "at"), "at")):
        own = scratch.keep(df.withColumn("period", F.date_format(F.date_trunc(unit, c), "yyyy-MM-dd HH:mm:ss")), "period")
        inputs.append(own)
        found |= {r[0] for r in own.select("period").distinct().collect()}
    own = OrphanStore(spark, scratch.folder())
    if not state.is_empty:
        own.start(state)
    for number, p in enumerate(sorted(found, key=lambda p: (p is not None, p)), 1):
        own.apply(number, *(df.filter(F.col("period").eqNullSafe(F.lit(p))).drop("period") for df in inputs))
        yield p and datetime.fromisoformat(p), own.state()
