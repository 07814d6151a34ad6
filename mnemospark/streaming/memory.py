"""Stateful streams: working memory with a time to live, deduplication within sessions, online consolidation."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemospark import store
from mnemospark.operators import similarity

ITEM = "item_id bigint, text string, importance double, accesses bigint, at double"
KEPT = "session string, " + ITEM + ", priority double"

#: The state store that states with a time to live need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def priority(importance: float, idle_seconds: float, accesses: int) -> float:
    return 0.6 * importance + 0.3 * exp(-max(0.0, idle_seconds) / 600.0) + 0.15 * log(1 + accesses)


class WorkingMemory(StatefulProcessor):
    """Holds a session's items until their time to live is over; the least of more than ``most`` give way."""

    def __init__(self, most: int = 15, ttl_ms: int = 1_800_000) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item_id bigint", "text string, importance double, accesses bigint, at double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0.0
        for pdf in rows:
            for r in pdf.sort_values(["at", "item_id"]).itertuples():
                k = (int(r.item_id),)
                seen = self.items.getValue(k)[2] if self.items.containsKey(k) else 0
                self.items.updateValue(k, (r.text, float(r.importance), int(seen) + 1, float(r.at)))
                now = max(now, float(r.at))
        held = [(int(k[0]), v[0], v[1], int(v[2]), v[3], priority(v[1], now - v[3], int(v[2]))) for k, v in self.items.iterator()]
        held.sort(key=lambda x: (-round(x[5], 9), x[0]))
        for gone in held[self.most :]:
            self.items.removeKey((gone[0],))
        yield pd.DataFrame([(key[0], *x) for x in held[: self.most]], columns=["session", "item_id", "text", "importance", "accesses", "at", "priority"])

    def close(self) -> None:
        pass


def working_memory(items: DataFrame, most: int = 15, ttl_ms: int = 1_800_000) -> DataFrame:
    """What each session of a stream (session, item_id, text, importance, at) has in mind after every batch it takes part in.

    Items expire ``ttl_ms`` after they were last written; a session holds at most ``most``
    (the buffer's size), so its state is bounded.  Needs ``PROVIDER`` as state store.
    """
    return items.groupBy("session").transformWithStateInPandas(WorkingMemory(most, ttl_ms), KEPT, "Update", "ProcessingTime")


def deduplicated(items: DataFrame, over: float = 0.85) -> DataFrame:
    """A batch's items (session, item_id, text, importance, tags, embedding, at) without those alike an earlier one of their session.

    The earlier item takes the greatest importance and all tags of those it stands for;
    ``n`` is their number.  Items without a vector stand for themselves.  Sessions of any
    size are dealt with in parts (``similarity.leader_clusters``).
    """
    vectors = items.filter("embedding is not null and item_id is not null").select("session", F.col("item_id").alias("id"), (-F.col("at")).alias("importance"), "embedding")
    leaders = similarity.leader_clusters(vectors, "session", over).select(F.col("id").alias("item_id"), "leader")
    led = items.join(leaders, "item_id", "left").withColumn("leader", F.coalesce("leader", "item_id"))
    own = F.min(F.struct((F.col("item_id") != F.col("leader")).alias("other"), "item_id", "text"))
    g = led.groupBy("session", "leader").agg(
        own.alias("o"), F.max("importance").alias("importance"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), F.count("*").alias("n")
    )
    return g.select("session", F.col("leader").alias("item_id"), F.col("o.text").alias("text"), "importance", "tags", "n")


def capped(items: DataFrame, most: int = 10) -> DataFrame:
    """A session's ``most`` most important items of a flush (the cap is the flush's feature)."""
    rank = F.row_number().over(W.partitionBy("session").orderBy(F.desc("importance"), "item_id"))
    return items.withColumn("_rn", rank).filter(F.col("_rn") <= most).drop("_rn")


def flushed(items: DataFrame, over: float = 0.85, most: int = 10) -> DataFrame:
    """What a flush of a batch promotes: deduplicated, grouped by first tag, and capped for each session."""
    kept = deduplicated(items, over)
    best = F.max_by("text", F.struct("importance", (-F.col("item_id")).alias("first")))
    g = kept.groupBy("session", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("")).alias("tag")).agg(F.min("item_id").alias("item_id"), best.alias("text"), F.avg("importance").alias("importance"), F.sum("n").alias("n"))
    text = F.when(F.col("n") > 1, F.concat("text", F.lit(" (+"), F.col("n") - 1, F.lit(" related items)"))).otherwise(F.col("text"))
    return capped(g.select("session", "tag", "item_id", text.alias("text"), "importance", "n"), most)


class OnlineConsolidator:
    """A ``foreachBatch`` sink that stores new memories and links them to like ones already stored.

    Of a batch (item_id, embedding, importance, emotional_valence, surprise) the half of
    ``most`` with the greatest priority are linked to those of the ``most`` newest stored
    memories whose cosine is above ``over``; all are stored.  Batches are folders by
    number, so a replayed batch overwrites itself.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 100, over: float = 0.6) -> None:
        self.spark, self.root, self.most, self.over = spark, root, most, over

    def _stored(self, what: str, before: int) -> DataFrame | None:
        numbers = [int(n.removeprefix("batch=")) for n in store.names(self.spark, f"{self.root}/{what}") if n.startswith("batch=")]
        paths = [f"{self.root}/{what}/batch={n}" for n in sorted(numbers) if n < before]
        return self.spark.read.parquet(*paths) if paths else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/anchors/batch={number}")
        own = self.spark.read.parquet(f"{self.root}/anchors/batch={number}")
        before = self._stored("anchors", number)
        p = F.abs("emotional_valence") * 0.4 + F.col("surprise") * 0.35 + F.col("importance") * 0.25
        first = own.orderBy(F.desc(p), "item_id").limit(max(1, self.most // 2)).select(F.col("item_id").alias("source"), F.col("embedding").alias("a"))
        edges = store.empty(self.spark, "source bigint, target bigint, weight double")
        if before is not None:
            newest = before.orderBy(F.desc("item_id")).limit(self.most).select(F.col("item_id").alias("target"), F.col("embedding").alias("b"))
            from mnemospark.functions.vectors import cosine

            # two lists of at most ``most`` rows
            met = first.join(newest, F.col("source") != F.col("target")).select("source", "target", cosine(F.col("a"), F.col("b")).alias("weight"))
            edges = met.filter(F.col("weight") > self.over)
        edges.write.mode("overwrite").parquet(f"{self.root}/edges/batch={number}")

    def edges(self) -> DataFrame:
        """All links so far, each pair once with the weight of its first link and 0.02 for every further one."""
        rows = self._stored("edges", 1 << 62)
        rows = rows if rows is not None else store.empty(self.spark, "source bigint, target bigint, weight double")
        g = rows.groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.max("weight").alias("w"), F.count("*").alias("n"))
        return g.select("lo", "hi", F.least(F.lit(1.0), F.col("w") + 0.02 * (F.col("n") - 1)).alias("weight"))
