"""Event-time operators that serve batch tables and streams alike.

Each takes a DataFrame with an event-time column; on a stream the caller's watermark
bounds the state.  ``ingest`` holds the micro-batch steps for ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark.operators import ordered
from mnemospark.store import Scratch


def watermarked(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, delay) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): counts and sums in windows side by side."""
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours") -> DataFrame:
    """(start, n, total) in overlapping windows."""
    g = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than ``gap`` between them."""
    g = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key; on a stream within the watermark."""
    if events.isStreaming:
        return events.dropDuplicatesWithinWatermark(list(keys))
    first = W.partitionBy(*keys).orderBy("ts", "event_id")
    return events.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def debounced(events: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Events that do not follow another of the same keys within so many seconds."""
    before = ordered.with_next(events, list(keys), ["ts", "event_id"], ["ts"], Scratch(events.sparkSession, "debounce"), -1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = micros("ts") - micros("next_ts")
    return before.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= seconds * 1_000_000)).drop("_gap", "next_ts")


def ingest(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], trigger_now: bool = True) -> StreamingQuery:
    """Starts a query that applies ``step`` to each micro-batch and appends it under its batch number.

    A batch that is replayed after a failure overwrites its own folder, so every row
    is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_now else writer).start()


def promoted(items: DataFrame, least: int = 2) -> DataFrame:
    """(session, tag, n, text, importance): stream items of a session grouped by their first tag.

    A group of ``least`` or more becomes one memory: its best item's text with the number
    of related ones, mean importance; smaller groups give their best item alone.
    """
    best = F.max_by("text", F.struct("importance", "item_id"))
    g = items.groupBy("session", "tag").agg(F.count("*").alias("n"), best.alias("text"), F.avg("importance").alias("importance"))
    text = F.when(F.col("n") >= least, F.concat("text", F.lit(" (+"), F.col("n") - 1, F.lit(" related)"))).otherwise(F.col("text"))
    return g.select("session", "tag", "n", text.alias("text"), "importance")
