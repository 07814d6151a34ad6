"""Mixing sources to target weights (problem 7).

Method: weighted fair queueing.  The documents of every source are shuffled by a hash;
a document's virtual finish time is the number of tokens its source has sent up to and
with it, divided by the source's weight.  A source that is used up starts over, at
most ``max_repeats`` times in all.  The copies are range-sorted by virtual finish time
over all sources and cut off where the total budget is reached, so every source that
has not run out has its share at every point of the order.

Running sums are taken in two steps, within range partitions and over the partitions'
totals, so neither a source nor the whole order ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions.notation import key
from mnemospark.llm import tokens
from mnemospark.store import Scratch


def running_sum(df: DataFrame, scratch: Scratch, groups: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` (bigint) up to and with each row, within ``groups`` by ``order``.

    The order must be total.  Within a range partition Arrow batches are summed as they
    pass; the totals of the partitions, at most one row for each partition and group
    that meet, are then summed by a window and joined back.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *groups, *order).sortWithinPartitions(*groups, *order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn(name, F.col(value).cast("bigint"))
    at = [ranged.columns.index(g) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.asarray(batch.column(n_value))
            new = np.zeros(n, bool)
            new[0] = True
            for g in at:
                c = batch.column(g).to_pylist()
                new[1:] |= np.fromiter((a != b for a, b in zip(c, c[1:], strict=False)), bool, n - 1)
            first = tuple(batch.column(g)[0].as_py() for g in at)
            sums = np.cumsum(values)
            starts = np.flatnonzero(new)
            base = np.repeat(sums[starts] - values[starts], np.diff([*starts, n]))
            sums = sums - base
            if first == last:
                sums[: starts[1] if len(starts) > 1 else n] += total
            last, total = tuple(batch.column(g)[n - 1].as_py() for g in at), int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_value], pa.array(sums, pa.int64())], schema=batch.schema)

    n_value = len(ranged.columns) - 1
    kept = scratch.keep(ranged.mapInArrow(run, ranged.schema))
    ends = kept.groupBy(*groups, "_part").agg(F.max(name).alias("_end"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select(*groups, "_part", F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_before"))
    out = kept.join(offsets, [*groups, "_part"]) if groups else kept.join(offsets, "_part")
    return out.withColumn(name, F.col(name) + F.col("_before")).select(*[c for c in kept.columns if c != "_part"])


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, weight, repeats): sources in lower case without blanks, of several rows the least.

    Rows without a source or without a positive share are left out; a missing or lower
    number of repeats is 1.
    """
    one = targets.select(key("source").alias("source"), F.col("target_share").alias("weight"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(1)).alias("repeats"))
    return one.filter("source is not null and weight > 0 and not isnan(weight)").groupBy("source").agg(F.min("weight").alias("weight"), F.min("repeats").alias("repeats"))


def mixture(documents: DataFrame, targets: DataFrame, budget: int | str | None = None, seed: int = 0, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(doc_id, source, copy, n_tokens, finish, sent): the mixture in its order.

    ``sent`` is the number of tokens up to and with the row.  The budget is the number
    of tokens of the mixture; unless given, those of all documents of sources with a target
    once; ``"exact"`` stands for the most at which no source that has documents runs out.
    Documents of other sources or without a source or token, and copies beyond the
    budget, are left out.  Of a source that runs out before the budget is reached all
    permitted copies are in; the others then share the rest by their weights.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    weights = targets_of(targets)
    of_target = documents.select("doc_id", key("source").alias("source"), "text").join(weights.select("source"), "source", "left_semi")
    # written, as a range partitioning reads its input twice
    sizes = scratch.keep(tokens.sized(of_target.select("doc_id", "source", "text"), folder).filter("n_tokens > 0"))
    shuffled = sizes.withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    within = scratch.keep(running_sum(shuffled, scratch, ["source"], ["h", "doc_id"], "n_tokens", "upto"))
    totals = within.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    plan = weights.join(totals, "source")
    if budget == "exact":
        least, weight = plan.agg(F.min(F.col("total") * F.col("repeats") / F.col("weight")), F.sum("weight")).first()
        budget = int((least or 0) * (weight or 0))
    if budget is None:
        budget = totals.agg(F.sum("total")).first()[0] or 0
    copies = (
        within.join(plan, "source")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .select("doc_id", "source", "copy", "n_tokens", "h", (((F.col("copy") - 1) * F.col("total") + F.col("upto")) / F.col("weight")).alias("finish"))
    )
    order = ["finish", "source", "copy", "h", "doc_id"]
    sorted_ = running_sum(copies, scratch, [], order, "n_tokens", "sent")
    return sorted_.filter(F.col("sent") <= budget).select("doc_id", "source", "copy", "n_tokens", "finish", "sent")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, n_tokens, actual_share) of every target."""
    got = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("copies"), F.sum("n_tokens").alias("n_tokens"))
    rows = targets_of(targets).join(got, "source", "left").na.fill(0, ["documents", "copies", "n_tokens"])
    whole = F.sum("n_tokens").over(W.partitionBy())
    return rows.select(
        "source", F.col("weight").alias("target_share"), F.col("repeats").alias("max_repeats"), "documents", "copies", "n_tokens",
        F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0).alias("actual_share"),
    )
