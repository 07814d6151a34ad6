"""Order within groups of any size without one task for each group.

Rows are cut into range partitions by group and order, and every partition is read as it
comes: positions, neighbours and folds are found within it, and only one row for each
partition and group, its edge, is brought together to join the partitions up.  So a
session of a third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.store import Scratch


def ranged(df: DataFrame, groups: list[str], order: list[str | Column]) -> DataFrame:
    """The rows in range partitions by group and order, sorted, with ``_part``, the number of the partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *groups, *order).sortWithinPartitions(*groups, *order).withColumn("_part", F.spark_partition_id())


def with_position(df: DataFrame, groups: list[str], order: list[str | Column], scratch: Scratch, name: str = "position") -> DataFrame:
    """``df`` with the number of each row within its group, from 1; the order must be total.

    The window goes over a partition's share of a group; the shares are added up from one
    row for each partition and group.
    """
    kept = scratch.keep(ranged(df, groups, order))
    local = F.row_number().over(W.partitionBy(*groups, "_part").orderBy(*order))
    sizes = kept.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = kept.withColumn("_local", local).join(offsets, same)
    return out.select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name))


def beside(placed: DataFrame, groups: list[str], at: str, columns: list[str], n: int, prefix: str) -> DataFrame:
    """``placed`` with the columns of the row ``n`` places on in its group, under the prefix; null beyond the ends.

    ``at`` is the number of each row within its group, so this is an equi-join that no
    group's size skews; ``placed`` is to be a stored table, as it is read twice.
    """
    other = placed.select(*[F.col(g).alias(f"_{g}") for g in groups], (F.col(at) - n).alias("_to"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    same = F.col(at) == F.col("_to")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(other, same, "left").drop("_to", *[f"_{g}" for g in groups])


def with_next(df: DataFrame, groups: list[str], order: list[str | Column], columns: list[str], scratch: Scratch, n: int = 1) -> DataFrame:
    """``df`` with ``next_<column>`` of the row ``n`` places on in its group, null at the end; a negative ``n`` looks back."""
    placed = scratch.keep(with_position(df, groups, order, scratch, "_at"))
    return beside(placed, groups, "_at", columns, n, "next").drop("_at")


def sizes(placed: DataFrame, groups: list[str], name: str = "size") -> DataFrame:
    """``placed`` with the number of rows of each group, by a join of one row for each group."""
    n = placed.groupBy(*groups).agg(F.count("*").alias(name))
    return placed.join(n, groups)


def medians(df: DataFrame, group: str, value: str, scratch: Scratch) -> DataFrame:
    """(group, median): the middle value of each group, or the mean of the two middle ones; nulls do not count."""
    placed = scratch.keep(with_position(df.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_id")), [group], ["_v", "_id"], scratch, "_at"))
    middle = sizes(placed, [group], "_n").filter("_at in (floor((_n + 1) / 2), ceil((_n + 1) / 2))")
    return middle.groupBy(group).agg(F.avg("_v").alias("median"))


def tile(position: Column, size: Column, tiles: int) -> Column:
    """The number of the tile, of nearly equal ones, that a position of a group of a size falls in; the first ones take the rest."""
    small, rest = F.floor(size / tiles), size % tiles
    first = rest * (small + 1)
    return F.when(position <= first, F.ceil(position / (small + 1))).otherwise(rest + F.ceil((position - first) / F.greatest(small, F.lit(1)))).cast("int")


def folded(parts: DataFrame, by: str, value: str, start: float) -> DataFrame:
    """(by, n, value): ordered steps added to ``start`` and kept within 0 and 1 after each, from ``ranged`` rows.

    Runs of steps are composed as x -> min(high, max(low, x + shift)).
    """
    schema = f"{by} {dict(parts.dtypes)[by]}, _part int, n bigint, shift double, low double, high double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, state = None, [], None

        for batch in batches:
            for k, p, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k, p) != now:
                    if now is not None:
                        out.append((*now, *state))
                    now, state = (k, p), (0, 0.0, -np.inf, np.inf)
                n, shift, low, high = state
                # clip(clip(x + shift, low, high) + d, 0, 1)
                low, high = min(1.0, max(0.0, low + d)), min(1.0, max(0.0, high + d))
                state = (n + 1, shift + d, low, high)
        if now is not None:
            out.append((*now, *state))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        key = batch.schema.field(0).type if now is not None else pa.string()
        types = (key, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[by, "_part", "n", "shift", "low", "high"])

    runs = parts.select(by, "_part", F.col(value).cast("double").alias("d")).mapInArrow(run, schema)
    steps = F.array_sort(F.collect_list(F.struct("_part", "shift", "low", "high")))
    whole = F.aggregate("steps", F.lit(start), lambda x, s: F.least(s["high"], F.greatest(s["low"], x + s["shift"])))
    return runs.groupBy(by).agg(F.sum("n").alias("n"), steps.alias("steps")).select(by, "n", whole.alias("value"))
