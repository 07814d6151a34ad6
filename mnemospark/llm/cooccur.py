"""Items that appear together (problem 1).

Method: stripes.  Every partition builds, for each item, an associative array of
the items seen with it and merges it over all its records before anything is
shuffled.  Stripes of one item are split by a hash of the neighbour, so that a hot
item's array is spread over ``buckets`` tasks; sorted stripes of one key are then
merged one key at a time.  The number of records travels as a stripe of its own.  The
log-likelihood ratio, its significance and the lift over chance follow from the merged
counts in Catalyst expressions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import notation
from mnemospark.store import Scratch

#: Entries of the associative arrays a task holds before it passes its stripes on.
FLUSH_AT = 400_000
#: Stands for "any record" where the records are counted; no item, as items are stripped.
RECORD = " "
#: Quantiles of the chi-square law with one degree of freedom, by level of significance.
CRITICAL = {0.05: 3.841459, 0.01: 6.634897, 0.001: 10.827566, 0.0001: 15.136705}

_STRIPE = "item string, bucket int, others array<string>, counts array<bigint>"
_STRIPE_ARROW = pa.schema([("item", pa.string()), ("bucket", pa.int32()), ("others", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def baskets(anchors: DataFrame) -> DataFrame:
    """(id, items): the distinct tags of each anchor that has any, one row for each id.

    Rows of one id are brought together; ids and tags are compared stripped and in
    lower case.  Null and blank ids and anchors without a tag are left out.
    """
    rows = anchors.select(notation.key("id").alias("id"), notation.tags("tags_json").alias("items")).filter("id is not null and size(items) > 0")
    per_id = rows.groupBy("id").agg(F.collect_set("items").alias("sets"))
    items = F.when(F.size("sets") == 1, F.col("sets")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("sets"))))
    return per_id.select("id", items.alias("items"))


def _batches(rows: list[tuple[str, int, list[str], list[int]]], size: int = 5_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        cut = list(zip(*rows[k : k + size], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cut, _STRIPE_ARROW, strict=True)], schema=_STRIPE_ARROW)


def _stripes(buckets: int, flush_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        bucket_of: dict[str, int] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for item, neighbours in arrays.items():
                split: dict[int, list[tuple[str, int]]] = defaultdict(list)
                for other, n in neighbours.items():
                    b = bucket_of.get(other)
                    if b is None:
                        b = bucket_of[other] = crc32(other.encode()) % buckets
                    split[b].append((other, n))
                rows += [(item, b, [o for o, _ in part], [n for _, n in part]) for b, part in split.items()]
            arrays.clear()
            bucket_of.clear()
            return _batches(rows)

        for batch in batches:
            for items in batch.column(0).to_pylist():
                if items:
                    arrays[RECORD][RECORD] += 1
                for i, item in enumerate(items):
                    mine = arrays[item]
                    before = len(mine)
                    for other in items[i:]:  # from itself on: the first entry counts the item
                        mine[other] += 1
                    held += len(mine) - before
                    if held >= flush_at:  # a long record may be passed on in parts
                        yield from out()
                        held = 0
        yield from out()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the arrays of equal keys; the rows come sorted by key."""
    key, array, done = None, {}, []
    for batch in batches:
        for item, bucket, others, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (item, bucket) != key:
                if key:
                    done.append((*key, list(array), list(array.values())))
                key, array = (item, bucket), {}
            for o, n in zip(others, counts, strict=True):
                array[o] = array.get(o, 0) + n
        if len(done) >= 5_000:
            yield from _batches(done)
            done = []
    if key:
        done.append((*key, list(array), list(array.values())))
    yield from _batches(done)


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's G2 of the two-by-two table of records with and without either item."""
    d = lambda c: c.cast("double")
    k11, k12, k21 = d(n_ab), d(n_a - n_ab), d(n_b - n_ab)
    k22 = d(n - n_a - n_b + n_ab)
    cells = _xlogx(k11) + _xlogx(k12) + _xlogx(k21) + _xlogx(k22)
    rows = _xlogx(d(n_a)) + _xlogx(d(n - n_a))
    cols = _xlogx(d(n_b)) + _xlogx(d(n - n_b))
    return F.greatest(F.lit(0.0), 2.0 * (cells - rows - cols + _xlogx(d(n))))


def pair_counts(baskets: DataFrame, buckets: int = 32, flush_at: int = FLUSH_AT) -> DataFrame:
    """Every pair of items of a basket: item_a < item_b, n_ab, n_a, n_b, n, lift, llr.

    ``baskets`` has a column ``items`` of sorted distinct strings; n is the number of
    baskets that have an item.  Empty input gives an empty result.  One array holds an
    item's neighbours of one bucket, so ``buckets`` is to grow with the number of items.
    """
    scratch = Scratch(baskets.sparkSession, "cooccur")
    stripes = baskets.select("items").mapInArrow(_stripes(buckets, flush_at), _STRIPE)
    merged = stripes.repartition("item", "bucket").sortWithinPartitions("item", "bucket").mapInArrow(_merged, _STRIPE)
    cells = scratch.keep(
        merged.select("item", F.explode(F.arrays_zip("others", "counts")).alias("e")).select(
            F.col("item").alias("item_a"), F.col("e.others").alias("item_b"), F.col("e.counts").alias("n_ab")
        )
    )
    alone = cells.filter("item_a = item_b").select(F.col("item_a").alias("item"), F.col("n_ab").alias("n"))
    total = alone.filter(F.col("item") == RECORD).agg(F.sum("n")).first()[0] or 0
    n, n_ab, n_a, n_b = F.lit(total).cast("bigint"), F.col("n_ab"), F.col("n_a"), F.col("n_b")
    return (
        cells.filter("item_a < item_b")
        .join(alone.toDF("item_a", "n_a"), "item_a")
        .join(alone.toDF("item_b", "n_b"), "item_b")
        .select(
            "item_a", "item_b", "n_ab", "n_a", "n_b", n.alias("n"),
            (n_ab.cast("double") * n / (n_a.cast("double") * n_b)).alias("lift"),
            log_likelihood_ratio(n_ab, n_a, n_b, n).alias("llr"),
        )
    )


def significant(pairs: DataFrame, level: float = 0.001) -> DataFrame:
    """The pairs seen together more often than chance explains at a level of significance (a key of ``CRITICAL``)."""
    return pairs.filter((F.col("lift") > 1) & (F.col("llr") >= CRITICAL[level]))


def associated_tags(anchors: DataFrame, least: int = 8, times: int = 3) -> DataFrame:
    """Pairs of tags that at least ``least`` anchors carry, ``times`` as often as chance or more, significant at 0.01.

    With r = n_ab / expected the ratio is at least 2 n_ab (ln r - 1 + 1 / r), which is 6.91
    for 8 records and r = 3: with the defaults the test takes no pair away.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    often = wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(times)
    return significant(pair_counts(baskets(anchors)).filter(F.col("n_ab") >= least).filter(often), 0.01)
