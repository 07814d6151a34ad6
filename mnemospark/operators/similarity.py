"""Exact similarity joins of vectors in blocks.

Vectors are hashed into blocks of a fixed size; one task multiplies two blocks and
passes on only pairs above a threshold, or each vector's k best.  Memory of a task is
bounded by the block size; the work is that of all pairs, which is what these
operators ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemospark.store import Scratch

#: Vectors of a block; a task holds two.
BLOCK_ROWS = 16_384
_TILE = 1_024

#: Vectors of a block of ``similar_pairs``, which holds no more than a tile of products: each vector
#: is sent once for every block.
PAIR_ROWS = 65_536

#: Most partitions of a join; beyond it several pairs of blocks share one.
MOST_PARTITIONS = 20_000

Block = tuple[np.ndarray, np.ndarray]


def _sides(vectors: DataFrame, blocks: int) -> DataFrame:
    """Every vector once for each pair of blocks (i <= j) that its block is in; a pair's rows come in a row."""
    rows = vectors.filter("id is not null and embedding is not null and size(embedding) > 0").select(
        "id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    )
    sides = rows.select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "embedding")
    tasks = blocks * (blocks + 1) // 2
    number = (F.col("i") * blocks - (F.col("i") * (F.col("i") - 1) / 2).cast("int") + F.col("j") - F.col("i")).cast("int")
    out = sides.repartitionById(min(tasks, MOST_PARTITIONS), F.pmod(number, F.lit(min(tasks, MOST_PARTITIONS))))
    return out.sortWithinPartitions("i", "j") if tasks > MOST_PARTITIONS else out


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """One pair of blocks after another: its keys (i and j the last) and each block's ids in order with their vectors."""
    now, held = None, {}

    def done() -> tuple:
        out = {}
        for b, xs in held.items():
            ids, v = np.concatenate([x[0] for x in xs]), np.concatenate([x[1] for x in xs])
            order = np.argsort(ids, kind="stable")
            out[b] = ids[order], v[order]
        return (*now, out)

    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, block = (np.asarray(c) for c in batch.columns[:-2])
        cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if (pair := tuple(k[a] for k in keys)) != now:
                if now is not None:
                    yield done()
                now, held = pair, {}
            for x in np.unique(block[a:b]):
                own = batch.take(pa.array(a + np.flatnonzero(block[a:b] == x)))
                flat = np.asarray(own.column(len(keys) + 2).flatten(), dtype=np.float64)
                held.setdefault(int(x), []).append((np.asarray(own.column(len(keys) + 1)), flat.reshape(own.num_rows, -1)))
    if now is not None:
        yield done()


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None] + 1e-8)


def _above(a: np.ndarray, b: np.ndarray, over: float, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``a``, rows of ``b`` and the cosine of their pairs above ``over``, tile by tile.

    Products in single precision, with room for their error, say which pairs are worked
    out in double precision.  ``half``: both are the same, and of every two rows one pair is enough.
    """
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    unit = lambda v, n: (v / np.where(n > 0, n, 1)[:, None]).astype(np.float32)
    ua, ub = unit(a, na), unit(b, nb)
    # the 1e-8 of the definition draws a cosine towards 0, by less than the room unless vectors are tiny
    tiny = min(na.min(initial=1.0), nb.min(initial=1.0)) < 1e-2
    least = -2.0 if tiny else over - 1e-3
    for s in range(0, len(a), _TILE):
        for t in range(s // (4 * _TILE) * 4 * _TILE if half else 0, len(b), 4 * _TILE):
            tile = ua[s : s + _TILE] @ ub[t : t + 4 * _TILE].T
            near = np.flatnonzero(tile.ravel() > least)
            for k in range(0, len(near), PAIR_ROWS):
                x, y = np.divmod(near[k : k + PAIR_ROWS], tile.shape[1])
                x, y = x + s, y + t
                if half:
                    x, y = x[x < y], y[x < y]
                cos = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y] + 1e-8)
                keep = cos > over
                if keep.any():
                    yield x[keep], y[keep], cos[keep]


def similar_pairs(vectors: DataFrame, over: float, blocks: int | None = None) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs of (id, embedding) whose cosine is above ``over``; ids are numbers or strings.

    Repeated ids are compared as they come; rows without an id or vector are left out.
    All vectors must have the same length.
    """
    n = 0 if blocks else vectors.count()
    blocks = blocks or max(1, ceil(n / PAIR_ROWS), min(4, ceil(n / BLOCK_ROWS)))
    kind = dict(vectors.dtypes)["id"]
    arrow = to_arrow_type(vectors.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, own in _tasks(batches):
            if i not in own or j not in own:
                continue
            (ia, va), (ib, vb) = own[i], own[j]
            for r, c, found in _above(va, vb, over, i == j):
                left, right = ia[r], ib[c]
                keep = left != right
                left, right, found = left[keep], right[keep], found[keep]
                # without the types an array of no strings would be one of nulls
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right), arrow), pa.array(np.maximum(left, right), arrow), pa.array(found)], names=["a", "b", "cosine"])

    return _sides(vectors, blocks).mapInArrow(run, f"a {kind}, b {kind}, cosine double")


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The numbers of edges (u, v) between ``n`` nodes that join all that the edges join, fewer than ``n``."""
    root, kept, left = np.arange(n), [], np.arange(len(u))
    while True:
        x, y = root[u[left]], root[v[left]]
        apart = x != y
        if not apart.any():
            return np.concatenate([*kept, left[:0]])
        left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        # each root hangs onto one lesser root
        hung, first = np.unique(high, return_index=True)
        kept.append(left[first])
        root[hung] = low[first]
        while (root[root] != root).any():
            root = root[root]


def alike_within(vectors: DataFrame, by: str, over: float, rows: int = 2 * BLOCK_ROWS) -> DataFrame:
    """(a, b): pairs of (id, embedding) of one group whose cosine is above ``over``, as many as join all such pairs.

    Only vectors of one group meet.  A group of more than ``rows`` is cut into blocks, and
    each task passes on fewer pairs than it has vectors, with the same components.
    """
    usable = vectors.filter(f"id is not null and embedding is not null and size(embedding) > 0 and `{by}` is not null").select(F.col(by).alias("g"), "id", "embedding")
    parts = usable.groupBy("g").agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    sent = usable.join(parts, "g").select("g", "id", "embedding", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("block"), every.alias("o"))
    sides = sent.select("g", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "embedding")
    kind = dict(vectors.dtypes)["id"]
    arrow = to_arrow_type(vectors.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own in _tasks(batches):
            if i not in own or j not in own:
                continue
            (ia, va), (ib, vb) = own[i], own[j]
            ids, shift = (ia, 0) if i == j else (np.concatenate([ia, ib]), len(ia))
            u = v = np.empty(0, dtype=np.int64)
            for r, c, _ in _above(va, vb, over, i == j):
                u, v = np.concatenate([u, r]), np.concatenate([v, c + shift])
                if len(u) > 8 * PAIR_ROWS:
                    keep = _forest(u, v, len(ids))
                    u, v = u[keep], v[keep]
            keep = _forest(u, v, len(ids))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u[keep]], arrow), pa.array(ids[v[keep]], arrow)], names=["a", "b"])

    return sides.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, f"a {kind}, b {kind}")


def knn(vectors: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(id, other, cosine, rank) of each vector's k most similar others; ties to the lesser id."""
    blocks = blocks or max(1, ceil(vectors.count() / BLOCK_ROWS))

    kind = dict(vectors.dtypes)["id"]
    arrow = to_arrow_type(vectors.schema["id"].dataType)

    def best(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(a), _TILE):
            cos = np.round(_cosines(a[s : s + _TILE], b), 12)
            mine = ids[s : s + _TILE]
            cos[mine[:, None] == others[None]] = -9
            take = np.argsort(-cos, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(cos, take, 1)
            keep = found.ravel() > -9
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(mine, take.shape[1])[keep], arrow), pa.array(others[take].ravel()[keep], arrow), pa.array(found.ravel()[keep])], names=["id", "other", "cosine"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, own in _tasks(batches):
            for p, q in sorted({(i, j), (j, i)}):
                if p in own and q in own:
                    yield from best(*own[p], *own[q])

    found = _sides(vectors, blocks).mapInArrow(run, f"id {kind}, other {kind}, cosine double")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, n, centroid): the mean vector of each group, with partial sums before the shuffle."""
    size = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(size)]
    return vectors.groupBy(by).agg(F.count("*").alias("n"), F.array(*means).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, by: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, to_<by>, cosine): the centroid (by, centroid) that is nearest to each vector (id, embedding), ties to the lesser.

    Vectors and centroids are hashed into blocks of about ``rows``; one task multiplies a
    block of each, so any number of centroids is covered and no task grows.
    """
    import pandas as pd

    left, right = max(1, ceil(vectors.count() / rows)), max(1, ceil(centroids.count() / rows))
    kind, label = dict(vectors.dtypes)["id"], dict(centroids.dtypes)[by]
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.filter("embedding is not null").select("id", "embedding", of("id", left).alias("i"), every(right).alias("j"))
    c = centroids.filter("centroid is not null").select(F.col(by).alias("k"), "centroid", every(left).alias("i"), of(by, right).alias("j"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": a.id[:0], "to": b.k[:0], "cosine": np.array([])})
        b = b.sort_values("k")
        cos = np.round(_cosines(np.array(a.embedding.tolist(), dtype=np.float64), np.array(b.centroid.tolist(), dtype=np.float64)), 9)
        at = cos.argmax(1)
        return pd.DataFrame({"id": a.id.to_numpy(), "to": b.k.to_numpy()[at], "cosine": cos[np.arange(len(a)), at]})

    found = v.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInPandas(best, f"id {kind}, to {label}, cosine double")
    first = F.min(F.struct((-F.col("cosine")).alias("least"), "to", "cosine")).alias("b")
    return found.groupBy("id").agg(first).select("id", F.col("b.to").alias(f"to_{by}"), "b.cosine")


def leader_clusters(vectors: DataFrame, block: str, over: float, rows: int = 10_000) -> DataFrame:
    """(block, id, leader): greedy leaders within each block, in the order of importance and id.

    A vector joins the first leader whose cosine is above ``over``, else it leads.  Blocks
    of more than ``rows`` vectors go by rounds: the first ``rows`` that are left elect
    leaders in one task, the others meet the new leaders in parts of about ``rows``, and
    those that join none are left for the next round.  The result is that of one task
    over the whole block.
    """
    import pandas as pd

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        v = np.array(pdf.embedding.tolist(), dtype=np.float64)
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["importance", "id"], ascending=[False, True])
        v = unit(pdf)
        leaders: list[int] = []
        out = []
        for i in range(len(v)):
            cos = v[leaders] @ v[i] if leaders else np.array([])
            hit = np.flatnonzero(cos > over)
            if len(hit):
                out.append(leaders[hit[0]])
            else:
                leaders.append(i)
                out.append(i)
        ids = pdf.id.to_numpy()
        return pd.DataFrame({"block": pdf[block].to_numpy(), "id": ids, "leader": ids[out]})

    def meet(rest: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        first = np.full(len(rest), -1)
        if len(rest) and len(leaders):
            leaders = leaders.sort_values(["importance", "id"], ascending=[False, True])
            a, b = unit(rest), unit(leaders)
            for s in range(0, len(a), _TILE):
                hit = a[s : s + _TILE] @ b.T > over
                first[s : s + _TILE] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        ids = leaders.id.to_numpy()
        return rest[[block, "id", "importance", "embedding"]].assign(leader=pd.array([ids[x] if x >= 0 else None for x in first], dtype="Int64"))

    types = dict(vectors.dtypes)
    found = f"block {types[block]}, id bigint, leader bigint"
    left = vectors.filter("embedding is not null").select(block, "id", "importance", "embedding")
    scratch, out = Scratch(vectors.sparkSession, "leaders"), None
    while True:
        sizes = left.groupBy(F.col(block).alias("_block")).agg(F.ceil(F.count("*") / rows).alias("_parts"))
        if (sizes.agg(F.max("_parts")).first()[0] or 0) <= 1:
            last = left.groupBy(block).applyInPandas(run, found)
            return last if out is None else out.unionByName(last)
        place = F.row_number().over(W.partitionBy(block).orderBy(F.col("importance").desc_nulls_last(), "id"))
        placed = scratch.keep(left.withColumn("_place", place))
        head = placed.filter(F.col("_place") <= rows)
        elected = scratch.keep(head.groupBy(block).applyInPandas(run, found))
        parts = scratch.keep(sizes)
        rest = placed.filter(F.col("_place") > rows).join(parts, F.col(block).eqNullSafe(F.col("_block")))
        rest = rest.select(block, "id", "importance", "embedding", F.pmod(F.xxhash64("id"), F.col("_parts")).alias("_part"))
        new = elected.filter("id = leader").select(F.col("block").alias("_of"), F.col("id").alias("_id"))
        lead = head.join(new, F.col(block).eqNullSafe(F.col("_of")) & (F.col("id") == F.col("_id"))).join(parts, F.col(block).eqNullSafe(F.col("_block")))
        lead = lead.select(block, "id", "importance", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("_part"))
        lead = lead.toDF(*lead.columns)  # columns of its own, as both sides come from one table
        met = rest.groupBy(block, "_part").cogroup(lead.groupBy(block, "_part")).applyInPandas(
            meet, f"`{block}` {types[block]}, id bigint, importance {types['importance']}, embedding {types['embedding']}, leader bigint"
        )
        met = scratch.keep(met)
        joined = met.filter("leader is not null").select(F.col(block).alias("block"), "id", "leader")
        both = elected.unionByName(joined)
        out = both if out is None else out.unionByName(both)
        left = met.filter("leader is null").drop("leader")


def inhibit(candidates: DataFrame, over: float = 0.7, penalty: float = 0.3, k: int = 20) -> DataFrame:
    """(id, total): winner-take-all over candidates (id, total, embedding), a list that the caller bounds.

    In the order of their totals, a candidate loses the share ``penalty`` times its
    greatest cosine with those kept before it, if that is above ``over``, and drops out
    where the loss is beyond 0.5.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["total", "id"], ascending=[False, True])
        v = np.array(pdf.embedding.tolist(), dtype=np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-8
        kept: list[int] = []
        totals = []
        for i, t in enumerate(pdf.total):
            cos = v[kept] @ v[i] if kept else np.array([0.0])
            loss = float(penalty * cos[cos > over].max(initial=0.0))
            if loss <= 0.5:
                kept.append(i)
                totals.append(t * (1 - loss))
        out = pd.DataFrame({"id": pdf.id.to_numpy()[kept], "total": totals})
        return out.sort_values(["total", "id"], ascending=[False, True]).head(k)

    return candidates.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "id bigint, total double")
