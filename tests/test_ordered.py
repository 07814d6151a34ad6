"""Order within groups over range partitions: positions, neighbours, tiles, medians and folds against plain Python."""

from __future__ import annotations

import random
import statistics

from mnemospark.operators import ordered as O
from mnemospark.operators import rebuild, similarity
from mnemospark.store import Scratch


def rows(n=900, seed=5):
    """A third of the rows in one session, ties in time, and a session without a name."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.randint(0, 50), i, rng.uniform(-0.6, 0.6)) for i in range(n)]


def grouped(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def table(spark, data):
    return spark.createDataFrame(data, "session string, at int, id bigint, v double")


def test_positions_and_neighbours(spark):
    data = rows()
    want = {r[2]: (n, g[n][2] if n < len(g) else None) for g in grouped(data).values() for n, r in enumerate(g, 1)}
    scratch = Scratch(spark, "t")
    placed = O.with_position(table(spark, data), ["session"], ["at", "id"], scratch)
    assert {r.id: r.position for r in placed.collect()} == {i: n for i, (n, _) in want.items()}
    nxt = O.with_next(table(spark, data), ["session"], ["at", "id"], ["id"], scratch)
    assert {r.id: r.next_id for r in nxt.collect()} == {i: x for i, (_, x) in want.items()}
    # without groups the whole table is one
    whole = O.with_position(table(spark, data), [], ["at", "id"], scratch)
    assert [r.id for r in whole.orderBy("position").collect()] == [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]


def test_tiles_and_medians(spark):
    data = rows(200)
    scratch = Scratch(spark, "t")
    placed = scratch.keep(O.with_position(table(spark, data), ["session"], ["at", "id"], scratch))
    tiles = O.sizes(placed.filter("session is not null"), ["session"]).select("session", O.tile(placed["position"], placed.filter("session is not null")["position"] * 0 + 7, 3).alias("x"))
    assert tiles.columns == ["session", "x"]
    small = [[1] * (7 // 3 + 1) + [2] * 2 + [3] * 2]
    got = spark.range(1, 8).select(O.tile(O.F.col("id"), O.F.lit(7), 3).alias("t")).collect()
    assert [r.t for r in got] == small[0]
    want = {k: statistics.median(r[3] for r in g) for k, g in grouped(data).items() if k is not None}
    got = {r.session: r["median"] for r in O.medians(table(spark, data).filter("session is not null"), "session", "v", scratch).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_clipped_folds_compose_over_partitions(spark):
    data = [r for r in rows(1200) if r[0] is not None]
    want = {}
    for k, g in grouped(data).items():
        x = 0.5
        for r in g:
            x = min(1.0, max(0.0, x + r[3]))
        want[k] = (len(g), x)
    got = {r.session: (r.n, r["value"]) for r in rebuild.clipped_folds(table(spark, data), "session", ["at", "id"], "v", 0.5).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_empty(spark):
    scratch = Scratch(spark, "t")
    none = table(spark, [])
    assert O.with_position(none, ["session"], ["at", "id"], scratch).count() == 0
    assert O.with_next(none, ["session"], ["at", "id"], ["id"], scratch).count() == 0
    assert rebuild.clipped_folds(none, "session", ["at", "id"], "v", 0.5).count() == 0


def test_nearest_of_many_centroids(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    v = [(i, vec()) for i in range(120)]
    c = [(i, vec()) for i in range(300)]
    got = similarity.nearest_centroid(spark.createDataFrame(v, "id bigint, embedding array<double>"), spark.createDataFrame(c, "label int, centroid array<double>"), "label", rows=50)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    assert {r.id: r.to_label for r in got.collect()} == {i: max(c, key=lambda k: cos(e, k[1]))[0] for i, e in v}
