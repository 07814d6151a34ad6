"""Snapshots, log replay, shards, streams, and independence of the llm subpackage."""

from __future__ import annotations

import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import search, similarity
from mnemospark.sources import snapshots as S
from mnemospark.streaming import windows as WI


def test_versions_rollback_and_cleaning(spark, tmp_path):
    store = S.SnapshotStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        store.load("t")
    for n in (1, 2, 3):
        assert store.save({"t": spark.range(n)}) == n
    assert store.load("t").count() == 3 and store.load("t", at=2).count() == 2
    store.rollback(2)
    assert store.versions() == [1, 2] and store.load("t").count() == 2
    assert store.clean(1) == [1] and store.versions() == [2]


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    store = S.SnapshotStore(spark, f"file://{tmp_path}/s")
    store.save({"t": spark.range(1)})
    spark.range(9).write.parquet(f"file://{tmp_path}/s/version=2/t")
    assert store.load("t").count() == 1


def test_replay_takes_the_last_operation(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    log = spark.createDataFrame(
        [(1, 5.0, "put", "a", ("a", 10)), (2, 5.0, "remove", "a", None), (3, 6.0, "put", "d", ("d", 4)), (4, 0.5, "remove", "c", None), (5, 7.0, "put", "b", ("b", 20))],
        "seq int, at double, op string, id string, row struct<id:string,v:int>",
    )
    assert sorted(map(tuple, S.replayed(base, log, "id", 1.0).collect())) == [("b", 20), ("c", 3), ("d", 4)]
    assert sorted(map(tuple, S.upserted(base, base.limit(1).withColumn("v", F.lit(9)), "id").collect()))[0] == ("a", 9)
    assert S.deleted(base, base.limit(2), "id").count() == 1


def test_shards_prune(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0, "x"), ("b", 9e6, "y"), ("c", 9e6, "x")], "id string, created_at double, d string")
    S.save_sharded(df, f"file://{tmp_path}/p", F.col("d"))
    back = spark.read.parquet(f"file://{tmp_path}/p")
    assert back.count() == 3 and {r.bucket for r in back.collect()} == {"1970_Q1", "1970_Q2"}
    plan = back.filter("domain = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan


def events(spark, rows):
    t = datetime(2025, 1, 1)
    return spark.createDataFrame([(i, t + timedelta(minutes=m), u, k, float(v)) for i, (m, u, k, v) in enumerate(rows)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")


ROWS = [(0, 1, "a", 1), (30, 1, "a", 2), (61, 2, "b", 3), (200, 1, "a", 4), (200, 1, "a", 5)]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    df = events(spark, ROWS)
    df.write.parquet(f"{tmp_path}/in")
    stream = WI.watermarked(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = WI.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, WI.tumbling(df).collect()))


def test_ingest_stores_every_row_once(spark, tmp_path):
    df = events(spark, ROWS)
    for n in range(3):
        df.filter(F.col("event_id") % 3 == n).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        WI.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/c2", lambda b: b.withColumn("seen", F.lit(True))).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(ROWS)


def test_sessions_dedup_and_debounce(spark):
    df = events(spark, ROWS)
    assert sorted((r.user_id, r.n) for r in WI.sessions(df).collect()) == [(1, 2), (1, 2), (2, 1)]
    assert sorted(r.event_id for r in WI.deduplicated(df, "user_id", "event_type").collect()) == [0, 2]
    assert sorted(r.event_id for r in WI.debounced(df, 3600, "user_id").collect()) == [0, 2, 3]


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([("1", "Redis connection timeout is 30 seconds"), ("2", "MySQL query timeout is 60 seconds"), ("3", "HTTP request timeout is 10 seconds"), ("4", None), ("5", "")], "id string, text string")
    got = search.bm25(docs, "redis timeout").orderBy(F.desc("score")).collect()
    assert got[0].id == "1" and len(got) == 3
    assert search.bm25(docs, "?").count() == 0
    assert [r.id for r in search.ranked(search.bm25(docs, "timeout"), 2).collect()] == ["1", "2"]


def test_similarity_in_one_block_or_many(spark):
    import numpy as np

    v = np.random.default_rng(0).standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, [1.0] * 8), (99, None)], "id bigint, embedding array<double>")
    df = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    one = sorted((r.a, r.b) for r in similarity.similar_pairs(df, 0.5, 1).collect())
    assert one == sorted((r.a, r.b) for r in similarity.similar_pairs(df, 0.5, 4).collect()) and one
    k1 = sorted((r.id, r.rank, r.other) for r in similarity.knn(df, 3, 1).collect())
    assert k1 == sorted((r.id, r.rank, r.other) for r in similarity.knn(df, 3, 3).collect()) and len(k1) == 180


def test_leaders_within_bounded_parts(spark):
    rows = [(i, 1.0 - i / 100, [1.0, float(i % 2) * 9], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, importance double, embedding array<double>, label int")
    got = {r.id: r.leader for r in similarity.leader_clusters(df, "label", 0.9).collect()}
    assert got == {i: i % 2 for i in range(40)}
    parts = similarity.leader_clusters(df, "label", 0.9, rows=10)
    assert parts.count() == 40 and 2 <= parts.select("leader").distinct().count() <= 8


def test_leaders_do_not_depend_on_the_size_of_parts(spark):
    import numpy as np

    v = np.random.default_rng(4).standard_normal((90, 6))
    rows = [(i, float(i % 5), [float(x) for x in r], None if i < 70 else i % 2) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id bigint, importance double, embedding array<double>, label int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want, leaders = {}, {}
    for i in sorted(range(90), key=lambda i: (-rows[i][1], i)):
        own = leaders.setdefault(rows[i][3], [])
        want[i] = next((x for x in own if u[x] @ u[i] > 0.6), i)
        own += [i] * (want[i] == i)
    for size in (10, 25, 10_000):
        got = [(r.id, r.leader) for r in similarity.leader_clusters(df, "label", 0.6, rows=size).collect()]
        assert len(got) == 90 and dict(got) == want


def test_core_does_not_need_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('mnemospark.llm'): raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and 'p3_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
