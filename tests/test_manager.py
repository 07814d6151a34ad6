"""The store behind one object."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemospark.manager import MemoryManager
from mnemospark.sources.memory import AS_OF


def ids(m):
    return {r.text: r.id for r in m.anchors().collect()}


def test_life_of_a_store(spark, tmp_path):
    m = MemoryManager(spark, f"file://{tmp_path}/m")
    texts = ["Redis connection timeout is 30 seconds", "MySQL query timeout is 60 seconds", "The user likes tea"]
    m.remember([{"text": t, "tags": ["db"] if "timeout" in t else [], "importance": 0.9} for t in texts] + [{"text": " "}, {"text": None}], AS_OF - 3600)
    m.remember([{"text": texts[0], "importance": 0.1}], AS_OF - 60)
    a = {r.text: r for r in m.anchors().collect()}
    assert set(a) == set(texts) and a[texts[0]].last_at == AS_OF - 60 and a[texts[0]].importance == 0.9
    of = ids(m)
    edges = [(of[texts[0]], of[texts[1]], 0.5, "causes"), (of[texts[1]], of[texts[0]], 0.4, "topical"), (of[texts[0]], "unknown", 0.5, "causes"), (of[texts[2]], of[texts[2]], 0.5, "causes")]
    m.connect(spark.createDataFrame(edges, "src string, dst string, weight double, edge_type string"), AS_OF - 30)
    p = m.pairs().collect()
    assert len(p) == 1 and p[0].edge_type == "causes" and p[0].weight == pytest.approx(0.6)
    m.connect(spark.createDataFrame(edges[:1], "src string, dst string, weight double, edge_type string"), AS_OF - 20)
    assert m.pairs().first().weight == pytest.approx(0.65)
    hits = m.recall("redis timeout", 3).orderBy("rank").collect()
    assert hits[0].id == of[texts[0]] and [h.rank for h in hits] == [1, 2, 3]
    m.update(spark.createDataFrame([(of[texts[2]], None, ["drink", "db"])], "id string, text string, tags array<string>"), AS_OF)
    assert m.anchors().filter(F.col("id") == of[texts[2]]).first().tags == ["db", "drink"]
    before = m.store.versions()[-1]
    m.forget(spark.createDataFrame([(of[texts[0]],), ("unknown",)], "id string"), AS_OF)
    g = m.ghosts().collect()
    assert len(g) == 1 and g[0].residual == pytest.approx({of[texts[1]]: 0.65 * 0.3})
    assert m.anchors().count() == 2 and m.pairs().count() == 0
    one = spark.createDataFrame([(of[texts[0]], "Redis again")], "id string, text string")
    m.revive(one.select("id"), one, AS_OF)
    back = m.anchors().filter(F.col("text") == "Redis again").first()
    assert back.id == of[texts[0]] and back.state == "reactivated" and m.ghosts().count() == 0
    m.store.rollback(before)
    assert m.anchors().count() == 3 and m.pairs().count() == 1
    report = m.consolidate()
    assert report["anchors_before"] == 3 and report["anchors_after"] + report["ghosts"] == 3
    s = m.stats(AS_OF)
    assert s["anchors"] == report["anchors_after"] and s["ghosts"] == report["ghosts"]


def test_gate_keeps_noise_out(spark, tmp_path):
    m = MemoryManager(spark, f"file://{tmp_path}/m")
    m.remember([{"text": "ok"}, {"text": "The deployment failed because of a config error today", "tags": ["error"]}], AS_OF, gate=True)
    assert m.anchors().count() == 1
