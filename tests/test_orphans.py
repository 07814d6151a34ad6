"""Orphan references: brute force, batches in any split, deletions and hot keys."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from mnemospark.operators import orphans as O
from mnemospark.sources.tables import table
from mnemospark.streaming.orphans import OrphanSink
from mnemospark.store import Scratch

DAY = datetime(2025, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def refs(spark, rows):
    return spark.createDataFrame([("t.f", r, "p", k, at(n)) for r, k, n in rows], O.REFERENCE)


def parents(spark, rows):
    return spark.createDataFrame([("p", k, at(n)) for k, n in rows], O.PARENT)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


REFS = [("r1", "a", 5), ("r2", "a", 1), ("r3", "missing", 2), ("r4", "b", 3), ("r4", "b", 9), ("r5", None, 1), ("r6", "c", 6)]
PARENTS = [("a", 4), ("a", 8), ("b", 3), ("c", 2), (None, 1)]
GONE = [("c", 7)]


def brute():
    first, seen = {}, {}
    for k, n in PARENTS:
        if k is not None:
            first[k] = min(n, first.get(k, n))
    for r, k, n in REFS:
        if k is not None:
            seen[r, k] = min(n, seen.get((r, k), n))
    return sorted(("t.f", r, k) for (r, k), n in seen.items() if k not in first or first[k] > n)


def test_one_batch_equals_brute_force(spark):
    state = O.advance(O.OrphanState.empty(spark), refs(spark, REFS), parents(spark, PARENTS), parents(spark, GONE))
    assert rows(O.orphans(state)) == brute()


def test_any_split_by_time_gives_the_same_state(spark):
    whole = O.advance(O.OrphanState.empty(spark), refs(spark, REFS), parents(spark, PARENTS), parents(spark, GONE))
    state = O.OrphanState.empty(spark)
    for low, high in ((0, 3), (3, 4), (4, 7), (7, 99)):
        part = lambda xs: [x for x in xs if low <= x[-1] < high]  # noqa: B023, E731
        state = O.advance(state, refs(spark, part(REFS)), parents(spark, part(PARENTS)), parents(spark, part(GONE)))
    assert rows(O.orphans(state)) == brute()
    assert rows(O.snapshot(state)) == rows(O.snapshot(whole))


def test_deletion_reopens_and_return_resolves(spark):
    state = O.advance(O.OrphanState.empty(spark), refs(spark, [("r", "c", 6), ("late", "x", 1)]), parents(spark, [("c", 2)]), parents(spark, [("c", 7)]))
    kinds = {(r["kind"], r["n"]) for r in O.snapshot(state).collect()}
    assert kinds == {("reopened", 1), ("waiting", 1)}
    state = O.advance(state, refs(spark, []), parents(spark, [("c", 9), ("x", 9)]))
    # c was there in time and is back; x came late and stays on record as resolved
    assert {(r["kind"], r["n"]) for r in O.snapshot(state).collect()} == {("resolved", 1)}


def test_empty_tables(spark):
    state = O.advance(O.OrphanState.empty(spark), refs(spark, []), parents(spark, []))
    assert rows(O.orphans(state)) == [] and rows(O.snapshot(state)) == []


def test_a_hot_missing_key(spark):
    many = [(f"r{i}", "hot", 1) for i in range(3000)] + [(f"s{i}", f"k{i}", 1) for i in range(6000)]
    state = O.advance(O.OrphanState.empty(spark), refs(spark, many), parents(spark, [(f"k{i}", 0) for i in range(6000)]))
    assert O.orphans(state).count() == 3000


def test_memory_tables_with_dirty_rows_and_extra_columns(spark):
    edges = spark.createDataFrame(
        [(1, " A1 ", "b", at(2), 0), (1, " A1 ", "b", at(5), 0), (2, None, "", at(2), 0), (3, "a1", "nowhere", at(9), 0), (None, "x", "y", at(1), 0)],
        "edge_id bigint, source string, target string, loaded_at timestamp, target_key int",
    )
    anchors = spark.createDataFrame([("a1", "S ", at(3), 1), ("b", None, at(1), 1), ("b", " ", at(1), 1), (None, "s", at(1), 1)], "id string, schema_ref string, loaded_at timestamp, ks int")
    schemas = spark.createDataFrame([("s", '["b", "gone", "gone"]', at(3)), ("t", None, at(3))], "id string, instance_ids_json string, loaded_at timestamp")
    state = O.advance(O.OrphanState.empty(spark), O.memory_references(edges, anchors, schemas), O.memory_parents(anchors, schemas))
    assert rows(O.orphans(state)) == [("edges.source", "1", "a1"), ("edges.target", "3", "nowhere"), ("schemas.instance_ids_json", "s", "gone")]


def test_periods_end_like_one_batch(spark):
    months = [(r, k, n * 20) for r, k, n in REFS if k is not None]
    owned = [(k, n * 20) for k, n in PARENTS if k is not None]
    last = None
    for _, last in O.periods(O.OrphanState.empty(spark), refs(spark, months), parents(spark, owned), parents(spark, [("c", 140)])):
        pass
    whole = O.advance(O.OrphanState.empty(spark), refs(spark, months), parents(spark, owned), parents(spark, [("c", 140)]))
    assert rows(O.snapshot(last)) == rows(O.snapshot(whole))


def test_periods_count_rows_without_a_time(spark):
    timed, owned, gone = [("r1", "a", 20), ("r2", None, None), ("r3", "x", None)], [("a", 50), ("y", None)], [("a", None)]
    got = list(O.periods(O.OrphanState.empty(spark), refs(spark, timed), parents(spark, owned), parents(spark, gone), scratch=Scratch(spark, "t")))
    assert [p for p, _ in got] == [None, datetime(2025, 1, 1), datetime(2025, 2, 1)]
    whole = O.advance(O.OrphanState.empty(spark), refs(spark, timed), parents(spark, owned), parents(spark, gone))
    count = lambda s: sorted(((r["period"], r["kind"], r["n"]) for r in O.snapshot(s).collect()), key=str)
    assert count(got[-1][1]) == count(whole) and (None, "waiting", 1) in count(whole)


def test_an_anchor_loaded_again_after_its_pruning_is_there(spark, tmp_path):
    from mnemospark.plans.corpus import p3_counts

    edges = [(1, "a", "b", at(6))]
    anchors = [("a", None, at(1)), ("A ", None, at(70)), ("b", None, at(1)), ("b", None, at(1))]
    spark.createDataFrame(edges, "edge_id bigint, source string, target string, loaded_at timestamp").write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame(anchors, "id string, schema_ref string, loaded_at timestamp").write.parquet(f"{tmp_path}/anchors.parquet")
    spark.createDataFrame([], "id string, instance_ids_json string, loaded_at timestamp").write.parquet(f"{tmp_path}/schemas.parquet")
    spark.createDataFrame([("a", at(40).timestamp())], "id string, pruned_at double").write.parquet(f"{tmp_path}/ghosts.parquet")
    got = [(r.as_of.month, r.ref_field, r.kind, r.n) for r in p3_counts(spark, str(tmp_path)).collect()]
    # pruned in February, loaded again in March
    assert got == [(2, "edges.source", "reopened", 1)]


def test_stream_sink_skips_replayed_batches(spark):
    sink = OrphanSink(O.OrphanState.empty(spark), Scratch(spark, "t"), lambda b: (b, parents(spark, []), None))
    sink(refs(spark, [("r", "k", 1)]), 0)
    sink(refs(spark, [("other", "k", 1)]), 0)
    assert rows(O.orphans(sink.state)) == [("t.f", "r", "k")]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_runs_on_test_tables(spark):
    from mnemospark.plans.corpus import p3_found

    assert p3_found(spark, "/root/testdata/sf0.001").columns == ["ref_field", "record_key", "missing_key"]
    assert table(spark, "/root/testdata/sf0.001", "edges").count() > 0


def test_a_stream_that_starts_again_keeps_its_state(spark, tmp_path):
    make = lambda: OrphanSink(O.OrphanState.empty(spark), Scratch(spark, "t"), lambda b: (b[0], parents(spark, b[1]), parents(spark, b[2])), str(tmp_path))
    sink = make()
    sink((refs(spark, [("r", "k", 1), ("s", "j", 3)]), [("j", 2)], []), 0)
    sink((refs(spark, [("t", "l", 4)]), [], []), 1)
    again = make()
    again((refs(spark, [("lost", "x", 4)]), [], []), 1)
    assert rows(O.orphans(again.state)) == [("t.f", "r", "k"), ("t.f", "t", "l")]
    # the deletion reopens a reference that only the log holds; the return closes it
    again((refs(spark, []), [("k", 5)], [("j", 6)]), 2)
    assert {(r["kind"], r["n"]) for r in O.snapshot(again.state).collect()} == {("waiting", 1), ("resolved", 1), ("reopened", 1)}
    last = make()
    last((refs(spark, []), [("j", 7)], []), 3)
    assert {(r["kind"], r["n"]) for r in O.snapshot(last.state).collect()} == {("waiting", 1), ("resolved", 1)}


def test_a_batch_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    own = O.OrphanStore(spark, str(tmp_path))
    own.apply(1, refs(spark, [(f"r{i}", f"k{i}", 1) for i in range(200)]), parents(spark, [(f"k{i}", 0) for i in range(100)]))
    own.apply(2, refs(spark, []), parents(spark, [("k150", 2)]))
    assert sorted(set(own.manifest["index"].values())) == [1, 2] and list(own.manifest["index"].values()).count(2) == 1
    assert {(r["kind"], r["n"]) for r in O.snapshot(own.state()).collect()} == {("waiting", 99), ("resolved", 1)}


def test_queries_over_empty_tables(spark, tmp_path):
    from mnemospark.plans.corpus import p3_counts, p3_found

    for name, schema in (
        ("edges", "edge_id bigint, source string, target string, loaded_at timestamp"), ("anchors", "id string, schema_ref string, loaded_at timestamp"),
        ("schemas", "id string, instance_ids_json string, loaded_at timestamp"), ("ghosts", "id string, pruned_at double"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p3_found(spark, str(tmp_path)).count() == 0 and p3_counts(spark, str(tmp_path)).count() == 0


def test_a_hot_key_over_batches_of_a_store(spark, tmp_path):
    own = O.OrphanStore(spark, str(tmp_path))
    own.apply(1, refs(spark, [(f"r{i}", "hot", 1) for i in range(2000)]), parents(spark, []))
    own.apply(2, refs(spark, [(f"r{i}", "hot", 5) for i in range(1000, 3000)]), parents(spark, [("hot", 3)]))
    # the earliest time counts: the first 2000 came before their parent, the others after it
    assert O.orphans(own.state()).count() == 2000
    own.apply(3, refs(spark, []), parents(spark, []), parents(spark, [("hot", 9)]))
    counts = O.snapshot(own.state()).collect()
    assert {r["kind"] for r in counts} == {"reopened"} and sum(r["n"] for r in counts) == 3000
