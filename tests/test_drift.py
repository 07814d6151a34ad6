"""Schema drift: each kind of change, second loads, bad lines, and the unified tables."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mnemospark.operators import drift as D
from mnemospark.store import Scratch

SCHEMA = "store_name string, file_name string, exported_at timestamp, loaded_at timestamp, line_no int, record_kind string, payload string"
DAY = datetime(2025, 1, 1)


def lines(spark, files, extra=()):
    """files: (name, kind, export day, [payload dicts or strings])"""
    rows = []
    for name, kind, day, payloads in files:
        for n, p in enumerate(payloads):
            t = DAY + timedelta(days=day)
            rows.append(("s", name, t, t, n, kind, p if isinstance(p, str) or p is None else json.dumps(p)))
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def found(df):
    return sorted((r.file_name, r.record_kind, r.change_kind, r.old_name, r.new_name) for r in D.changes(df).collect())


def test_each_kind_of_change(spark):
    df = lines(spark, [
        ("f1", "anchor", 1, [{"id": "a", "state": "x", "n": 1, "old": True}, {"id": "b", "state": "y", "n": 2, "old": None}]),
        ("f2", "anchor", 2, [{"id": "a", "status": "x", "n": "1", "new": [1]}, {"id": "b", "status": "y", "n": "2"}]),
    ])
    assert found(df) == sorted([
        ("f2", "anchor", "renamed", "state", "status"), ("f2", "anchor", "retyped", "n", "n"),
        ("f2", "anchor", "removed", "old", ""), ("f2", "anchor", "added", "", "new"),
    ])


def test_two_renames_of_fields_with_equal_values(spark):
    df = lines(spark, [
        ("f1", "anchor", 1, [{"id": i, "a": True, "b": True, "c": i} for i in "pq"]), ("f2", "anchor", 2, [{"id": i, "x": True, "y": True, "z": i} for i in "pq"]),
    ])
    assert found(df) == [("f2", "anchor", "renamed", "a", "x"), ("f2", "anchor", "renamed", "b", "y"), ("f2", "anchor", "renamed", "c", "z")]


def test_values_that_do_not_stay_are_no_rename(spark):
    df = lines(spark, [("f1", "edge", 1, [{"source": "a", "target": "b", "w": 1}]), ("f2", "edge", 2, [{"source": "a", "target": "b", "v": 2}])])
    assert found(df) == [("f2", "edge", "added", "", "v"), ("f2", "edge", "removed", "w", "")]


def test_second_loads_bad_lines_and_kinds_of_their_own(spark):
    late = DAY + timedelta(days=30)
    df = lines(spark, [
        ("f1", "anchor", 1, [{"id": "a", "x": 1}, '{"id": "b", "x":']), ("f2", "edge", 2, [{"source": "a", "target": "b"}]),
        ("f3", "anchor", 3, [{"id": "a", "x": None}, None, "[1]", "7"]),
    ], extra=[("s", "f1", DAY + timedelta(days=1), late, 0, "anchor", '{"id": "a", "y": 1}')])
    # f3 keeps the field, though null; the broken line and the second load of f1 count nothing
    assert found(df) == []


def test_null_types_are_not_retyped_and_numbers_are_one_type(spark):
    df = lines(spark, [("f1", "anchor", 1, [{"id": "a", "x": None, "y": 1}]), ("f2", "anchor", 2, [{"id": "a", "x": "s", "y": 1.5}])])
    assert found(df) == []


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_unified_tables(spark):
    df = lines(spark, [
        ("f1", "anchor", 1, [{"id": " A ", "tags": ["T", "#u"], "state": "MemoryState.GHOST", "created_at": "17.5", "state_history_json": '[["active", 1738408231.0]]', "replay_count": "3"}]),
        ("f2", "anchor", 2, [{"id": "b", "status": 1, "history": {"active": 1738408231.0, "ghost": 1738408232.5}, "replays": 4}]),
        ("f1", "edge", 1, [{"source": "a", "target": "B", "rel": ["topical", "duplicates"], "strength": "0.5", "coactivations": 2}]),
    ])
    a = {r.id: r for r in D.anchors_table(df).collect()}
    assert a["a"].tags == ["t", "u"] and a["a"].state == "ghost" and a["a"].created_at == 17.5 and a["a"].replay_count == 3
    assert [(x.state, x.at) for x in a["a"].state_history] == [("active", 1738408231.0)]
    assert a["b"].state == "rehearsing" and a["b"].replay_count == 4 and len(a["b"].state_history) == 2
    e = D.edges_table(df).collect()[0]
    assert (e.source, e.target, e.edge_types, e.weight, e.co_activation_count) == ("a", "b", ["topical", "duplicates"], 0.5, 2)


def test_history_notations(spark):
    texts = ['[["active", 1735973509.733], ["ghost", 1735993987.6]]', '[{"state": "active", "ts": 1747192795941}]', "active@1747300358.493;dormant@1747770496.052", "[[", None, ""]
    got = [[(x.state, x.at) for x in r.h] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.history("t").alias("h")).collect()]
    assert got[0] == [("active", 1735973509.733), ("ghost", 1735993987.6)]
    assert got[1] == [("active", 1747192795.941)]
    assert [s for s, _ in got[2]] == ["active", "dormant"]
    assert got[3:] == [[], [], []]


def test_migration_steps(spark):
    df = lines(spark, [("f1", "anchor", 1, [{"id": "a", "x": 1}]), ("f2", "anchor", 2, [{"id": "a", "z": 1}])])
    assert [r.step for r in D.migration_steps(D.changes(df)).collect()] == ["rename x to z"]


def test_routes_follow_chains_of_unknown_names(spark):
    df = lines(spark, [
        ("f1", "edge", 1, [{"source": "a", "target": "b", "edge_type": "causes"}]),
        ("f2", "edge", 2, [{"source": "a", "target": "b", "bond": "causes"}]),
        ("f3", "edge", 3, [{"source": "a", "target": "b", "tie": "causes"}, {}]),
        ("f4", "edge", 4, [{"source": "a", "target": "b", "bond": 7}]),
    ])
    rows = {r.file_name: r for r in D.edges_table(df).filter("source is not null").collect()}
    # two renames in a row lead back to the known name; the same name that comes anew is another field
    assert [rows[f].edge_types for f in ("f1", "f2", "f3", "f4")] == [["causes"], ["causes"], ["causes"], []]
    assert D.edges_table(df).count() == 5
    scratch = Scratch(spark, "t")
    to = {(r.file_name, r.field): r.target for r in D.routes(scratch.keep(D.cells(D.valid_lines(df))), scratch).collect()}
    assert to["f3", "tie"] == "edge_type" and to["f4", "bond"] == "bond"


def test_stored_notations(spark):
    a = spark.createDataFrame([("A", "1", "active@1747300358.4", 0)] * 2 + [(None, None, None, 0)], "id string, state string, state_history_json string, at int")
    got = {r.id: (r.state, len(r.state_history)) for r in D.anchor_states(a).collect()}
    assert got == {"a": ("rehearsing", 1), None: (None, 0)}
    e = spark.createDataFrame([(1, "Caused By"), (1, "Caused By"), (2, None)], "edge_id bigint, edge_type string")
    assert sorted((r.edge_id, r.edge_types) for r in D.edge_relations(e).collect()) == [(1, ["caused_by"]), (2, [])]


def test_unknown_names_are_tied_across_stores_and_unknown_fields_kept(spark):
    # one store renames weight to heft; another has only ever had heft, and a field that no column takes
    one = lines(spark, [("f1", "edge", 1, [{"source": "a", "target": "b", "weight": 0.5}]), ("f2", "edge", 2, [{"source": "a", "target": "b", "heft": 0.5}])])
    other = lines(spark, [("g1", "edge", 1, [{"source": "c", "target": "d", "heft": "0.25", "zeal": [1, 2], "hue": None}])]).replace("s", "t", "store_name")
    rows = {r.file_name: r for r in D.edges_table(one.unionByName(other), None).collect()}
    assert [rows[f].weight for f in ("f1", "f2", "g1")] == [0.5, 0.5, 0.25]
    assert rows["g1"].extras == {"zeal": "[1,2]", "hue": None} and rows["f1"].extras == {}


def test_names_of_alike_values_are_one_column(spark):
    state = lambda n: [{"id": f"a{i}", n: f"MemoryState.{w}"} for i, w in enumerate(("ACTIVE", "GHOST", "DORMANT"))]
    df = lines(spark, [("f1", "anchor", 1, state("state"))]).unionByName(lines(spark, [("g1", "anchor", 1, state("condition"))]).replace("s", "t", "store_name"))
    assert [r.state for r in D.anchors_table(df, None).orderBy("file_name", "id").collect()] == ["active", "ghost", "dormant"] * 2


def test_versions_go_on_while_the_fingerprint_stays(spark):
    df = lines(spark, [(f"f{n}", "anchor", n, [{"id": "a", ("x" if n < 3 else "y"): 1}]) for n in range(5)])
    prints = D.fingerprints(D.cells(D.valid_lines(df))).orderBy("seq").collect()
    assert [r.version for r in prints] == [1, 1, 1, 2, 2] and prints[0].fingerprint == prints[2].fingerprint != prints[3].fingerprint
    assert [(r.from_version, r.to_version, r.change_kind) for r in D.changes(df).collect()] == [(1, 2, "renamed")]


def test_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.anchors_table(none, None).count() == 0 and D.edges_table(none, None).count() == 0
    df = lines(spark, [("f1", "anchor", 1, [{"id": "a", "state": "active", "fields": 1, "cells": [1], "route": None}]), ("f2", "anchor", 2, [{"id": "a", "State": "active", "v": {}, "key": ""}])])
    wide = df.selectExpr("*", "1 as fields", "2 as record", "3 as rid", "4 as old", "5 as version", "6 as renames")
    kinds = sorted((r.change_kind, r.old_name, r.new_name) for r in D.changes(wide).collect())
    assert ("renamed", "state", "State") in kinds and len(kinds) == 6
    rows = {r.file_name: r for r in D.anchors_table(wide, None).collect()}
    assert rows["f2"].state == "active" and rows["f1"].extras == {"fields": "1", "cells": "[1]", "route": None} and rows["f2"].extras == {"v": "{}", "key": ""}


def test_a_field_with_dots_blanks_and_quotes_in_its_name(spark):
    df = lines(spark, [("f1", "anchor", 1, [{"id": "a", "x.y": 1, 'q"r': 2, "": 3, "a b": 4}]), ("f2", "anchor", 2, [{"id": "a", "x.z": 1, "": "3"}])])
    kinds = sorted((r.change_kind, r.old_name, r.new_name) for r in D.changes(df).collect())
    assert kinds == [("removed", "a b", ""), ("removed", 'q"r', ""), ("renamed", "x.y", "x.z"), ("retyped", "", "")]


def test_all_shapes_of_a_name_are_compared(spark):
    """A name whose 300 shapes are among another's 3000: the least 256 of each have few in common."""
    word = lambda n: "shape" + "".join(chr(97 + n // 26**k % 26) for k in range(3))
    df = lines(spark, [
        ("f1", "anchor", 1, [{"id": f"a{n}", "text": word(n)} for n in range(3000)]), ("f2", "anchor", 1, [{"id": f"b{n}", "body": word(10 * n)} for n in range(300)]),
    ]).withColumn("store_name", F.col("file_name"))
    got = {r.file_name: r.n for r in D.anchors_table(df, None).groupBy("file_name").agg(F.count("text").alias("n")).collect()}
    assert got == {"f1": 3000, "f2": 300}
