"""Notations of lists, ids, types and states."""

from __future__ import annotations

import pytest

from mnemospark.functions import notation as N


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build("v").alias("o")).first()[0]


@pytest.mark.parametrize(
    ("value", "tags"),
    [
        ('["B", " a ", "#c", "b"]', ["a", "b", "c"]), ("['x', 'y z']", ["x", "y z"]), ("p, Q,,#r", ["p", "q", "r"]),
        ('[{"tag": "k", "w": 0.5}, {"tag": "A"}]', ["a", "k"]), ('["\\u7f13\\u5b58"]', ["缓存"]), ("solo", ["solo"]),
        (None, []), ("", []), (" ", []), ("null", []), ("[]", []), ('["a", null, ""]', ["a"]), ('["cut', []),
    ],
)
def test_tags(spark, value, tags):
    assert one(spark, value, N.tags) == tags


@pytest.mark.parametrize(
    ("value", "ids"),
    [('["A ", "b"]', ["a", "b"]), ('{"ids": ["x", "X"], "n": 2}', ["x"]), ('[{"id": "q\\n", "score": 1}]', ["q"]), ("m,n", ["m", "n"]), (None, []), ("null", [])],
)
def test_ids(spark, value, ids):
    assert one(spark, value, N.ids) == ids


@pytest.mark.parametrize(
    ("value", "types"),
    [
        ("Same Project", ["same_project"]), ("EdgeType.DUPLICATES", ["duplicates"]), ('["topical", "duplicates"]', ["topical", "duplicates"]),
        ('{"relation": "not-duplicates", "since": 3}', ["not_duplicates"]), (" x ", ["x"]), (None, []), ("", []), ('["", "a"]', ["a"]),
    ],
)
def test_edge_types(spark, value, types):
    assert one(spark, value, N.edge_types) == types


@pytest.mark.parametrize(
    ("value", "state"),
    [("Active ", "active"), ("MemoryState.GHOST", "ghost"), ('{"name": "dormant", "v": 3}', "dormant"), ("2", "consolidating"), ('["active"]', "active"), ("9", None), ("odd", None), (None, None), ("", None)],
)
def test_state(spark, value, state):
    assert one(spark, value, N.state) == state


def test_key(spark):
    assert one(spark, "\tAb \n", N.key) == "ab"
    assert one(spark, "  ", N.key) is None
