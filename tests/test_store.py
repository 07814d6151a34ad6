"""Intermediate tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from mnemospark import store


def local(path):
    return path.removeprefix("file://")


def test_keep_drop_and_sweep(spark):
    s = store.Scratch(spark, "t")
    one = s.keep(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    two = s.keep(one.filter("id > 2"))
    assert one.count() == 5 and two.count() == 2 and two.columns == ["id", "x"]
    s.drop(one)
    s.drop(None)
    s.drop(spark.range(1))
    assert two.count() == 2 and os.listdir(local(s.root)) == ["2"]
    assert store.sweep(spark) >= 1 and not os.path.exists(local(s.root)) and store.sweep(spark) == 0


def test_an_empty_table_keeps_its_schema(spark):
    df = spark.createDataFrame([], "a int, b array<string>")
    assert store.Scratch(spark, "t").keep(df).dtypes == df.dtypes


def test_the_named_folder_is_used(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
