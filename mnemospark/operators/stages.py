"""A list of stages whose results are stored, so that a stopped run goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark import store


class Stages:
    """Named stages in order under one folder; a stage that was stored is read, not run again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.stages: list[tuple[str, Callable[[], DataFrame]]] = []

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        self.stages.append((name, make))

    def run(self, most: int | None = None) -> dict[str, DataFrame]:
        """The results of all stages, or of those stored and up to ``most`` further ones."""
        out, made = {}, 0
        for name, make in self.stages:
            path = f"{self.root}/{name}"
            if "_SUCCESS" not in store.names(self.spark, path):
                if most is not None and made >= most:
                    break
                make().write.mode("overwrite").parquet(path)
                made += 1
            out[name] = self.spark.read.parquet(path)
        return out
