"""What callers can plug in: retrievers, encoders, survival curves, feature flags and traces."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mnemospark.operators import search

#: A text column to a vector column: a Catalyst expression, or a pandas UDF around a model of the caller's.
Encoder = Callable[[Column], Column]


@runtime_checkable
class Retriever(Protocol):
    """Ranks memories for a query: (id, score), of any number of rows."""

    name: str

    def retrieve(self, memories: DataFrame, query: str) -> DataFrame: ...


@dataclass(frozen=True)
class KeywordRetriever:
    """BM25 over the texts."""

    name: str = "keywords"

    def retrieve(self, memories: DataFrame, query: str) -> DataFrame:
        return search.bm25(memories.select("id", "text"), query)


@dataclass(frozen=True)
class VectorRetriever:
    """Cosine of the memories' vectors with the query's, by an encoder."""

    encoder: Encoder
    name: str = "vectors"

    def retrieve(self, memories: DataFrame, query: str) -> DataFrame:
        from mnemospark.functions.vectors import cosine

        score = cosine(F.col("embedding"), self.encoder(F.lit(query)))
        return memories.filter("embedding is not null").select("id", F.greatest(F.lit(0.0), score).alias("score"))


def compared(retrievers: list[Retriever], memories: DataFrame, queries: dict[str, list[str]], k: int = 10) -> DataFrame:
    """(retriever, query, hits, recall) of each retriever's k best against the ids each query should find.

    Results are joined with the wanted ids; a query without wanted ids has a recall of 0.
    """
    spark = memories.sparkSession
    wanted = spark.createDataFrame([(q, i) for q, ids in queries.items() for i in ids] or [(None, None)], "query string, id string").filter("id is not null")
    rows = None
    for r in retrievers:
        for q in queries:
            own = search.ranked(r.retrieve(memories, q), k).select(F.lit(r.name).alias("retriever"), F.lit(q).alias("query"), F.col("id").cast("string").alias("id"))
            rows = own if rows is None else rows.unionByName(own)
    hits = rows.join(wanted, ["query", "id"]).groupBy("retriever", "query").agg(F.count("*").alias("hits"))
    sizes = spark.createDataFrame([(r.name, q, len(set(ids))) for r in retrievers for q, ids in queries.items()], "retriever string, query string, n bigint")
    return sizes.join(hits, ["retriever", "query"], "left").select("retriever", "query", F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).otherwise(0.0).alias("recall"))


@dataclass
class Flags:
    """Features that a deployment switches on; unknown names are errors."""

    write_gate: bool = False
    four_layers: bool = False
    personality: bool = True
    ghosts: bool = True
    raw_buffer: bool = True

    def enabled(self, name: str) -> bool:
        if name not in self.__dataclass_fields__:
            raise KeyError(name)
        return getattr(self, name)


@dataclass
class Tracer:
    """Spans with their time, and the rows and sums observed while a table was written, without a job of their own."""

    spans: list[dict] = field(default_factory=list)
    listeners: list[Callable[[dict], None]] = field(default_factory=list)

    def traced(self, name: str, df: DataFrame, write: Callable[[DataFrame], None], **sums: Column) -> dict:
        """Writes ``df`` and records its span; ``sums`` are further aggregates to observe."""
        seen = Observation()
        began = time.time()
        write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in sums.items()]))
        span = {"name": name, "ms": (time.time() - began) * 1000.0, **seen.get}
        self.spans.append(span)
        for listen in self.listeners:
            listen(span)
        return span
