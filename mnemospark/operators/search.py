"""Keyword search over texts: BM25, rank fusion, key terms."""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark import store
from mnemospark.functions import text as T
from mnemospark.store import Scratch


def query_tokens(query: str) -> Counter:
    """The query's tokens with their counts."""
    return Counter(regex.findall(T.TOKEN, query.lower()))


def bm25(docs: DataFrame, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents (id, text) that hold a query token; repeated query tokens count again.

    Null and empty texts are no documents.  One scan counts the query's tokens in each
    document; only those counts and the corpus totals leave it.
    """
    wanted = query_tokens(query)
    if not wanted:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    toks = docs.filter("text is not null and text <> ''").select("id", T.tokens("text").alias("all"))
    hits = toks.select("id", F.size("all").alias("dl"), F.filter("all", lambda x: x.isin(*wanted)).alias("toks"))
    # texts are read once: the totals are observed on the way, and only rows with a hit are stored
    seen = Observation()
    counted = hits.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).filter(F.size("toks") > 0)
    counts = Scratch(docs.sparkSession, "bm25").keep(counted.select("id", "dl", *[F.size(_occurrences(w)).alias(f"tf{i}") for i, w in enumerate(wanted)]))
    totals = counts.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    n, avgdl = seen.get["n"], max(1.0, seen.get["avgdl"] or 1.0)
    score = F.lit(0.0)
    for i, (w, times) in enumerate(wanted.items()):
        df, tf = totals[f"df{i}"], F.col(f"tf{i}")
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5) + 1.0))
        score = score + times * idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * F.col("dl") / avgdl))
    return counts.select("id", score.alias("score")).filter("score > 0")


def _occurrences(word: str) -> Column:
    return F.filter("toks", lambda x: x == F.lit(word))


def fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(id, score): reciprocal rank fusion of ranked lists (id, rank)."""
    parts = None
    for one in lists:
        p = one.select("id", (1.0 / (k + F.col("rank"))).alias("s"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("id").agg(F.sum("s").alias("score"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best (id, score) with their rank (a top-k report)."""
    top = scored.orderBy(F.desc(F.round("score", 9)), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "id")))


def key_terms(docs: DataFrame, k: int = 8) -> DataFrame:
    """(grp, term, score, rank): the k terms of greatest tf-idf within each group of texts (grp, text)."""
    toks = docs.select("grp", T.tokens("text").alias("toks"))
    sizes = toks.groupBy("grp").agg(F.count("*").alias("n"))
    each = F.transform(F.array_distinct("toks"), lambda t: F.struct(t.alias("term"), F.size(F.filter("toks", lambda x: x == t)).alias("tf")))
    per = toks.select("grp", F.explode(each).alias("e")).select("grp", "e.term", "e.tf")
    counted = per.groupBy("grp", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).join(sizes, "grp")
    score = F.round(F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0), 9)
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("score"), "term"))
    return counted.select("grp", "term", score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)


class PostingIndex:
    """An inverted index on disk: postings by term in buckets, so that a search reads only the buckets of its terms.

    Documents (id string, text) are added in numbered parts; a removed or replaced document
    leaves a tombstone, the part up to which it no longer counts.  The number and mean
    length of documents are kept with every part.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def parts(self) -> list[int]:
        return sorted(int(n.removeprefix("part=")) for n in store.names(self.spark, f"{self.root}/lengths") if n.startswith("part="))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.BUCKETS)).cast("int")

    def _read(self, what: str, schema: str) -> DataFrame:
        numbers = [n for n in store.names(self.spark, f"{self.root}/{what}") if n.startswith("part=")]
        return self.spark.read.schema(schema + ", part int").parquet(f"{self.root}/{what}") if numbers else store.empty(self.spark, schema + ", part int")

    def add(self, docs: DataFrame) -> None:
        """Adds documents, in place of those of the same id."""
        n = (self.parts() or [0])[-1] + 1
        toks = docs.filter("text is not null and text <> ''").select(F.col("id").cast("string").alias("id"), T.tokens("text").alias("toks"))
        toks = Scratch(self.spark, "tokens").keep(toks)
        each = toks.select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        postings = each.withColumn("bucket", self._bucket(F.col("term")))
        self._dead(docs.select(F.col("id").cast("string").alias("id")), n - 1)
        postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/part={n}")
        toks.select("id", F.size("toks").alias("dl")).write.mode("overwrite").parquet(f"{self.root}/lengths/part={n}")

    def _dead(self, ids: DataFrame, upto: int) -> None:
        number = len(store.names(self.spark, f"{self.root}/dead")) + 1
        ids.distinct().withColumn("upto", F.lit(upto)).write.mode("overwrite").parquet(f"{self.root}/dead/part={number}")

    def remove(self, ids: DataFrame) -> None:
        """Removes documents by id."""
        self._dead(ids.select(F.col("id").cast("string").alias("id")), (self.parts() or [0])[-1])

    def clear(self) -> None:
        store.delete(self.spark, self.root)

    def _live(self, rows: DataFrame) -> DataFrame:
        dead = self._read("dead", "id string, upto int").groupBy(F.col("id").alias("_id")).agg(F.max("upto").alias("_upto"))
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("part") <= F.col("_upto")), "left_anti")

    def search(self, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(id, score) of the documents that hold a query token, as ``bm25`` over all texts would score them."""
        wanted = query_tokens(query)
        if not wanted or not self.parts():
            return store.empty(self.spark, "id string, score double")
        totals = self._live(self._read("lengths", "id string, dl int")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        n, avgdl = totals["n"], max(1.0, totals["avgdl"] or 1.0)
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array_distinct(F.array(*[self._bucket(F.lit(w)) for w in wanted])))).collect()]
        postings = self._read("postings", "term string, id string, dl int, tf int, bucket int").filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*wanted))
        hits = Scratch(self.spark, "hits").keep(self._live(postings).select("term", "id", "dl", "tf"))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        times = F.element_at(F.create_map(*[x for w, t in wanted.items() for x in (F.lit(w), F.lit(t))]), F.col("term"))
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        one = times * idf * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / avgdl))
        return hits.join(df, "term").groupBy("id").agg(F.sum(one).alias("score"))


def word_matches(texts: DataFrame, templates: DataFrame, least: float, rows: int = 4_096) -> DataFrame:
    """(anchor, schema, m): the share m of a template's words that a text has, where it is ``least`` or more.

    ``texts`` has anchor and words, ``templates`` schema and words, each word once.  A block
    of ``rows`` texts meets a block of twice as many templates in one task, which counts
    words by the templates that have them; no pair is shuffled.
    """
    import numpy as np
    import pandas as pd

    left, right = max(1, -(-texts.count() // rows)), max(1, -(-templates.count() // (2 * rows)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = texts.filter("size(words) > 0").select("anchor", "words", of("anchor", left).alias("i"), every(right).alias("j"))
    t = templates.filter("size(words) > 0").select("schema", "words", every(left).alias("i"), of("schema", right).alias("j"))

    def match(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        hits, shares, sizes = [], [], np.array([len(x) for x in t.words])
        having: dict[str, list[int]] = {}
        for n, words in enumerate(t.words):
            for w in words:
                having.setdefault(w, []).append(n)
        lists = {w: np.array(x) for w, x in having.items()}
        for words in a.words:
            known = [lists[w] for w in words if w in lists]
            share = np.bincount(np.concatenate(known), minlength=len(t)) / sizes if known else np.zeros(0)
            hit = np.flatnonzero((share >= least) & (share > 0))
            hits.append(hit)
            shares.append(share[hit])
        at = np.repeat(np.arange(len(a)), [len(x) for x in hits])
        found = np.concatenate([np.zeros(0, dtype=np.int64), *hits])
        return pd.DataFrame({"anchor": a.anchor.to_numpy()[at], "schema": t["schema"].to_numpy()[found], "m": np.concatenate([np.zeros(0), *shares])})

    return a.groupBy("i", "j").cogroup(t.groupBy("i", "j")).applyInPandas(match, f"anchor {dict(texts.dtypes)['anchor']}, schema {dict(templates.dtypes)['schema']}, m double")
