"""Whole runs: recall over several paths, consolidation, and the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay, links
from mnemospark.operators import graph, search
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.texts import QUERY
from mnemospark.sources import memory, snapshots
from mnemospark.sources.memory import AS_OF
from mnemospark.store import Scratch, shared_dir

CATALOGUE = Catalogue()
query = CATALOGUE.query

_PLANE = f"(0.6 * exp(-{S.hours('last_at')} / 168.0) + 0.4 * {S.RETENTION}) * CASE {S.THERMAL} WHEN 'hot' THEN 1.0 WHEN 'warm' THEN 0.6 ELSE 0.0 END"


def plane_score() -> Column:
    """Position in the plane of recency and retention, weighted by the thermal level."""
    return (0.6 * F.exp(-decay.hours("last_at", AS_OF) / 168.0) + 0.4 * decay.retention(AS_OF)) * decay.lookup(decay.PRIORITY, decay.thermal())


@query(S.over(S.MEM, then=f"SELECT id, round(s, 6) AS score FROM (SELECT id, {_PLANE} AS s FROM mem WHERE state <> 'ghost') ORDER BY round(s, 9) DESC, id LIMIT 50"))
def plane_2d_top50(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty memories furthest up in the plane of recency and retention (a top-k report)."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", plane_score().alias("score"))
    return search.ranked(a, 50).select("id", r6("score", "score"))


def recall(anchors: DataFrame, both: DataFrame, text: str, k: int = 24) -> DataFrame:
    """(id, path, score, rank): the memories that several paths recall for a query text.

    Paths in the order of their rank: keywords, the plane of recency and retention,
    and activation that spreads from the five best keyword hits.  A memory counts
    once, and so does a text, with its first path; agreement of spreading with another
    path adds 0.05.  Keyword matches come first, then the score decides.
    """
    live = anchors.filter(decay.is_retrievable())
    hits = Scratch(anchors.sparkSession, "recall").keep(search.bm25(live.select("id", "text"), text))
    best = search.ranked(hits.select("id", (1.0 - F.exp(-F.col("score") / 1.5)).alias("score")), k)
    plane = search.ranked(live.select("id", plane_score().alias("score")), k)
    seeds = search.ranked(hits, 5).select(F.col("id").alias("node"))
    spread = graph.spread(both, seeds, steps=2).select(F.col("node").alias("id"), "activation").join(live.select("id"), "id", "left_semi")
    paths = (
        best.select("id", F.lit("keywords").alias("path"), F.lit(1).alias("prio"), "score")
        .unionByName(plane.select("id", F.lit("plane").alias("path"), F.lit(2).alias("prio"), "score"))
        .unionByName(search.ranked(spread.select("id", (0.6 * F.least(F.lit(1.0), "activation")).alias("score")), k).select("id", F.lit("spreading").alias("path"), F.lit(3).alias("prio"), "score"))
    )
    per_id = W.partitionBy("id")
    agreed = F.when((F.max("prio").over(per_id) == 3) & (F.min("prio").over(per_id) < 3), 0.05).otherwise(0.0)
    one = paths.withColumn("bonus", agreed).withColumn("rn", F.row_number().over(per_id.orderBy("prio"))).filter("rn = 1")
    texts = one.join(live.select("id", F.lower(F.trim("text")).alias("t")), "id")
    # blank texts are no repeats of each other
    by_text = W.partitionBy(F.when(F.col("t") != "", F.col("t")).otherwise(F.col("id"))).orderBy("prio", "id")
    rows = texts.withColumn("rn", F.row_number().over(by_text)).filter("rn = 1").select("id", "path", "prio", (F.col("score") + F.col("bonus")).alias("score"))
    order = [F.when(F.col("prio") == 1, 0).otherwise(1), F.desc(F.round("score", 9)), F.col("id")]
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("id", "path", "score", "rank")


@query()
def recall_multi_path(spark: SparkSession, folder: str) -> DataFrame:
    """What several paths together recall for a query (a top-k report)."""
    scratch = Scratch(spark, "recall")
    both = scratch.keep(memory.both_ways(memory.pairs(memory.edges(spark, folder))))
    return recall(scratch.keep(memory.anchors(spark, folder)), both, QUERY).select("id", "path", r6("score", "score"), "rank")


def consolidate(anchors: DataFrame, pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[str, int]]]:
    """One cycle of consolidation: (anchors, pairs, ghosts, report).

    Edges fade, learn and are scaled; expired and unused ones go; anchors are
    consolidated; those of too low a retention leave a ghost.  The input state decides
    every step, so the order of rows does not matter.  Each phase is written.
    """
    report = [("anchors_before", anchors.count()), ("edges_before", pairs.count())]
    live = pairs.filter(~links.is_expired(AS_OF)).withColumn("weight", links.faded_weight(AS_OF)).filter(F.col("weight") > links.LEAST_WEIGHT)
    live = scratch.keep(live.withColumn("weight", links.hebbian_weight(AS_OF)).filter("not (weight < 0.05 and co_count = 0)"))
    mean = live.agg(F.avg("weight")).first()[0] or 0.0
    scale = 0.5 + 0.5 * 0.3 / mean if mean > 0.3 else 1.0
    live = live.withColumn("weight", F.col("weight") * scale)
    dep = F.greatest(F.lit(0.05), F.exp(-F.col("replay_count") / 20.0))
    settled = anchors.withColumns({
        "hippocampal_dependency": dep, "recency": decay.decayed_recency(AS_OF), "stability": F.greatest(F.col("stability"), F.least(F.lit(1.0), 1.0 - dep * 0.9)),
        "emotional_valence": F.when(F.col("stability") > 0.5, F.col("emotional_valence") * 0.75).otherwise(F.col("emotional_valence")),
    })
    scored = scratch.keep(settled.withColumn("retention", decay.retention(AS_OF)))
    gone = scored.filter((F.col("retention") < 0.15) & decay.is_retrievable())
    ghosts = scratch.keep(gone.select("id", "tags", F.lit(AS_OF).alias("pruned_at"), F.lit(0).alias("revival_count"), "importance"))
    kept = scored.join(ghosts.select("id"), "id", "left_anti")
    ids = kept.select("id")
    left = live.join(ids.toDF("lo"), "lo", "left_semi").join(ids.toDF("hi"), "hi", "left_semi")
    kept, left = scratch.keep(kept), scratch.keep(left)
    report += [("anchors_after", kept.count()), ("edges_after", left.count()), ("ghosts", ghosts.count())]
    return kept, left, ghosts, report


@query()
def sleep_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many anchors and edges one cycle of consolidation leaves."""
    scratch = Scratch(spark, "sleep")
    *_, report = consolidate(scratch.keep(memory.anchors(spark, folder)), scratch.keep(memory.pairs(memory.edges(spark, folder))), scratch)
    return spark.createDataFrame(report, "measure string, n bigint")


@query(S.over(S.MEM, then="SELECT id, state, round(importance, 6) AS importance FROM mem WHERE state <> 'ghost' AND id NOT LIKE '0%' UNION ALL SELECT id, 'dormant', round(importance, 6) AS importance FROM mem WHERE state <> 'ghost' AND id LIKE '0%'"))
def snapshot_and_replay(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot, a log of changes replayed on it, and the table as it is then."""
    root = f"{shared_dir(spark)}/snapshots-{Scratch(spark, 's').root.rsplit('-', 1)[-1]}"
    store = snapshots.SnapshotStore(spark, root)
    a = memory.anchors(spark, folder).select("id", "state", "importance")
    v = store.save({"anchors": a})
    base = store.load("anchors", v)
    ops = F.when(F.col("state") == "ghost", F.lit("remove")).when(F.col("id").startswith("0"), F.lit("put"))
    changed = base.withColumn("op", ops).filter("op is not null")
    row = F.struct("id", F.lit("dormant").alias("state"), "importance").alias("row")
    log = changed.select(F.lit(2).alias("seq"), F.lit(2.0).alias("at"), "op", "id", row)
    stale = changed.select(F.lit(1).alias("seq"), F.lit(1.5).alias("at"), F.lit("remove").alias("op"), "id", row)
    return snapshots.replayed(base, log.unionByName(stale), "id", 1.0).select("id", "state", r6("importance", "importance"))


@query(S.over(S.MEM, S.GHOSTS, then="SELECT (SELECT count(*) FROM gone WHERE id IN (SELECT id FROM mem)) AS revived, (SELECT count(*) FROM gone WHERE id NOT IN (SELECT id FROM mem)) AS traces, (SELECT count(*) FROM mem WHERE state = 'ghost') AS ghost_state"))
def ghost_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Ghosts that are anchors again, traces without an anchor, and anchors in the ghost state."""
    a, g = memory.anchors(spark, folder).select("id", "state"), memory.ghosts(spark, folder).select("id")
    both = a.withColumn("a", F.lit(1)).join(g.withColumn("g", F.lit(1)), "id", "full")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("g").isNotNull()).alias("revived"), F.count_if(F.col("a").isNull()).alias("traces"), F.count_if(F.col("state") == "ghost").alias("ghost_state"))


