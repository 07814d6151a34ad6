"""Queries on anchors and edges at a point in time: scores, lifecycle, thermal levels and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay, links
from mnemospark.operators import ordered
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query(S.over(S.MEM, then=f"""SELECT id, round({S.STRENGTH}, 6) AS strength, round({S.EBBINGHAUS}, 6) AS ebbinghaus,
    round(pow(1.0 + {S.hours('last_at')} / (50.0 * (0.2 + {S.STRENGTH} * 1.8)), -0.5), 6) AS power_law,
    round(exp(-(0.05 / 24.0 * (1.0 - {S.STRENGTH} * 0.8)) * {S.hours('last_at')}), 6) AS exponential,
    round((1.0 + {S.STRENGTH} * 335.0) * ln(2), 6) AS half_life FROM mem"""))
def survival_curves(spark: SparkSession, folder: str) -> DataFrame:
    """The remaining share of every anchor by each survival curve."""
    h, s = decay.hours("last_at", AS_OF), decay.strength()
    return memory.anchors(spark, folder).select("id", r6(s, "strength"), *[r6(f(h, s), n) for n, f in decay.CURVES.items()], r6(decay.half_life("ebbinghaus", s), "half_life"))


@query(S.over(S.MEM, then=f"""SELECT id, round({S.RELEVANCE}, 6) AS relevance, round({S.IMPORTANCE}, 6) AS importance_score, round({S.DECAY}, 6) AS decay_factor,
    round({S.RETENTION}, 6) AS retention, round({S.clip(f"confidence * 0.33 * exp(-{S.hours('created_at')} / 168.0)", 0.01, 1.0)}, 6) AS confidence_score FROM mem"""))
def retention_score(spark: SparkSession, folder: str) -> DataFrame:
    """Retention of every anchor with its parts."""
    return memory.anchors(spark, folder).select(
        "id", r6(decay.relevance(), "relevance"), r6(decay.importance_score(), "importance_score"), r6(decay.decay_factor(AS_OF), "decay_factor"),
        r6(decay.retention(AS_OF), "retention"), r6(decay.confidence_score(AS_OF), "confidence_score"),
    )


_DENSITY_TAGS = "['" + "','".join(decay.ABSTRACT_TAGS) + "']"


@query(S.over(S.MEM, then=f"""SELECT id, round({S.clip(f'''CASE WHEN len(list_intersect(tags, {_DENSITY_TAGS})) > 0
      THEN greatest(CASE WHEN schema_ref IS NOT NULL THEN greatest((1.0 - hippocampal_dependency) * 0.6 + stability * 0.4, 0.7) ELSE (1.0 - hippocampal_dependency) * 0.6 + stability * 0.4 END, 0.5 + 0.1 * len(list_intersect(tags, {_DENSITY_TAGS})))
      WHEN schema_ref IS NOT NULL THEN greatest((1.0 - hippocampal_dependency) * 0.6 + stability * 0.4, 0.7) ELSE (1.0 - hippocampal_dependency) * 0.6 + stability * 0.4 END''', 0.0, 1.0)}, 6) AS density,
    round({S.clip(f"{S.RETENTION} * exp(-{S.hours('last_at')} / 168.0) * (1.0 + least(0.2, frequency * 0.2)) * (1.0 + abs(emotional_valence) * 0.15) * CASE {S.THERMAL} WHEN 'hot' THEN 1.0 WHEN 'warm' THEN 0.6 ELSE 0.0 END", 0.0, 1.0)}, 6) AS potential FROM mem"""))
def density_and_potential(spark: SparkSession, folder: str) -> DataFrame:
    """Semantic density and activation potential of every anchor."""
    return memory.anchors(spark, folder).select("id", r6(decay.semantic_density(), "density"), r6(decay.activation_potential(AS_OF), "potential"))


@query(S.over(S.MEM, then=f"""SELECT {S.THERMAL} AS thermal, CASE {S.THERMAL} WHEN 'hot' THEN 'memory' WHEN 'warm' THEN 'disk' ELSE 'audit' END AS tier,
    count(*) AS n, round(avg({S.RETENTION}), 6) AS mean_retention, round(avg(CASE {S.THERMAL} WHEN 'hot' THEN 0.0 WHEN 'warm' THEN 0.3 ELSE 1.0 END), 6) AS mean_cost FROM mem GROUP BY 1, 2"""))
def thermal_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors, mean retention and retrieval cost of each thermal level."""
    a = memory.anchors(spark, folder).withColumn("thermal", decay.thermal())
    return a.groupBy("thermal", decay.lookup(decay.TIER, F.col("thermal")).alias("tier")).agg(
        F.count("*").alias("n"), r6(F.avg(decay.retention(AS_OF)), "mean_retention"), r6(F.avg(decay.lookup(decay.COST, F.col("thermal"))), "mean_cost")
    )


@query(S.over(S.MEM, then=f"""SELECT id, CASE WHEN state IN ('active', 'rehearsing', 'reactivated') AND {S.hours('last_at')} < 24 THEN 'hot' WHEN {S.RETENTION} > 0.4 OR frequency > 0.1 THEN 'hot'
    WHEN {S.RETENTION} > 0.15 THEN 'warm' WHEN {S.RETENTION} > 0.06 THEN 'cold' WHEN {S.RETENTION} > 0.01 THEN 'frozen' ELSE 'dead' END AS level,
    state IN ('active', 'rehearsing', 'reactivated') AS plastic, hippocampal_dependency < 0.3 AS cortical, stability < 0.4 AS labile, {S.hours('last_at')} > 168 AS stale FROM mem"""))
def anchor_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Thermal level by retention, and whether each anchor is plastic, cortical, labile and stale."""
    return memory.anchors(spark, folder).select(
        "id", decay.thermal_from_retention(decay.retention(AS_OF), AS_OF).alias("level"), F.col("state").isin("active", "rehearsing", "reactivated").alias("plastic"),
        (F.col("hippocampal_dependency") < 0.3).alias("cortical"), (F.col("stability") < 0.4).alias("labile"), (decay.hours("last_at", AS_OF) > 168).alias("stale"),
    )


_T = " ".join(f"WHEN state = '{s}' AND event = '{e}' THEN '{t}'" for (s, e), t in decay.TRANSITIONS.items())


@query(S.over(S.MEM, then=f"""SELECT state, event, CASE {_T} ELSE state END AS next_state, count(*) AS n FROM mem
    CROSS JOIN (VALUES ('replay'), ('consolidate'), ('prune'), ('retrieve'), ('stabilize'), ('revive')) e(event) GROUP BY 1, 2, 3"""))
def state_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Where each lifecycle event would take the anchors of each state."""
    events = F.explode(F.array(*[F.lit(e) for e in ("replay", "consolidate", "prune", "retrieve", "stabilize", "revive")])).alias("event")
    counts = memory.anchors(spark, folder).groupBy("state").agg(F.count("*").alias("n"))
    return counts.select("state", events, "n").select("state", "event", decay.transition(F.col("state"), F.col("event")).alias("next_state"), "n")


@query(S.over(S.MEM, then=f"""SELECT id, round(greatest(0.01, recency * CASE state WHEN 'ghost' THEN {S.EBBINGHAUS} * 0.3 WHEN 'dormant' THEN {S.EBBINGHAUS} + (1.0 - {S.EBBINGHAUS}) * 0.3
    WHEN 'reactivated' THEN {S.EBBINGHAUS} + (1.0 - {S.EBBINGHAUS}) * 0.15 ELSE {S.EBBINGHAUS} END), 6) AS recency FROM mem"""))
def decayed_recency(spark: SparkSession, folder: str) -> DataFrame:
    """Recency of every anchor after its idle time."""
    return memory.anchors(spark, folder).select("id", r6(decay.decayed_recency(AS_OF), "recency"))


@query(S.over(S.MEM, then=f"""SELECT id, round(score, 6) AS score, CASE WHEN rk <= 7 THEN 'core' WHEN rk <= 27 THEN 'active' ELSE 'background' END AS tier FROM (
    SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rk FROM (SELECT id, round({S.RETENTION} * 0.35 + greatest(0.0, 1.0 - {S.hours('last_at')} / 720.0) * 0.25
      + success_feedback * 0.15 + abs(emotional_valence) * 0.10 + frequency * 0.10 + stability * 0.05, 9) AS score FROM mem WHERE state <> 'ghost')) WHERE rk <= 27"""))
def temporal_slice(spark: SparkSession, folder: str) -> DataFrame:
    """The active surface: the 7 core and 20 active memories (a top-k report)."""
    score = (
        decay.retention(AS_OF) * 0.35 + F.greatest(F.lit(0.0), 1.0 - decay.hours("last_at", AS_OF) / 720.0) * 0.25 + F.col("success_feedback") * 0.15
        + F.abs("emotional_valence") * 0.10 + F.col("frequency") * 0.10 + F.col("stability") * 0.05
    )
    top = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(27)
    rk = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # over the 27 rows that are left
    return top.select("id", r6(F.col("score"), "score"), F.when(rk <= 7, "core").otherwise("active").alias("tier"))


def _evict(order: str) -> str:
    return S.over(S.MEM, then=f"SELECT id, round(v, 6) AS v FROM (SELECT id, {order} AS v FROM mem WHERE created_at < {S.AS_OF} - 5) ORDER BY round(v, 9), id LIMIT 100")


def _evicted(spark: SparkSession, folder: str, by) -> DataFrame:
    a = memory.anchors(spark, folder).filter(F.col("created_at") < AS_OF - 5).select("id", by.alias("v"))
    return a.orderBy(F.round("v", 9), "id").limit(100).select("id", r6(F.col("v"), "v"))


@query(_evict(S.RETENTION))
def evict_lowest_retention(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 anchors to evict first by retention (a top-k report)."""
    return _evicted(spark, folder, decay.retention(AS_OF))


@query(_evict("last_at"))
def evict_lru(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 anchors to evict first by last activation."""
    return _evicted(spark, folder, F.col("last_at"))


@query(_evict("created_at"))
def evict_fifo(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 anchors to evict first by creation."""
    return _evicted(spark, folder, F.col("created_at"))


@query(S.over(S.MEM, then=f"SELECT id FROM mem WHERE {S.RETENTION} < 0.15 AND state <> 'ghost'"))
def prune_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors whose retention is too low to keep."""
    return memory.anchors(spark, folder).filter((decay.retention(AS_OF) < 0.15) & decay.is_retrievable()).select("id")


@query(S.over(S.MEM, then=f"""SELECT count(*) AS anchors, round(avg({S.RETENTION}), 6) AS mean_retention, round(avg(hippocampal_dependency), 6) AS mean_dependency,
    round(sum(stability * {S.RETENTION}) / sum({S.RETENTION}), 6) AS weighted_stability, count(*) FILTER ({S.hours('created_at')} < 720) AS recent, sum(replay_count)::BIGINT AS replays FROM mem"""))
def memory_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and means over all anchors."""
    r = decay.retention(AS_OF)
    return memory.anchors(spark, folder).agg(
        F.count("*").alias("anchors"), r6(F.avg(r), "mean_retention"), r6(F.avg("hippocampal_dependency"), "mean_dependency"),
        r6(F.sum(F.col("stability") * r) / F.sum(r), "weighted_stability"), F.count_if(decay.hours("created_at", AS_OF) < 720).alias("recent"), F.sum("replay_count").alias("replays"),
    )


@query(S.over(S.MEM, then="""SELECT id, round(greatest(0.05, exp(-replay_count / 20.0)), 6) AS dependency, round(least(1.0, 1.0 - 0.9 * greatest(0.05, exp(-replay_count / 20.0))), 6) AS stability,
    round(CASE WHEN stability > 0.5 THEN emotional_valence * 0.75 ELSE emotional_valence END, 6) AS valence FROM mem"""))
def systems_consolidation(spark: SparkSession, folder: str) -> DataFrame:
    """Dependency and stability after consolidation, and the emotion that stable memories lose."""
    dep = F.greatest(F.lit(0.05), F.exp(-F.col("replay_count") / 20.0))
    valence = F.when(F.col("stability") > 0.5, F.col("emotional_valence") * 0.75).otherwise(F.col("emotional_valence"))
    return memory.anchors(spark, folder).select("id", r6(dep, "dependency"), r6(F.least(F.lit(1.0), 1.0 - dep * 0.9), "stability"), r6(valence, "valence"))


_RATE = "0.01 * (1.0 - 0.5 * success_feedback) * (1.0 - 0.2 * confidence) * (1.0 - least(0.3, 0.3 * replay_count)) * (1.0 - 0.4 * stability)"


@query(S.over(S.MEM, then=f"SELECT id, round({S.clip(_RATE, 0.001, 0.5)}, 6) AS rate FROM mem"))
def reinforcement_decay(spark: SparkSession, folder: str) -> DataFrame:
    """Decay rates that success, confidence, replay and stability slow down."""
    c = F.col
    rate = 0.01 * (1.0 - 0.5 * c("success_feedback")) * (1.0 - 0.2 * c("confidence")) * (1.0 - F.least(F.lit(0.3), 0.3 * c("replay_count"))) * (1.0 - 0.4 * c("stability"))
    return memory.anchors(spark, folder).select("id", r6(decay.clip(rate, 0.001, 0.5), "rate"))


@query(S.over(S.MEM, S.LINKS, S.PAIRS, S.BOTH, """deg AS (SELECT node, count(*) AS n FROM both_ways GROUP BY 1)""", f"""pr AS (SELECT id, round(abs(emotional_valence) * 0.25 + surprise * 0.25 + frequency * 0.20
    + least(1.0, coalesce(n, 0) / greatest(1, (SELECT count(*) FROM mem))::DOUBLE) * 0.15 + abs(1.0 - stability) * 0.15, 9) AS p FROM mem LEFT JOIN deg ON node = id WHERE {S.hours('last_at')} < 720)""",
    then="SELECT id, round(p, 6) AS priority, row_number() OVER (ORDER BY p DESC, id) AS rk FROM pr QUALIFY rk <= (SELECT greatest(1, count(*) // 2) FROM pr)"))
def replay_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The half of the recent memories that are replayed for certain, by priority."""
    a = memory.anchors(spark, folder)
    total = a.count()
    deg = memory.both_ways(memory.pairs(memory.edges(spark, folder))).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"))
    c = F.col
    p = F.abs("emotional_valence") * 0.25 + c("surprise") * 0.25 + c("frequency") * 0.20 + F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / float(max(1, total))) * 0.15 + F.abs(1.0 - c("stability")) * 0.15
    recent = a.filter(decay.hours("last_at", AS_OF) < 720).join(deg, "id", "left").select("id", F.round(p, 9).alias("p"))
    scratch = Scratch(spark, "replay")
    placed = scratch.keep(ordered.with_position(recent, [], [F.desc("p"), c("id")], scratch, "rk"))
    return placed.filter(c("rk") <= max(1, placed.count() // 2)).select("id", r6(c("p"), "priority"), "rk")


# ---------------------------------------------------------------- edges


@query(S.over(S.LINKS, then=f"""SELECT edge_id, edge_type, round(weight * {S.case('edge_type', links.TRAVERSAL, 1.0)}, 6) AS traversal, round(CASE WHEN created_at + CASE WHEN edge_type IN {links.STRONG} THEN 7776000.0 ELSE 1209600.0 END < {S.AS_OF} THEN 0.0
    ELSE {S.clip(f"CASE WHEN edge_type IN ('superseded_by', 'invalidated_by', 'contradicts') THEN 0.4 ELSE 1.0 END * (weight + 0.1 + 0.1 * exp(-{S.hours('last_at')} / 168.0) + 0.15 * least(1.0, co_count * 0.2) + CASE WHEN edge_type IN ('before', 'after', 'during') THEN 0.05 ELSE 0.0 END)", 0.0, 1.5)} END, 6) AS score FROM links"""))
def edge_retrieval_score(spark: SparkSession, folder: str) -> DataFrame:
    """Traversal weight and retrieval score of every edge."""
    return memory.edges(spark, folder).select("edge_id", "edge_type", r6(links.traversal_weight(), "traversal"), r6(links.retrieval_score(AS_OF), "score"))


_GATE = f"""CASE WHEN edge_type IN {links.STRONG} THEN least(1.0, d * 1.1) WHEN edge_type NOT IN {links.EXPLICABLE} THEN greatest(0.05, d * 0.5) ELSE d END"""


@query(S.over(S.MEM, S.LINKS, f"""g AS (SELECT *, {_GATE} AS gated FROM (SELECT *, CASE WHEN edge_type NOT IN {links.EXPLICABLE} OR edge_type IN {links.LEGACY} THEN greatest(0.02, weight * 0.3) ELSE weight END AS d FROM links
    WHERE src IN (SELECT id FROM mem) AND dst IN (SELECT id FROM mem)))""", then="""SELECT lo, hi, arg_min(edge_type, (created_at, edge_id)) AS edge_type, round(least(1.0, arg_min(gated, (created_at, edge_id)) + 0.05 * (count(*) - 1)), 6) AS weight,
    count(*) AS n FROM g GROUP BY lo, hi"""))
def edges_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Edges admitted between known anchors: the first of a pair by its gated weight, later ones strengthen it."""
    ids = memory.anchors(spark, folder).select("id")
    known = memory.edges(spark, folder).join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    first = F.min_by(F.struct("edge_type", links.gated_weight().alias("w")), F.struct("created_at", "edge_id"))
    return known.groupBy("lo", "hi").agg(first.alias("f"), F.count("*").alias("n")).select("lo", "hi", "f.edge_type", r6(F.least(F.lit(1.0), F.col("f.w") + 0.05 * (F.col("n") - 1)), "weight"), "n")


@query(S.over(S.LINKS, S.PAIRS, S.BOTH, f"""s AS (SELECT node, other, round({S.case('edge_type', {k: float(v) for k, v in links.PRIORITY.items()}, 2.0)} / 10.0 * 0.4 + weight * 0.3 + exp(-{S.hours('last_at')} / 720.0) * 0.15 + least(1.0, co_count / 10.0) * 0.15, 9) AS score FROM both_ways)""",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS r FROM s)", then="""SELECT least(node, other) AS lo, greatest(node, other) AS hi, round(min(score), 6) AS score FROM rk GROUP BY 1, 2 HAVING max(r) <= 32"""))
def edge_budget_top32(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that are among the 32 best of both their ends."""
    both = memory.both_ways(memory.pairs(memory.edges(spark, folder))).select("node", "other", F.round(links.keep_score(AS_OF), 9).alias("score"))
    r = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "other"))
    # only kept sides are passed on: an edge is kept if both sides are
    kept = both.withColumn("r", r).filter("r <= 32").groupBy(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi")).agg(F.count("*").alias("sides"), F.min("score").alias("score"))
    return kept.filter("sides = 2").select("lo", "hi", r6(F.col("score"), "score"))


@query(S.over(S.LINKS, then=f"""SELECT edge_id, round(w, 6) AS weight, w > 0.02 AS viable FROM (SELECT edge_id, greatest(0.02, weight * exp(-({S.case('edge_type', links.FADE, 0.005)}) * {S.hours('last_at')})) AS w FROM links)"""))
def edge_decay(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge's weight after its idle time, and whether it is worth keeping."""
    e = memory.edges(spark, folder).select("edge_id", links.faded_weight(AS_OF).alias("w"))
    return e.select("edge_id", r6(F.col("w"), "weight"), (F.col("w") > 0.02).alias("viable"))


@query(S.over(S.LINKS, then=f"SELECT edge_type, count(*) AS n, count(*) FILTER (created_at + CASE WHEN edge_type IN {links.STRONG} THEN 7776000.0 ELSE 1209600.0 END < {S.AS_OF}) AS expired FROM links GROUP BY 1"))
def expired_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of each type and how many are past their validity."""
    return memory.edges(spark, folder).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(links.is_expired(AS_OF)).alias("expired"))


@query(S.over(S.LINKS, S.PAIRS, then=f"""SELECT lo, hi, round(CASE WHEN co_count > 0 AND {S.hours('last_at')} < 24 THEN least(1.0, weight + 0.03) ELSE greatest(0.0, weight - least(0.1, ln(1.0 + {S.hours('last_at')} / 24.0) * 0.02)) END, 6) AS weight FROM pairs"""))
def hebbian_update(spark: SparkSession, folder: str) -> DataFrame:
    """Weights after the Hebbian step."""
    return memory.pairs(memory.edges(spark, folder)).select("lo", "hi", r6(links.hebbian_weight(AS_OF), "weight"))


@query(S.over(S.LINKS, S.PAIRS, then="""SELECT lo, hi, round(weight * CASE WHEN m > 0.3 THEN 0.5 + 0.5 * 0.3 / m ELSE 1.0 END, 6) AS weight FROM pairs CROSS JOIN (SELECT avg(weight) AS m FROM pairs)"""))
def homeostasis_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Weights scaled halfway towards a mean of 0.3 when the mean is above."""
    p = memory.pairs(memory.edges(spark, folder))
    m = p.agg(F.avg("weight")).first()[0] or 0.0
    return p.select("lo", "hi", r6(F.col("weight") * (0.5 + 0.5 * 0.3 / m if m > 0.3 else 1.0), "weight"))


@query(S.over(S.LINKS, S.PAIRS, then="""SELECT lo, hi, round(least(1.0, weight + least(0.15, 0.02 * co_count)), 6) AS weight FROM pairs WHERE NOT (weight < 0.05 AND co_count = 0)"""))
def rewire_strengthen(spark: SparkSession, folder: str) -> DataFrame:
    """Edges after rewiring: unused weak ones dropped, used ones strengthened."""
    p = memory.pairs(memory.edges(spark, folder)).filter("not (weight < 0.05 and co_count = 0)")
    return p.select("lo", "hi", r6(F.least(F.lit(1.0), F.col("weight") + F.least(F.lit(0.15), 0.02 * F.col("co_count"))), "weight"))


@query(S.over(S.GHOSTS, then=f"""SELECT id, round(p, 6) AS probability, round(p * (0.5 + importance * 0.5), 6) AS intensity, p < 0.01 OR (h / 24.0 > 90 AND revival_count = 0) AS purge FROM (
    SELECT *, least(1.0, 0.3 + 0.2 * revival_count) * exp(-h / (0.2 + importance * 336.0 * 0.15)) AS p FROM (SELECT *, {S.hours('pruned_at')} AS h FROM gone))"""))
def ghost_intensity(spark: SparkSession, folder: str) -> DataFrame:
    """Reactivation probability and intensity of every ghost, and whether it is to be purged."""
    h = decay.hours("pruned_at", AS_OF)
    p = F.least(F.lit(1.0), 0.3 + 0.2 * F.col("revival_count")) * decay.ebbinghaus_ghost(h, F.col("importance"))
    g = memory.ghosts(spark, folder).select("*", h.alias("h"), p.alias("p"))
    return g.select("id", r6(F.col("p"), "probability"), r6(F.col("p") * (0.5 + F.col("importance") * 0.5), "intensity"), ((F.col("p") < 0.01) | ((F.col("h") / 24.0 > 90) & (F.col("revival_count") == 0))).alias("purge"))


@query(S.over(S.MEM, S.LINKS, S.PAIRS, S.BOTH, f"""c AS (SELECT node, count(*) AS n FROM both_ways WHERE edge_type IN ('contradicts', 'conflicts_with', 'invalidated_by') GROUP BY 1)""",
    then=f"""SELECT id, round({S.RETENTION} - 0.2 * coalesce(n, 0), 6) AS score, coalesce(n, 0) AS contradictions FROM mem LEFT JOIN c ON node = id WHERE state <> 'ghost' AND {S.RETENTION} - 0.2 * coalesce(n, 0) < 0.15"""))
def prune_to_ghost(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors to prune: retention less a penalty for contradictions is too low."""
    both = memory.both_ways(memory.pairs(memory.edges(spark, folder)))
    n = both.filter(F.col("edge_type").isin("contradicts", "conflicts_with", "invalidated_by")).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"))
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("contradictions"), decay.retention(AS_OF).alias("r"))
    return a.select("id", r6(F.col("r") - 0.2 * F.col("contradictions"), "score"), "contradictions").filter(F.col("r") - 0.2 * F.col("contradictions") < 0.15)
