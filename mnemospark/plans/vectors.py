"""Queries on vectors: ranking, neighbours, merging, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import vectors as V
from mnemospark.operators import graph, ordered, similarity
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: The vectors carry no state of their own; it is derived from their number.
_STATE = {
    "importance": "((vec_id * 37) % 100) / 100.0", "frequency": "((vec_id * 17) % 50) / 100.0", "recency": "((vec_id * 29) % 90 + 10) / 100.0",
    "emotional_valence": "((vec_id * 53) % 201 - 100) / 100.0", "stability": "((vec_id * 41) % 100) / 100.0", "surprise": "((vec_id * 61) % 100) / 100.0",
    "success_feedback": "((vec_id * 71) % 100) / 100.0", "confidence": "((vec_id * 83) % 90 + 10) / 100.0", "phase_offset": "(vec_id % 628) / 100.0",
    "last_at": f"{AS_OF} - ((vec_id * 7) % 500) * 3600.0",
}
QUERY_ID = 7


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as memories: id, embedding, label and a state."""
    return table(spark, folder, "embeddings").filter("embedding is not null").select(
        F.col("vec_id").alias("id"), "embedding", "label", F.lit("active").alias("state"), *[F.expr(e).cast("double").alias(n) for n, e in _STATE.items()]
    )


def _query_vector(spark: SparkSession, folder: str) -> Column:
    row = table(spark, folder, "embeddings").filter(F.col("vec_id") == QUERY_ID).select("embedding").first()
    return V.literal(row[0]) if row else F.lit(None).cast("array<double>")


_VM = f"vm AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, 'active' AS state, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in _STATE.items())} FROM embeddings WHERE embedding IS NOT NULL)"
_Q = f"q AS (SELECT e AS qe FROM vm WHERE id = {QUERY_ID})"


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-8))"


_PAIRS = f"vp AS MATERIALIZED (SELECT * FROM (SELECT x.id AS a, y.id AS b, {_cos('x.e', 'y.e')} AS cosine FROM vm x JOIN vm y ON x.id < y.id) WHERE cosine > 0.3)"


def _top(score: str, k: int = 10, then: str = "") -> str:
    return S.over(_VM, _Q, then=f"SELECT id, round(s, 6) AS score FROM (SELECT id, {score} AS s FROM vm CROSS JOIN q {then}) ORDER BY round(s, 9) DESC, id LIMIT {k}")


def _best(df: DataFrame, score: Column, k: int = 10) -> DataFrame:
    return df.select("id", score.alias("s")).orderBy(F.desc(F.round("s", 9)), "id").limit(k).select("id", r6("s", "score"))


@query(_top(f"greatest(0.0, {_cos('e', 'qe')}) * {S.RETENTION}"))
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten memories nearest to a query vector, weighted by retention (a top-k report)."""
    return _best(memories(spark, folder), F.greatest(F.lit(0.0), V.cosine(F.col("embedding"), _query_vector(spark, folder))) * decay.retention(AS_OF))


_GAP = "CASE WHEN abs(phase_offset - 1.0) > pi() THEN 2 * pi() - abs(phase_offset - 1.0) ELSE abs(phase_offset - 1.0) END"


@query(_top(f"greatest(0.0, (0.85 * greatest(0.0, {_cos('e', 'qe')}) + 0.15 * (0.5 + 0.5 * cos({_GAP}))) * {S.RETENTION})"))
def oscillation_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten memories of the best similarity and phase coherence (a top-k report)."""
    sim = F.greatest(F.lit(0.0), V.cosine(F.col("embedding"), _query_vector(spark, folder)))
    coherence = 0.5 + 0.5 * F.cos(V.phase_gap(F.col("phase_offset"), 1.0))
    return _best(memories(spark, folder), F.greatest(F.lit(0.0), (0.85 * sim + 0.15 * coherence) * decay.retention(AS_OF)))


@query(S.over(_VM, _Q, then=f"""SELECT id, round(c * r, 6) AS score FROM (SELECT * FROM (SELECT id, {_cos('e', 'qe')} AS c, {S.RETENTION} AS r FROM vm CROSS JOIN q) ORDER BY round(c, 9) DESC, id LIMIT 20) ORDER BY round(c * r, 9) DESC, id LIMIT 10"""))
def cortical_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty memories by similarity, of which the ten best by retention (a top-k report)."""
    near = memories(spark, folder).select("id", V.cosine(F.col("embedding"), _query_vector(spark, folder)).alias("c"), decay.retention(AS_OF).alias("r"))
    return _best(near.orderBy(F.desc(F.round("c", 9)), "id").limit(20), F.col("c") * F.col("r"))


@query(_top(f"0.6 * {_cos('e', 'qe')} + 0.4 * {_cos('list_reverse(e)', 'qe')}", 10, f"WHERE NOT ({_cos('e', 'qe')} < 0.05 AND {_cos('list_reverse(e)', 'qe')} < 0.05)"))
def cross_modal_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """The ten memories by two weighted similarities (the second on the reversed vector; a top-k report)."""
    q = _query_vector(spark, folder)
    one, two = V.cosine(F.col("embedding"), q), V.cosine(F.reverse("embedding"), q)
    m = memories(spark, folder).select("id", one.alias("one"), two.alias("two")).filter(~((F.col("one") < 0.05) & (F.col("two") < 0.05)))
    return _best(m, 0.6 * F.col("one") + 0.4 * F.col("two"))


@query(S.over(_VM, _Q, f"""b AS (SELECT *, {_cos('e', 'qe')} AS c, exp(-{S.hours('last_at')} / 168.0) AS t FROM vm CROSS JOIN q)""", """sd AS (SELECT id FROM b ORDER BY round(c + 0.5 * t, 9) DESC, id LIMIT 5)""",
    then="""SELECT id, round(s, 6) AS score FROM (SELECT id, greatest(0.0, 0.50 * c + 0.12 * t + 0.18 * CASE WHEN id IN (SELECT id FROM sd) THEN 1.0 ELSE 0.0 END + 0.08 * 0.5) AS s FROM b) ORDER BY round(s, 9) DESC, id LIMIT 10"""))
def hybrid_fusion_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten memories by similarity, recency, graph rank and confidence (seeds rank 1 where no edges are; a top-k report)."""
    m = memories(spark, folder).select("id", V.cosine(F.col("embedding"), _query_vector(spark, folder)).alias("c"), F.exp(-decay.hours("last_at", AS_OF) / 168.0).alias("t"))
    seeds = m.orderBy(F.desc(F.round(F.col("c") + 0.5 * F.col("t"), 9)), "id").limit(5).select("id", F.lit(1.0).alias("g"))
    j = m.join(seeds, "id", "left")
    return _best(j, F.greatest(F.lit(0.0), 0.50 * F.col("c") + 0.12 * F.col("t") + 0.18 * F.coalesce("g", F.lit(0.0)) + 0.08 * 0.5))


@query(_top(f"0.20 * {S.RETENTION} + 0.15 * exp(-{S.hours('last_at')} / 168.0) + 0.10 * abs(emotional_valence) + 0.25 * {_cos('e', 'qe')} + 0.05 * surprise", 20))
def gate_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty candidates of the competition, before inhibition (a top-k report)."""
    return _best(memories(spark, folder), _gate_score(_query_vector(spark, folder)), 20)


def _gate_score(q: Column) -> Column:
    c = F.col
    return 0.20 * decay.retention(AS_OF) + 0.15 * F.exp(-decay.hours("last_at", AS_OF) / 168.0) + 0.10 * F.abs("emotional_valence") + 0.25 * V.cosine(c("embedding"), q) + 0.05 * c("surprise")


@query()
def gate_nms(spark: SparkSession, folder: str) -> DataFrame:
    """The winners of the competition with lateral inhibition (a fold over at most 200 candidates)."""
    m = memories(spark, folder).select("id", "embedding", _gate_score(_query_vector(spark, folder)).alias("total"))
    return similarity.inhibit(m.orderBy(F.desc(F.round("total", 9)), "id").limit(200))


@query(S.over(_VM, then=f"""SELECT id, other, round(cosine, 6) AS cosine, rank FROM (SELECT x.id, y.id AS other, {_cos('x.e', 'y.e')} AS cosine, row_number() OVER (PARTITION BY x.id ORDER BY round({_cos('x.e', 'y.e')}, 12) DESC, y.id)::INTEGER AS rank FROM vm x JOIN vm y ON x.id <> y.id) WHERE rank <= 10"""))
def knn_join_k10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector."""
    return similarity.knn(memories(spark, folder), 10).select("id", "other", r6("cosine", "cosine"), "rank")


@query(S.over(_VM, _PAIRS, then="SELECT a, b, round(cosine, 6) AS cosine FROM vp"))
def similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of vectors of a cosine above 0.3."""
    return similarity.similar_pairs(memories(spark, folder), 0.3).select("a", "b", r6("cosine", "cosine"))


def _sided(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The similar pairs with columns of both sides, as a_... and b_..."""
    m = memories(spark, folder)
    p = similarity.similar_pairs(m, 0.3)
    for side in "ab":
        p = p.join(m.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return p


@query(S.over(_VM, _PAIRS, then="SELECT a, b, round(cosine, 6) AS cosine FROM vp JOIN vm x ON x.id = a JOIN vm y ON y.id = b WHERE abs(x.emotional_valence - y.emotional_valence) > 1.0"))
def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Similar memories of opposite emotion."""
    p = _sided(spark, folder, "emotional_valence")
    return p.filter(F.abs(F.col("a_emotional_valence") - F.col("b_emotional_valence")) > 1.0).select("a", "b", r6("cosine", "cosine"))


@query(S.over(_VM, _PAIRS, "sd AS (SELECT a AS id, b AS other, cosine FROM vp UNION ALL SELECT b, a, cosine FROM vp)", then="""SELECT x.id, count(*) AS rivals, round(exp(sum(ln(1.0 - 0.1 * cosine))), 6) AS factor FROM sd JOIN vm x ON x.id = sd.id JOIN vm y ON y.id = other WHERE y.importance > x.importance GROUP BY 1"""))
def interference(spark: SparkSession, folder: str) -> DataFrame:
    """How much similar, more important memories suppress each memory."""
    p = _sided(spark, folder, "importance")
    one = p.filter("b_importance > a_importance").select(F.col("a").alias("id"), "cosine")
    two = p.filter("a_importance > b_importance").select(F.col("b").alias("id"), "cosine")
    return one.unionByName(two).groupBy("id").agg(F.count("*").alias("rivals"), r6(F.product(1.0 - 0.1 * F.col("cosine")), "factor"))


@query(S.over(_VM, _PAIRS, then="SELECT a, b, round(0.3 + 0.2 * cosine, 6) AS stability FROM vp JOIN vm x ON x.id = a JOIN vm y ON y.id = b WHERE x.label <> y.label"))
def cross_session_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Similar memories of different origin as patterns with their stability."""
    p = _sided(spark, folder, "label")
    return p.filter("a_label <> b_label").select("a", "b", r6(0.3 + 0.2 * F.col("cosine"), "stability"))


def _groups(rounds: int) -> str:
    out = ["e4 AS MATERIALIZED (SELECT a, b, cosine FROM vp WHERE cosine > 0.4)", "n4 AS MATERIALIZED (SELECT a AS node, b AS other FROM e4 UNION ALL SELECT b, a FROM e4)", "g0 AS MATERIALIZED (SELECT DISTINCT node, node AS root FROM n4)"]
    out += [f"g{k} AS MATERIALIZED (SELECT g.node, least(any_value(g.root), min(o.root)) AS root FROM g{k - 1} g JOIN n4 ON n4.node = g.node JOIN g{k - 1} o ON o.node = n4.other GROUP BY 1)" for k in range(1, rounds + 1)]
    return ",\n".join(out)


def _roots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = similarity.similar_pairs(memories(spark, folder), 0.4)
    return e, graph.components(e.select(F.col("a").alias("lo"), F.col("b").alias("hi"))).toDF("id", "root")


@query(S.over(_VM, _PAIRS, _groups(12), then="""SELECT root, count(*) AS size, round(max(importance), 6) AS importance, round(avg(frequency), 6) AS frequency, round(least(1.0, max(stability) + 0.15), 6) AS stability FROM g12 JOIN vm ON id = node GROUP BY 1"""))
def near_dup_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Similar memories merged into the oldest: greatest importance, mean frequency, more stability."""
    _, roots = _roots(spark, folder)
    j = roots.join(memories(spark, folder).select("id", "importance", "frequency", "stability"), "id")
    return j.groupBy("root").agg(F.count("*").alias("size"), r6(F.max("importance"), "importance"), r6(F.avg("frequency"), "frequency"), r6(F.least(F.lit(1.0), F.max("stability") + 0.15), "stability"))


@query(S.over(_VM, _PAIRS, _groups(12), then="""SELECT root, size, pairs, round(mean, 6) AS mean_cosine FROM (SELECT root, count(*) AS size FROM g12 GROUP BY 1) JOIN (SELECT root, count(*) AS pairs, avg(cosine) AS mean FROM e4 JOIN g12 ON node = a GROUP BY 1) USING (root) WHERE size >= 3"""))
def abstraction_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of three or more similar memories with their mean similarity."""
    e, roots = _roots(spark, folder)
    sizes = roots.groupBy("root").agg(F.count("*").alias("size")).filter("size >= 3")
    means = e.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.count("*").alias("pairs"), F.avg("cosine").alias("m"))
    return sizes.join(means, "root").select("root", "size", "pairs", r6("m", "mean_cosine"))


_CENT = "cn AS MATERIALIZED (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vm) GROUP BY 1, 2) GROUP BY 1)"


@query(S.over(_VM, _CENT, then="SELECT label, (SELECT count(*) FROM vm v WHERE v.label = cn.label) AS n, round(sqrt(list_dot_product(centroid, centroid)), 6) AS norm, round(centroid[1], 6) AS first FROM cn"))
def centroid_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of every label."""
    c = similarity.centroids(memories(spark, folder), "label")
    return c.select("label", "n", r6(V.norm(F.col("centroid")), "norm"), r6(F.col("centroid")[0], "first"))


@query(S.over(_VM, _CENT, then=f"""SELECT id, label, to_label, round(c, 6) AS cosine FROM (SELECT id, vm.label, cn.label AS to_label, {_cos('e', 'centroid')} AS c, row_number() OVER (PARTITION BY id ORDER BY round({_cos('e', 'centroid')}, 9) DESC, cn.label) AS rn FROM vm CROSS JOIN cn) WHERE rn = 1"""))
def route_by_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The label whose centroid is nearest to each vector, whatever the number of labels."""
    m = memories(spark, folder)
    near = similarity.nearest_centroid(m, similarity.centroids(m, "label"), "label")
    return m.select("id", "label").join(near, "id").select("id", "label", "to_label", r6("cosine", "cosine"))


@query()
def leader_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy leader clusters within each label."""
    return similarity.leader_clusters(memories(spark, folder), "label", 0.25)


@query()
def kmeans_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors split into three shards by cosine k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    m = memories(spark, folder).select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=3, seed=42, maxIter=20, distanceMeasure="cosine").fit(m)
    return model.transform(m).select("id", F.col("prediction").alias("shard"))


@query()
def ghost_resonance(spark: SparkSession, folder: str) -> DataFrame:
    """How strongly each pruned memory resonates with a query vector."""
    g = memory.ghosts(spark, folder).filter("residue_blob is not null").select("*", V.floats("residue_blob").alias("trace"))
    q = V.strided(_query_vector(spark, folder), 16)
    p = F.least(F.lit(1.0), 0.3 + 0.2 * F.col("revival_count")) * decay.ebbinghaus_ghost(decay.hours("pruned_at", AS_OF), F.col("importance"))
    return g.select("id", r6(V.cosine(F.col("trace"), q) * F.greatest(F.lit(0.05), p), "resonance")).filter("resonance is not null")


@query(S.over(S.MEM, then="""SELECT id, round(r, 6) AS resonance FROM (SELECT id, CASE WHEN abs(natural_frequency - 0.6) > 0.15 * coupling_strength OR coupling_strength = 0 THEN 0.0
    ELSE exp(-pow(natural_frequency - 0.6, 2) / (2 * pow(0.15 * coupling_strength, 2))) * greatest(0.0, cos(CASE WHEN abs(phase_offset - 1.0) > pi() THEN 2 * pi() - abs(phase_offset - 1.0) ELSE abs(phase_offset - 1.0) END)) * coupling_strength END AS r FROM mem) WHERE r >= 0.1"""))
def oscillatory_resonance(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors that resonate with a drive."""
    return memory.anchors(spark, folder).select("id", V.resonance(0.6, 1.0).alias("r")).filter("r >= 0.1").select("id", r6("r", "resonance"))


@query(S.over(_VM, then="SELECT label, tier, count(*) AS n FROM (SELECT label, ntile(4) OVER (PARTITION BY label ORDER BY importance DESC, id)::INTEGER AS tier FROM vm) GROUP BY 1, 2"))
def importance_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Quarters of each label by importance."""
    scratch = Scratch(spark, "tiers")
    placed = scratch.keep(ordered.with_position(memories(spark, folder).select("label", "importance", "id"), ["label"], [F.desc("importance"), F.col("id")], scratch))
    tier = ordered.tile(F.col("position"), F.col("size"), 4)
    return ordered.sizes(placed, ["label"]).select("label", tier.alias("tier")).groupBy("label", "tier").agg(F.count("*").alias("n"))
