"""Queries that recall anchors by their stored vectors, their graph, and several levels of search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators import graph, recall, search
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.graphs import _GRAPH, _both, _levels, _lpa, _ppr, _topo
from mnemospark.plans.layers import _TIER, tier
from mnemospark.plans.pipelines import _PLANE, plane_score
from mnemospark.plans.texts import _bm25
from mnemospark.plans.timeline import _DOMAIN, domain
from mnemospark.plans.vectors import _cos
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

QUERY = "which preference and workflow fix did we note about memory and sleep"

#: The vectors of anchors, read from their bytes, and the memories that have one.
_VEC = f"""bits AS (SELECT id, list_transform(range(0, 64), lambda k: ('0x' || h[8 * k + 7 : 8 * k + 8] || h[8 * k + 5 : 8 * k + 6] || h[8 * k + 3 : 8 * k + 4] || h[8 * k + 1 : 8 * k + 2])::UINTEGER::BIGINT) AS u
    FROM (SELECT {S.key('id')} AS id, hex(min(embedding_blob)) AS h FROM anchors WHERE octet_length(embedding_blob) = 256 GROUP BY 1) WHERE id IS NOT NULL),
vec AS MATERIALIZED (SELECT id, list_transform(u, lambda x: CASE WHEN x % 2147483648 = 0 THEN 0.0 ELSE (CASE WHEN x >= 2147483648 THEN -1.0 ELSE 1.0 END) * (1.0 + (x % 8388608) / 8388608.0) * pow(2.0, ((x // 8388608) % 256) - 127) END) AS e FROM bits
    WHERE len(list_filter(u, lambda x: (x // 8388608) % 256 = 255)) = 0 AND len(list_filter(u, lambda x: x % 2147483648 <> 0)) > 0),
vm AS MATERIALIZED (SELECT mem.*, e FROM mem JOIN vec USING (id)), q AS MATERIALIZED (SELECT e AS qe FROM vec ORDER BY id LIMIT 1),
near AS MATERIALIZED (SELECT *, {_cos('e', 'qe')} AS c, {S.RETENTION} AS ret, {_DOMAIN} AS domain FROM vm CROSS JOIN q WHERE state <> 'ghost'),
seeds AS MATERIALIZED (SELECT id AS node FROM near ORDER BY round(c, 9) DESC, id LIMIT 5)"""
_BASE = (S.MEM, _VEC)


def _memories(spark: SparkSession, folder: str) -> DataFrame:
    """The retrievable anchors with a usable vector: their state, the cosine ``c`` with the query vector, retention and domain; stored."""
    scratch = Scratch(spark, "near")
    vectors = scratch.keep(memory.vectors(spark, folder))
    q = query_vector(vectors)
    own = memory.anchors(spark, folder).join(vectors, "id").filter(decay.is_retrievable())
    return scratch.keep(own.withColumns({"c": V.cosine(F.col("embedding"), q), "ret": decay.retention(AS_OF), "domain": domain()}))


def query_vector(vectors: DataFrame) -> Column:
    """The query vector: that of the first anchor."""
    row = vectors.orderBy("id").select("embedding").first()
    return V.literal(row[0]) if row else F.lit(None).cast("array<double>")


def _seeds(near: DataFrame) -> DataFrame:
    return search.ranked(near.select("id", F.col("c").alias("score")), 5).select(F.col("id").alias("node"), "score")


def _top(scored: DataFrame, k: int = 10) -> DataFrame:
    return search.ranked(scored, k).select("id", r6("score", "score"))


_ORDER = "ORDER BY round(s, 9) DESC, id LIMIT"


@query(S.over(*_BASE, then=f"SELECT id, round(s, 6) AS score FROM (SELECT id, greatest(0.0, c) * ret AS s FROM near) {_ORDER} 10"))
def anchors_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten anchors nearest to a query vector, weighted by retention (a top-k report)."""
    return _top(_memories(spark, folder).select("id", (F.greatest(F.lit(0.0), "c") * F.col("ret")).alias("score")))


_WALK = """b0 AS (SELECT id AS node, c AS s, 0 AS depth FROM near WHERE id IN (SELECT node FROM seeds)), b1 AS MATERIALIZED (SELECT other AS node, max(s * tw) AS s, 1 AS depth FROM b0 JOIN step USING (node) GROUP BY 1),
b2 AS (SELECT other AS node, max(s * tw * 0.6) AS s, 2 AS depth FROM b1 JOIN step USING (node) GROUP BY 1),
walk AS MATERIALIZED (SELECT node, s, depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(s, 9) DESC, depth) AS rn FROM (FROM b0 UNION ALL FROM b1 UNION ALL FROM b2)) WHERE rn = 1)"""
_NO_BRIDGE = _topo("SELECT NULL::VARCHAR AS node, 0 AS labels WHERE false")


@query(S.over(*_BASE, *_GRAPH, _WALK, _NO_BRIDGE, then=f"""SELECT id, depth, round(s, 6) AS score FROM (SELECT walk.node AS id, depth, 0.6 * (0.6 * coalesce(t, 0.0) + 0.4 * walk.s) + 0.4 * coalesce(near.c, 0.0) AS s FROM walk JOIN mem ON mem.id = walk.node LEFT JOIN near ON near.id = walk.node LEFT JOIN topo ON topo.node = walk.node WHERE mem.state <> 'ghost') {_ORDER} 10"""))
def graph_first_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of a walk of two hops from the five nearest, by graph before similarity (a top-k report)."""
    near, both = _memories(spark, folder), _both(spark, folder)
    walk = recall.walk(both, _seeds(near), 2)
    live = memory.anchors(spark, folder).filter(decay.is_retrievable()).select(F.col("id").alias("node"))
    rows = walk.join(live, "node").join(near.select(F.col("id").alias("node"), "c"), "node", "left").join(graph.topology(both).select("node", "topology"), "node", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = rows.select(F.col("node").alias("id"), "depth", (0.6 * (0.6 * zero("topology") + 0.4 * F.col("score")) + 0.4 * zero("c")).alias("score"))
    return search.ranked(scored, 10).select("id", "depth", r6("score", "score"))


@query(S.over(*_BASE, *_GRAPH, _levels(3), f"act AS (SELECT node, sum(a) AS a FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) GROUP BY 1 ORDER BY round(sum(a), 9) DESC, node LIMIT 48)",
    then=f"SELECT id, round(s, 6) AS score FROM (SELECT id, 0.6 * least(1.0, a) + 0.4 * c AS s FROM act JOIN near ON id = node) {_ORDER} 10"))
def recall_with_spreading(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best by activation that spreads from the five nearest, refined by similarity (a top-k report)."""
    near = _memories(spark, folder)
    activated = graph.spread_accumulated(_both(spark, folder), _seeds(near).select("node"))
    rows = activated.join(near.select(F.col("id").alias("node"), "c"), "node")
    return _top(rows.select(F.col("node").alias("id"), (0.6 * F.least(F.lit(1.0), "activation") + 0.4 * F.col("c")).alias("score")))


@query(S.over(*_BASE, *_GRAPH, _bm25("SELECT id, text FROM near"), "h AS (SELECT id, c, exp(-" + S.hours("last_at") + " / 168.0) AS t FROM near)",
    "sd5 AS MATERIALIZED (SELECT id AS node FROM h ORDER BY round(c + 0.5 * t, 9) DESC, id LIMIT 5)", _ppr(10).replace("FROM seeds", "FROM sd5").replace("JOIN seeds", "JOIN sd5"),
    then=f"""SELECT id, round(s, 6) AS score FROM (SELECT h.id, greatest(0.0, 0.50 * c + 0.12 * t + 0.18 * coalesce(rank / (SELECT max(rank) FROM p10), 0.0) + 0.08 * 0.5 + 0.12 * coalesce(bm.score / greatest(0.01, (SELECT max(score) FROM bm)), 0.0)) AS s
    FROM h LEFT JOIN p10 ON p10.node = h.id LEFT JOIN bm ON bm.id = h.id) {_ORDER} 10"""))
def hybrid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best by similarity, recency, personalised rank, confidence and keywords (a top-k report)."""
    from mnemospark.plans.texts import QUERY as TEXT

    scratch = Scratch(spark, "fusion")
    near = _memories(spark, folder).withColumn("t", F.exp(-decay.hours("last_at", AS_OF) / 168.0))
    seeds = search.ranked(near.select("id", (F.col("c") + 0.5 * F.col("t")).alias("score")), 5).select(F.col("id").alias("node"))
    rank = scratch.keep(graph.pagerank(_both(spark, folder), seeds, 10))
    words = scratch.keep(search.bm25(near.select("id", "text"), TEXT))
    most = rank.agg(F.max("rank")).first()[0] or 1.0
    best = max(0.01, words.agg(F.max("score")).first()[0] or 0.0)
    rows = near.select("id", "c", "t").join(rank.withColumnRenamed("node", "id"), "id", "left").join(words.withColumnRenamed("score", "words"), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return _top(rows.select("id", F.greatest(F.lit(0.0), 0.50 * F.col("c") + 0.12 * F.col("t") + 0.18 * zero("rank") / most + 0.08 * 0.5 + 0.12 * zero("words") / best).alias("score")))


# The levels of the domains, what a level multiplies a route's score by, and the words that speak for each.
CORTICES = {
    "reflection": (0, 1.5, ("error", "strategy", "pattern", "improvement", "lesson")), "semantic": (1, 1.25, ("preference", "knowledge", "concept", "fact", "definition")),
    "procedural": (2, 1.1, ("workflow", "solution", "howto", "fix", "process")), "episodic": (3, 1.0, ()),
}
# Days after which a memory of each level has faded by half.
HALF_LIFE_DAYS = (365.0, 180.0, 90.0, 30.0, 1.0)


def cortices(spark: SparkSession) -> DataFrame:
    """The dimension of domains: (domain, level, level_weight, words, half_life_days)."""
    rows = [(d, level, w, list(words), HALF_LIFE_DAYS[level]) for d, (level, w, words) in CORTICES.items()]
    return spark.createDataFrame(rows, "domain string, level int, level_weight double, words array<string>, half_life_days double")


_CORTEX = "cx AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', {lv}, {w}::DOUBLE, {list(ws)!r}::VARCHAR[], {HALF_LIFE_DAYS[lv]}::DOUBLE)" for d, (lv, w, ws) in CORTICES.items()) + ") t(domain, level, level_weight, words, half_life_days))"
_ROUTE = f"""cn AS (SELECT domain, list(m ORDER BY i) AS centroid FROM (SELECT domain, i, avg(x) AS m FROM (SELECT domain, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM near) GROUP BY 1, 2) GROUP BY 1),
lastd AS (SELECT domain, count(*) AS n, max(last_at) AS last_at FROM near GROUP BY 1),
route AS MATERIALIZED (SELECT domain, level, n, centroid, (0.6 * {_cos('centroid', 'qe')} + 0.3 * CASE WHEN len(words) = 0 THEN 0.0 ELSE least(1.0, len(list_intersect(words, string_split('{QUERY}', ' '))) / len(words) * 2) END + 0.1 * exp(-{S.hours('last_at')} / 24.0)) * level_weight AS s
    FROM cn JOIN lastd USING (domain) JOIN cx USING (domain) CROSS JOIN q)"""


def _route(spark: SparkSession, near: DataFrame, q: Column) -> DataFrame:
    """(domain, level, n, centroid, score) of every domain that has memories: similarity, keywords and recency, by level."""
    from mnemospark.operators import similarity

    c = F.col
    last = near.groupBy("domain").agg(F.max("last_at").alias("last_at"))
    rows = similarity.centroids(near, "domain").join(last, "domain").join(cortices(spark), "domain")
    wanted = F.array(*map(F.lit, QUERY.split()))
    words = F.when(F.size("words") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect("words", wanted)) / F.greatest(F.lit(1), F.size("words")) * 2))
    score = (0.6 * V.cosine(c("centroid"), q) + 0.3 * words + 0.1 * F.exp(-decay.hours("last_at", AS_OF) / 24.0)) * c("level_weight")
    return rows.select("domain", "level", "n", "centroid", score.alias("score"))


@query(S.over(*_BASE, _CORTEX, _ROUTE, then="SELECT domain, level, n, round(s, 6) AS score FROM route"))
def cortex_route(spark: SparkSession, folder: str) -> DataFrame:
    """How well each domain matches a query, weighted by its level."""
    near = _memories(spark, folder)
    return _route(spark, near, query_vector(near)).select("domain", "level", "n", r6("score", "score"))


_GATE = f"0.20 * ret + 0.15 * exp(-{S.hours('last_at')} / 168.0) + 0.10 * abs(emotional_valence) + 0.25 * c + 0.05 * surprise"


@query(S.over(*_BASE, _CORTEX, _ROUTE, "on3 AS (SELECT domain FROM route WHERE s >= 0.1 ORDER BY round(s, 9) DESC, level LIMIT 3)", "loc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(greatest(0.0, c) * ret, 9) DESC, id) AS rn FROM near WHERE domain IN (SELECT domain FROM on3)) WHERE rn <= 20)",
    then=f"SELECT id, domain, round(s, 6) AS score FROM (SELECT id, domain, {_GATE} AS s FROM loc) {_ORDER} 20"))
def sparse_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty winners of the gate among the twenty best of each of at most three routed domains (a top-k report)."""
    near = _memories(spark, folder)
    on = _route(spark, near, query_vector(near)).filter("score >= 0.1").orderBy(F.desc(F.round("score", 9)), "level").limit(3).select("domain")
    rn = F.row_number().over(W.partitionBy("domain").orderBy(F.desc(F.round(F.greatest(F.lit(0.0), "c") * F.col("ret"), 9)), "id"))
    local = near.join(on, "domain", "left_semi").withColumn("rn", rn).filter("rn <= 20")
    gate = 0.20 * F.col("ret") + 0.15 * F.exp(-decay.hours("last_at", AS_OF) / 168.0) + 0.10 * F.abs("emotional_valence") + 0.25 * F.col("c") + 0.05 * F.col("surprise")
    return search.ranked(local.select("id", "domain", gate.alias("score")), 20).select("id", "domain", r6("score", "score"))


@query(S.over(*_BASE, _CORTEX, _ROUTE, then=f"""SELECT id, domain, round(least(1.0, importance + 0.1 * sim), 6) AS importance FROM (SELECT near.id, near.domain, near.importance, {_cos('e', 'centroid')} AS sim FROM near JOIN cx USING (domain) CROSS JOIN (SELECT centroid FROM route WHERE domain = 'semantic') WHERE level > 1) WHERE sim > 0.15"""))
def cortex_propagate(spark: SparkSession, folder: str) -> DataFrame:
    """Memories of lower domains that the centre of the semantic one raises in importance."""
    near = _memories(spark, folder)
    row = _route(spark, near, query_vector(near)).filter("domain = 'semantic'").select("centroid").first()
    centre = V.literal(row[0]) if row else F.lit(None).cast("array<double>")
    lower = near.join(cortices(spark).filter("level > 1").select("domain"), "domain", "left_semi")
    raised = lower.select("id", "domain", "importance", V.cosine(F.col("embedding"), centre).alias("sim")).filter("sim > 0.15")
    return raised.select("id", "domain", r6(F.least(F.lit(1.0), F.col("importance") + 0.1 * F.col("sim")), "importance"))


_DESCENT = f"""v0 AS (SELECT id, c AS s FROM near WHERE {S.THERMAL} = 'hot' AND c >= 0.3 ORDER BY round(c, 9) DESC, id LIMIT 5),
v1 AS (SELECT id, greatest(0.0, c) * ret AS s FROM near WHERE domain = (SELECT domain FROM route ORDER BY round(s, 9) DESC, level LIMIT 1) ORDER BY round(greatest(0.0, c) * ret, 9) DESC, id LIMIT 5),
n1 AS (SELECT DISTINCT other AS id FROM both_ways WHERE node IN (FROM v0 SELECT id UNION FROM v1 SELECT id)), n2 AS (SELECT DISTINCT other AS id FROM both_ways WHERE node IN (SELECT id FROM n1)),
v2 AS (SELECT id, importance AS s FROM near WHERE id IN (FROM n1 UNION FROM n2) ORDER BY round(importance, 9) DESC, id LIMIT 5),
v3 AS (SELECT id, {_PLANE} AS s FROM mem WHERE state <> 'ghost' ORDER BY round({_PLANE}, 9) DESC, id LIMIT 10), v4 AS (SELECT id, ret AS s FROM near ORDER BY last_at DESC, id LIMIT 10),
lv AS (SELECT *, 0 AS level FROM v0 UNION ALL SELECT *, 1 FROM v1 UNION ALL SELECT *, 2 FROM v2 UNION ALL SELECT *, 3 FROM v3 UNION ALL SELECT *, 4 FROM v4)"""


@query(S.over(*_BASE, S.LINKS, S.PAIRS, S.BOTH, _CORTEX, _ROUTE, _DESCENT, then="""SELECT id, level, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS rn FROM lv) WHERE rn = 1 ORDER BY level, round(s, 9) DESC, id LIMIT 15"""))
def retrieve_with_descent(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen memories from the hot nodes down over the routed domain, linked ones, the plane and the timeline; the first level counts (a top-k report)."""
    scratch = Scratch(spark, "descent")
    near = _memories(spark, folder)
    c = F.col
    brain = search.ranked(near.filter((decay.thermal() == "hot") & (c("c") >= 0.3)).select("id", c("c").alias("score")), 5)
    first = _route(spark, near, query_vector(near)).orderBy(F.desc(F.round("score", 9)), "level").limit(1).select("domain")
    local = search.ranked(near.join(first, "domain", "left_semi").select("id", (F.greatest(F.lit(0.0), "c") * c("ret")).alias("score")), 5)
    starts = scratch.keep(brain.select("id").union(local.select("id")).distinct())
    linked = recall.reached(_both(spark, folder), starts.toDF("node"), 2).select(F.col("node").alias("id"))
    hubs = search.ranked(near.join(linked, "id", "left_semi").select("id", c("importance").alias("score")), 5)
    plane = search.ranked(memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", plane_score().alias("score")), 10)
    latest = near.orderBy(F.desc("last_at"), "id").limit(10).select("id", c("ret").alias("score"))
    return recall.descent([brain, local, hubs, plane, latest], 15).select("id", "level", r6("score", "score"))


@query(S.over(*_BASE, then=f"""SELECT id, level, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS rn FROM (
    SELECT * FROM (SELECT id, 0.7 * c + 0.3 * importance + 0.15 AS s, 0 AS level FROM near WHERE state = 'active' AND replay_count = 0 {_ORDER} 3) UNION ALL SELECT * FROM (SELECT id, greatest(0.0, c) * ret AS s, 1 AS level FROM near WHERE c > 0.1 {_ORDER} 10)
    UNION ALL SELECT * FROM (SELECT id, {_PLANE} AS s, 2 AS level FROM near {_ORDER} 10) UNION ALL SELECT * FROM (SELECT id, ret AS s, 3 AS level FROM near {_ORDER} 10))) WHERE rn = 1 ORDER BY level, round(s, 9) DESC, id LIMIT 15"""))
def scheduler_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen memories from working memory, similarity, the plane and the timeline; the first level counts (a top-k report)."""
    near, c = _memories(spark, folder), F.col
    working = near.filter("state = 'active' and replay_count = 0").select("id", (0.7 * c("c") + 0.3 * c("importance") + 0.15).alias("score"))
    levels = [(working, 3), (near.filter("c > 0.1").select("id", (F.greatest(F.lit(0.0), "c") * c("ret")).alias("score")), 10), (near.select("id", plane_score().alias("score")), 10), (near.select("id", c("ret").alias("score")), 10)]
    return recall.descent([search.ranked(df, k) for df, k in levels], 15).select("id", "level", r6("score", "score"))


_SCOPE = """home AS (SELECT label FROM near JOIN lab4 ON node = id ORDER BY round(c, 9) DESC, id LIMIT 1),
around AS (SELECT y.label FROM both_ways b JOIN lab4 x ON x.node = b.node JOIN lab4 y ON y.node = b.other WHERE x.label = (SELECT label FROM home) AND y.label <> x.label GROUP BY 1 ORDER BY round(sum(weight), 9) DESC, y.label LIMIT 3),
scoped AS (SELECT id, c * ret AS s, CASE WHEN label = (SELECT label FROM home) THEN 'intra' WHEN label IN (SELECT label FROM around) THEN 'neighbour' ELSE 'full' END AS scope FROM near LEFT JOIN lab4 ON node = id)"""


@query(S.over(*_BASE, *_GRAPH, _lpa(4), _SCOPE, then="SELECT id, scope, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY round(s, 9) DESC, id) AS rn FROM scoped) WHERE rn <= 5"))
def community_aware_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The five best within the query's community, in the three communities most linked to it, and in all others (a top-k report)."""
    scratch = Scratch(spark, "scope")
    near, both = _memories(spark, folder), _both(spark, folder)
    labels = scratch.keep(graph.label_propagation(both, 4))
    own = near.join(labels.toDF("id", "label"), "id", "left")
    home = own.filter("label is not null").orderBy(F.desc(F.round("c", 9)), "id").select("label").first()
    home = home[0] if home else None
    cross = both.join(labels, "node").filter(F.col("label") == F.lit(home)).join(labels.toDF("other", "theirs"), "other").filter("theirs <> label")
    around = cross.groupBy("theirs").agg(F.round(F.sum("weight"), 9).alias("w")).orderBy(F.desc("w"), "theirs").limit(3)
    around = [r[0] for r in around.collect()]
    scope = F.when(F.col("label") == F.lit(home), "intra").when(F.col("label").isin(*around) if around else F.lit(False), "neighbour").otherwise("full")
    scored = own.select("id", scope.alias("scope"), (F.col("c") * F.col("ret")).alias("score"))
    rn = F.row_number().over(W.partitionBy("scope").orderBy(F.desc(F.round("score", 9)), "id"))
    return scored.withColumn("rn", rn).filter("rn <= 5").select("id", "scope", r6("score", "score"))


@query(S.over(*_BASE, f"tr AS (SELECT id, {_TIER} AS tier, c AS s FROM near)", then="""SELECT id, tier, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(s, 9) DESC, id) AS rn FROM tr) WHERE rn <= CASE tier WHEN 'core' THEN 3 ELSE 10 END
    ORDER BY CASE tier WHEN 'core' THEN 0 WHEN 'ltm' THEN 1 WHEN 'mtm' THEN 2 ELSE 3 END, round(s, 9) DESC, id LIMIT 20"""))
def tier_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty memories from the core tier down to the short-term one (a top-k report)."""
    rn = F.row_number().over(W.partitionBy("tier").orderBy(F.desc(F.round("score", 9)), "id"))
    rows = _memories(spark, folder).select("id", tier().alias("tier"), F.col("c").alias("score")).withColumn("rn", rn)
    place = F.array_position(F.array(*map(F.lit, ("core", "ltm", "mtm", "stm"))), F.col("tier"))
    return rows.filter(F.col("rn") <= F.when(F.col("tier") == "core", 3).otherwise(10)).orderBy(place, F.desc(F.round("score", 9)), "id").limit(20).select("id", "tier", r6("score", "score"))


_FIRST = "(SELECT node FROM (SELECT node, count(*) AS n FROM both_ways GROUP BY 1 ORDER BY n DESC, node LIMIT 1))"


@query(S.over(*_GRAPH, f"""c0 AS (SELECT {_FIRST} AS node, 0 AS depth, 9.0::DOUBLE AS tw)""", "c1 AS (SELECT other AS node, 1 AS depth, max(step.tw) AS tw FROM c0 JOIN step USING (node) WHERE step.tw >= 0.1 AND other NOT IN (SELECT node FROM c0) GROUP BY 1)",
    "c2 AS (SELECT other AS node, 2 AS depth, max(step.tw) AS tw FROM c1 JOIN step USING (node) WHERE step.tw >= 0.1 AND other NOT IN (SELECT node FROM c0 UNION SELECT node FROM c1) GROUP BY 1)",
    then="SELECT node, depth FROM (FROM c0 UNION ALL FROM c1 UNION ALL FROM c2) ORDER BY depth, round(tw, 9) DESC, node LIMIT 20"))
def constellation(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty nodes met first around the greatest hub, strongest edges first (a top-k report)."""
    both = _both(spark, folder)
    return recall.constellation(both, graph.hubs(both, 1).select("node"), 2, 20).select("node", "depth")


@query(S.over(*_BASE, *_GRAPH, f"""rs AS (SELECT id, r FROM (SELECT id, CASE WHEN abs(natural_frequency - 0.6) > 0.15 * coupling_strength OR coupling_strength = 0 THEN 0.0
    ELSE exp(-pow(natural_frequency - 0.6, 2) / (2 * pow(0.15 * coupling_strength, 2))) * greatest(0.0, cos(CASE WHEN abs(phase_offset - 1.0) > pi() THEN 2 * pi() - abs(phase_offset - 1.0) ELSE abs(phase_offset - 1.0) END)) * coupling_strength END AS r FROM near) WHERE r >= 0.1 ORDER BY round(r, 9) DESC, id LIMIT 10)""",
    "ct AS (SELECT id FROM (SELECT id, c, ret FROM near ORDER BY round(c, 9) DESC, id LIMIT 10) ORDER BY round(c * ret, 9) DESC, id LIMIT 5)",
    "five AS MATERIALIZED (SELECT id AS node FROM (SELECT id, 0 AS path, row_number() OVER (ORDER BY round(r, 9) DESC, id) AS k FROM rs UNION ALL SELECT id, 1, row_number() OVER (ORDER BY id) FROM ct WHERE id NOT IN (SELECT id FROM rs)) ORDER BY path, k LIMIT 5)",
    "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS a FROM five)", "w0 AS (SELECT * FROM r0)",
    *[x for k in (1, 2, 3) for x in (f"w{k} AS MATERIALIZED (SELECT other AS node, sum(a * tw * 0.6) AS a FROM w{k - 1} JOIN step USING (node) WHERE tw >= 0.05 AND other NOT IN (SELECT node FROM r{k - 1}) GROUP BY 1)", f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM w{k})")],
    then="SELECT node, round(a, 6) AS activation FROM (SELECT node, a / greatest(1.0, (SELECT max(a) FROM r3)) AS a FROM r3) WHERE a >= 0.1"))
def resonate(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that activation from resonant and near seeds reaches with a tenth or more."""
    near = _memories(spark, folder)
    resonant = search.ranked(near.select("id", V.resonance(0.6, 1.0).alias("score")).filter("score >= 0.1"), 10).select("id", F.lit(0).alias("path"), F.col("rank").alias("k"))
    close = search.ranked(near.select("id", "ret", F.col("c").alias("score")), 10).select("id", (F.col("score") * F.col("ret")).alias("score"))
    cortical = search.ranked(close, 5).select("id").join(resonant.select("id"), "id", "left_anti").select("id", F.lit(1).alias("path"), F.row_number().over(W.orderBy("id")).alias("k"))
    seeds = Scratch(spark, "seeds").keep(resonant.unionByName(cortical).orderBy("path", "k").limit(5).select(F.col("id").alias("node")))
    return graph.spread(_both(spark, folder), seeds).filter("activation >= 0.1").select("node", r6("activation", "activation"))


@query(S.over(S.LINKS, "down AS MATERIALIZED (SELECT DISTINCT src, dst FROM links WHERE edge_type IN ('compresses', 'summarizes', 'instance_of', 'before'))", "t0 AS (SELECT src AS node FROM down GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)",
    *[f"t{k} AS MATERIALIZED (SELECT DISTINCT dst AS node FROM t{k - 1} JOIN down ON src = node WHERE dst NOT IN ({' UNION '.join(f'SELECT node FROM t{j}' for j in range(k))}))" for k in (1, 2, 3, 4)],
    then=" UNION ALL ".join(f"SELECT node, {k} AS depth, round(pow(0.85, {k}), 6) AS score FROM t{k}" for k in (1, 2, 3, 4))))
def descendants(spark: SparkSession, folder: str) -> DataFrame:
    """What lies below the three nodes with most parts, up to four levels, fading by level."""
    down = memory.edges(spark, folder).filter(F.col("edge_type").isin("compresses", "summarizes", "instance_of", "before")).select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct()
    down = Scratch(spark, "down").keep(down)
    roots = down.groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(3).select("node")
    return recall.levels(down, roots, 4).filter("depth > 0").select("node", "depth", r6(F.pow(F.lit(0.85), "depth"), "score"))


_WORDS = "list_distinct(list_filter(string_split(lower({}), ' '), lambda x: x <> ''))"


@query(S.over(S.MEM, then=f"""SELECT id, round(s, 6) AS score FROM (SELECT id, stability * exp(-{S.hours('last_at')} / 168.0) * (1.0 + 0.2 * len(list_intersect({_WORDS.format('text')}, string_split('{QUERY}', ' ')))) * (1.0 + 0.3 * len(list_filter(tags, lambda t: contains('{QUERY}', t)))) AS s
    FROM mem WHERE stability >= 0.05 AND emotional_valence <> 0) {_ORDER} 10"""))
def recall_self(spark: SparkSession, folder: str) -> DataFrame:
    """The ten stable, felt memories that say most about oneself for a query (a top-k report)."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    overlap = F.size(F.array_intersect(words, F.array(*map(F.lit, QUERY.split()))))
    tags = F.size(F.filter("tags", lambda t: F.contains(F.lit(QUERY), t)))
    s = F.col("stability") * F.exp(-decay.hours("last_at", AS_OF) / 168.0) * (1.0 + 0.2 * overlap) * (1.0 + 0.3 * tags)
    return _top(memory.anchors(spark, folder).filter("stability >= 0.05 and emotional_valence <> 0").select("id", s.alias("score")))


@query(S.over(S.MEM, f"sc AS (SELECT k AS id, confidence, created_at, ids FROM (SELECT {S.key('id')} AS k, confidence, created_at, {S.ids('instance_ids_json')} AS ids, row_number() OVER (PARTITION BY {S.key('id')} ORDER BY loaded_at DESC, confidence DESC NULLS LAST) AS rn FROM schemas) WHERE rn = 1 AND k IS NOT NULL)",
    "hot AS (SELECT list(id) AS ids FROM mem WHERE state = 'active' AND importance > 0.6)", then="SELECT id, len(list_intersect(sc.ids, hot.ids)) AS n, round(confidence, 6) AS score FROM sc CROSS JOIN hot WHERE confidence > 0.1 AND len(list_intersect(sc.ids, hot.ids)) > 0"))
def find_reflections(spark: SparkSession, folder: str) -> DataFrame:
    """Abstract patterns over any active, important anchor, with how many of them they cover."""
    hot = memory.anchors(spark, folder).filter("state = 'active' and importance > 0.6").select(F.col("id").alias("member"))
    each = memory.schemas(spark, folder).filter("confidence > 0.1").select("id", "confidence", F.explode("ids").alias("member"))
    return each.join(hot, "member", "left_semi").groupBy("id").agg(F.count("*").alias("n"), r6(F.first("confidence"), "score"))


@query(S.over(S.MEM, f"sc AS (SELECT DISTINCT {S.key('id')} AS id, template, loaded_at FROM schemas)", f"""lt AS (SELECT id, {_WORDS.format('template')} AS words FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, template DESC) AS rn FROM sc) WHERE rn = 1 AND id IS NOT NULL AND template IS NOT NULL)""",
    f"mw AS (SELECT DISTINCT id AS anchor, unnest({_WORDS.format('text')}) AS w FROM mem WHERE state = 'active' AND importance > 0.9)",
    then="SELECT anchor, id AS schema, round(n / of::DOUBLE, 6) AS match FROM (SELECT anchor, x.id, count(*) AS n, any_value(of) AS of FROM (SELECT id, unnest(words) AS w, len(words) AS of FROM lt) x JOIN mw USING (w) GROUP BY 1, 2) WHERE n / of::DOUBLE >= 0.3"))
def schema_match(spark: SparkSession, folder: str) -> DataFrame:
    """Which patterns' templates the most important active texts match: the share of the template's words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda x: x != ""))
    t = memory.schemas(spark, folder).filter("template is not null").select(F.col("id").alias("schema"), words("template").alias("words"))
    a = memory.anchors(spark, folder).filter("state = 'active' and importance > 0.9").select(F.col("id").alias("anchor"), words("text").alias("words"))
    scratch = Scratch(spark, "match")
    return search.word_matches(scratch.keep(a), scratch.keep(t), 0.3).select("anchor", "schema", r6("m", "match"))


@query(S.over(*_BASE, then=f"""SELECT id, round(s, 6) AS score FROM (SELECT id, CASE WHEN list_has_any(tags, ['image', 'photo']) THEN 0.3 * c + 0.7 * {_cos('list_reverse(e)', 'qe')} ELSE 0.9 * c + 0.1 * {_cos('list_reverse(e)', 'qe')} END AS s FROM near) {_ORDER} 10"""))
def multimodal_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of two vector columns with weights by the kind of row (a top-k report)."""
    near = _memories(spark, folder)
    two = V.cosine(F.reverse("embedding"), query_vector(near))
    image = F.arrays_overlap("tags", F.array(F.lit("image"), F.lit("photo")))
    return _top(near.select("id", F.when(image, 0.3 * F.col("c") + 0.7 * two).otherwise(0.9 * F.col("c") + 0.1 * two).alias("score")))


@query(S.over(S.MEM, f"bg AS (SELECT id, list_distinct(list_transform(range(1, length(low)), lambda i: low[i : i + 1])) AS b FROM (SELECT id, lower(text) AS low FROM mem WHERE length(text) > 1))", f"qb AS (SELECT list_distinct(list_transform(range(1, length('{QUERY}')), lambda i: '{QUERY}'[i : i + 1])) AS qb)",
    then=f"SELECT id, round(s, 6) AS score FROM (SELECT id, len(list_intersect(b, qb)) / len(list_distinct(list_concat(b, qb)))::DOUBLE AS s FROM bg CROSS JOIN qb) {_ORDER} 10"))
def bigram_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten texts that share most pairs of letters with a query: what ranks memories without a vector (a top-k report)."""
    a = memory.anchors(spark, folder).filter(F.length("text") > 1)
    return _top(a.select("id", T.jaccard(T.bigrams("text"), T.bigrams(F.lit(QUERY))).alias("score")))


@query(S.over(S.MEM, f"""qs AS (SELECT * FROM (VALUES (1, 'memory'), (2, 'sleep'), (3, 'budget')) t(q, word))""", f"hit AS (SELECT q, id, {S.RETENTION} AS s, row_number() OVER (PARTITION BY q ORDER BY round({S.RETENTION}, 9) DESC, id)::INTEGER AS rank FROM mem JOIN qs ON list_contains(tags, word) WHERE state <> 'ghost')",
    then="SELECT q, id, round(s, 6) AS score, rank FROM hit WHERE rank <= 5"))
def recall_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Several queries answered at once: the five best for each (a top-k report)."""
    qs = spark.createDataFrame([(1, "memory"), (2, "sleep"), (3, "budget")], "q int, word string")
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", F.explode("tags").alias("word"), decay.retention(AS_OF).alias("score"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id"))
    return a.join(qs, "word").select("q", "id", "score", rank.alias("rank")).filter("rank <= 5").select("q", "id", r6("score", "score"), "rank")


@query(S.over(S.MEM, then=f"""SELECT task, kind, count(*) AS n FROM (SELECT id, CASE WHEN stability > 0.4 OR schema_ref IS NOT NULL THEN 'semantic' ELSE 'episodic' END AS kind FROM mem) JOIN (SELECT * FROM (VALUES ('coding', ['procedural', 'semantic', 'episodic']), ('debugging', ['episodic', 'semantic']), ('planning', ['semantic', 'procedural']),
    ('reflection', ['episodic', 'semantic']), ('conversation', ['working', 'episodic', 'semantic'])) t(task, kinds)) ON list_contains(kinds, kind) GROUP BY 1, 2"""))
def memory_types_by_task(spark: SparkSession, folder: str) -> DataFrame:
    """How many stable and passing memories each kind of task may look at."""
    kind = F.when((F.col("stability") > 0.4) | F.col("schema_ref").isNotNull(), "semantic").otherwise("episodic")
    tasks = spark.createDataFrame([(t, list(k)) for t, k in recall.TASK_TYPES.items()], "task string, kinds array<string>").select("task", F.explode("kinds").alias("kind"))
    counts = memory.anchors(spark, folder).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.join(tasks, "kind").select("task", "kind", "n")
