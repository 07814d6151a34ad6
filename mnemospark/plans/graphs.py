"""Queries on the graph of memories: traversal, ranking, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import decay, links
from mnemospark.operators import graph
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

_TW = f"weight * {S.case('edge_type', links.TRAVERSAL, 1.0)}"
_GRAPH = (S.LINKS, S.PAIRS, S.BOTH, f"step AS MATERIALIZED (SELECT node, other, {_TW} AS tw FROM both_ways)")
_SEEDS = "seeds AS MATERIALIZED (SELECT node FROM (SELECT node, count(*) AS n FROM both_ways GROUP BY 1 ORDER BY n DESC, node LIMIT 5))"


def _once(spark: SparkSession, folder: str) -> DataFrame:
    """The edges from either end, for queries that read them once."""
    return memory.both_ways(memory.pairs(memory.edges(spark, folder)))


def _both(spark: SparkSession, folder: str) -> DataFrame:
    """The edges from either end, stored once for all hops and rounds of a query."""
    return Scratch(spark, "graph").keep(_once(spark, folder))


@query(S.over(*_GRAPH, then="SELECT node, other, round(tw, 6) AS tw, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY tw DESC, other)::INTEGER AS rank FROM step) WHERE rank <= 3"))
def strongest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three strongest neighbours of every node."""
    return graph.neighbours(_once(spark, folder), 3).select("node", "other", r6("tw", "tw"), "rank")


@query(S.over(*_GRAPH, then="SELECT degree, count(*) AS nodes FROM (SELECT node, count(*) AS degree FROM both_ways GROUP BY 1) GROUP BY 1"))
def degree_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes have how many neighbours."""
    return _once(spark, folder).groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


def _waves(steps: int) -> str:
    out = ["r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS a FROM seeds)", "w0 AS (SELECT * FROM r0)"]
    for k in range(1, steps + 1):
        out.append(f"w{k} AS MATERIALIZED (SELECT other AS node, sum(a * tw * 0.6) AS a FROM w{k - 1} JOIN step USING (node) WHERE tw >= 0.05 AND other NOT IN (SELECT node FROM r{k - 1}) GROUP BY 1)")
        out.append(f"r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM w{k})")
    return ",\n".join(out)


@query(S.over(*_GRAPH, _SEEDS, _waves(3), then="SELECT node, round(a / greatest(1.0, (SELECT max(a) FROM r3)), 6) AS activation FROM r3"))
def spread_activation_3hop(spark: SparkSession, folder: str) -> DataFrame:
    """Activation after three waves from the five greatest hubs."""
    both = _both(spark, folder)
    return graph.spread(both, graph.hubs(both, 5)).select("node", r6("activation", "activation"))


def _levels(depth: int) -> str:
    out = ["l0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS a FROM seeds)"]
    out += [f"l{k} AS MATERIALIZED (SELECT other AS node, sum(a * tw * {0.6**k!r}) AS a FROM l{k - 1} JOIN step USING (node) GROUP BY 1)" for k in range(1, depth + 1)]
    return ",\n".join(out)


@query(S.over(*_GRAPH, _SEEDS, _levels(3), then="""SELECT node, round(a, 6) AS activation FROM (SELECT node, sum(a) AS a FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1)
    ORDER BY round(a, 9) DESC, node LIMIT 48"""))
def spreading_accumulated(spark: SparkSession, folder: str) -> DataFrame:
    """The 48 nodes most activated when activation also flows back (a top-k report)."""
    both = _both(spark, folder)
    return graph.spread_accumulated(both, graph.hubs(both, 5)).select("node", r6("activation", "activation"))


def _paths(hops: int) -> str:
    out = ["s0 AS MATERIALIZED (SELECT node, 0 AS depth, 1.0::DOUBLE AS score FROM seeds)", "f0 AS (SELECT * FROM s0)"]
    for k in range(1, hops + 1):
        out.append(f"f{k} AS MATERIALIZED (SELECT * FROM (SELECT other AS node, {k} AS depth, max(score * tw * {0.6**k!r}) AS score FROM f{k - 1} JOIN step USING (node) GROUP BY 1) WHERE score >= 0.02 AND node NOT IN (SELECT node FROM s{k - 1}))")
        out.append(f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM f{k})")
    return ",\n".join(out)


@query(S.over(*_GRAPH, _SEEDS, _paths(3), then="SELECT node, depth, round(score, 6) AS score FROM s3"))
def multi_hop_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes within three hops of the hubs with depth and best score."""
    both = _both(spark, folder)
    return graph.best_paths(both, graph.hubs(both, 5)).select("node", "depth", r6("score", "score"))


_TOPO = """ty AS (SELECT node, edge_type, count(*) AS n FROM both_ways GROUP BY 1, 2),
tn AS (SELECT *, n / sum(n) OVER (PARTITION BY node) AS p FROM ty),
tp AS MATERIALIZED (SELECT node, sum(n)::BIGINT AS degree, -sum(p * ln(p)) AS entropy, sum(CASE WHEN edge_type IN {causal} THEN n ELSE 0 END) AS causal_n, sum(n * {trav}) AS rich FROM tn GROUP BY 1),
tb AS MATERIALIZED ({bridge}),
topo AS MATERIALIZED (SELECT *, 0.20 * degree / (SELECT max(degree) FROM tp) + 0.15 * e + 0.25 * r + 0.15 * b + 0.25 * c AS t FROM (SELECT node, degree, least(1.0, entropy / ln(8.0)) AS e, least(1.0, rich / degree / 1.5) AS r,
    least(1.0, causal_n / degree * 2.0) AS c, CASE WHEN degree < 2 OR coalesce(labels, 0) <= 1 THEN 0.0 ELSE least(1.0, labels / degree) END AS b FROM tp LEFT JOIN tb USING (node)))"""


def _topo(bridge: str) -> str:
    return _TOPO.format(causal=graph.CAUSAL, trav=S.case("edge_type", links.TRAVERSAL, 1.0), bridge=bridge)


@query(S.over(*_GRAPH, _topo("SELECT NULL::VARCHAR AS node, 0 AS labels WHERE false"), then="SELECT node, degree, round(e, 6) AS entropy, round(r, 6) AS richness, round(c, 6) AS causal, round(t, 6) AS topology FROM topo"))
def topology_score(spark: SparkSession, folder: str) -> DataFrame:
    """Degree, type entropy, richness and causal share of every node."""
    t = graph.topology(_both(spark, folder))
    return t.select("node", "degree", *[r6(c, c) for c in ("entropy", "richness", "causal", "topology")])


def _lpa(rounds: int) -> str:
    out = ["lab0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM both_ways)"]
    for k in range(1, rounds + 1):
        out.append(f"""v{k} AS MATERIALIZED (SELECT b.node, o.label AS theirs, m.label AS mine, round(sum(b.weight), 9) AS w FROM both_ways b JOIN lab{k - 1} o ON o.node = b.other JOIN lab{k - 1} m ON m.node = b.node GROUP BY 1, 2, 3)""")
        out.append(f"lab{k} AS MATERIALIZED (SELECT node, theirs AS label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, (theirs = mine) DESC, theirs) AS rn FROM v{k}) WHERE rn = 1)")
    return ",\n".join(out)


_LPA = _lpa(4)


@query(S.over(*_GRAPH, _LPA, then="SELECT node, label FROM lab4"))
def lpa_fixed_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Community labels after four synchronous rounds of weighted label propagation."""
    return graph.label_propagation(_both(spark, folder), 4)


@query(S.over(*_GRAPH, _LPA, """deg AS (SELECT node, sum(weight) AS k FROM both_ways GROUP BY 1)""", "mm AS (SELECT sum(weight) AS m FROM pairs)",
    then="""SELECT round(coalesce(sum((weight - a.k * b.k / (2.0 * m)) / (2.0 * m)), 0.0), 6) AS modularity, (SELECT count(DISTINCT label) FROM lab4) AS communities
    FROM pairs JOIN deg a ON a.node = lo JOIN deg b ON b.node = hi JOIN lab4 la ON la.node = lo JOIN lab4 lb ON lb.node = hi CROSS JOIN mm WHERE la.label = lb.label"""))
def modularity(spark: SparkSession, folder: str) -> DataFrame:
    """Modularity and number of the communities."""
    pairs = Scratch(spark, "graph").keep(memory.pairs(memory.edges(spark, folder)))
    q = graph.modularity(pairs, graph.label_propagation(memory.both_ways(pairs), 4))
    return q.select(r6("modularity", "modularity"), "communities")


@query(S.over(*_GRAPH, _LPA, "sz AS (SELECT label, count(*) AS size FROM lab4 GROUP BY 1)", """ins AS (SELECT la.label, count(*) AS inside FROM pairs JOIN lab4 la ON la.node = lo JOIN lab4 lb ON lb.node = hi WHERE la.label = lb.label GROUP BY 1)""",
    then="""SELECT label, size, coalesce(inside, 0) AS inside, round(CASE WHEN size > 1 THEN coalesce(inside, 0) / (size * (size - 1) / 2.0) ELSE 0.0 END, 6) AS density,
    CASE WHEN size < 10 THEN '1-9' WHEN size < 25 THEN '10-24' WHEN size < 50 THEN '25-49' WHEN size < 100 THEN '50-99' WHEN size < 200 THEN '100-199' ELSE '200+' END AS bucket FROM sz LEFT JOIN ins USING (label)"""))
def community_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Size, inner edges, density and size bucket of every community."""
    pairs = Scratch(spark, "graph").keep(memory.pairs(memory.edges(spark, folder)))
    labels = graph.label_propagation(memory.both_ways(pairs), 4)
    inside = pairs.join(labels.toDF("lo", "label"), "lo").join(labels.toDF("hi", "lb"), "hi").filter("label = lb").groupBy("label").agg(F.count("*").alias("inside"))
    s = F.col("size")
    bucket = F.when(s < 10, "1-9").when(s < 25, "10-24").when(s < 50, "25-49").when(s < 100, "50-99").when(s < 200, "100-199").otherwise("200+")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).join(inside, "label", "left").na.fill(0, ["inside"])
    return sizes.select("label", "size", "inside", r6(F.when(s > 1, F.col("inside") / (s * (s - 1) / 2.0)).otherwise(0.0), "density"), bucket.alias("bucket"))


@query(S.over(*_GRAPH, _LPA, then="""SELECT b.node, count(DISTINCT o.label) AS communities FROM both_ways b JOIN lab4 o ON o.node = b.other JOIN lab4 m ON m.node = b.node WHERE o.label <> m.label GROUP BY 1"""))
def bridge_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with neighbours in other communities, and in how many."""
    both = _both(spark, folder)
    labels = graph.label_propagation(both, 4)
    far = both.join(labels, "node").join(labels.toDF("other", "theirs"), "other").filter("label <> theirs")
    return far.groupBy("node").agg(F.countDistinct("theirs").alias("communities"))


@query(S.over(*_GRAPH, _LPA, """x AS (SELECT m.label, o.label AS other, round(sum(b.weight), 9) AS w FROM both_ways b JOIN lab4 o ON o.node = b.other JOIN lab4 m ON m.node = b.node WHERE o.label <> m.label GROUP BY 1, 2)""",
    then="SELECT label, other, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, other) AS rn FROM x) WHERE rn <= 3"))
def neighbouring_communities(spark: SparkSession, folder: str) -> DataFrame:
    """The three communities each community is most connected with."""
    from pyspark.sql import Window as W

    both = _both(spark, folder)
    labels = graph.label_propagation(both, 4)
    x = both.join(labels, "node").join(labels.toDF("other", "theirs"), "other").filter("label <> theirs").groupBy("label", F.col("theirs").alias("other")).agg(F.round(F.sum("weight"), 9).alias("w"))
    rn = F.row_number().over(W.partitionBy("label").orderBy(F.desc("w"), "other"))
    return x.withColumn("rn", rn).filter("rn <= 3").select("label", "other", r6("w", "weight"))


def _rounds(n: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM both_ways)"]
    out += [f"c{k} AS MATERIALIZED (SELECT c.node, least(any_value(c.label), min(o.label)) AS label FROM c{k - 1} c JOIN both_ways b ON b.node = c.node JOIN c{k - 1} o ON o.node = b.other GROUP BY 1)" for k in range(1, n + 1)]
    return ",\n".join(out)


@query(S.over(*_GRAPH, _rounds(16), then="SELECT node, label AS component FROM c16"))
def connected_components(spark: SparkSession, folder: str) -> DataFrame:
    """The connected component of every node of the graph."""
    return graph.components(memory.pairs(memory.edges(spark, folder)))


@query(S.over(S.MEM, *_GRAPH, _rounds(16), then="""SELECT label AS component, count(*) AS size, round(avg(importance), 6) AS importance, round(avg(stability), 6) AS stability, round(avg(recency), 6) AS recency,
    round(avg(natural_frequency), 6) AS frequency FROM c16 JOIN mem ON id = node GROUP BY 1"""))
def constellation_means(spark: SparkSession, folder: str) -> DataFrame:
    """Size and mean state of every constellation (connected component) of known anchors."""
    c = graph.components(memory.pairs(memory.edges(spark, folder))).withColumnRenamed("node", "id")
    a = memory.anchors(spark, folder).select("id", "importance", "stability", "recency", "natural_frequency").join(c, "id")
    return a.groupBy("component").agg(F.count("*").alias("size"), *[r6(F.avg(x), x) for x in ("importance", "stability", "recency")], r6(F.avg("natural_frequency"), "frequency"))


@query(S.over(*_GRAPH, """st AS (SELECT * FROM pairs WHERE weight > 0.6)""", "sd AS (SELECT via, e, weight FROM (SELECT *, row_number() OVER (PARTITION BY via ORDER BY weight DESC, e) AS rn FROM (SELECT lo AS via, hi AS e, weight FROM st UNION ALL SELECT hi, lo, weight FROM st)) WHERE rn <= 32)",
    then="""SELECT lo, hi, round(max(w), 6) AS weight FROM (SELECT a.e AS lo, b.e AS hi, a.weight * b.weight * 0.7 AS w FROM sd a JOIN sd b ON a.via = b.via AND a.e < b.e) t
    WHERE w > 0.15 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.lo = t.lo AND p.hi = t.hi) GROUP BY 1, 2"""))
def transitive_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that two strong edges connect and no edge does."""
    return graph.transitive(memory.pairs(memory.edges(spark, folder))).select("lo", "hi", r6("weight", "weight"))


@query(S.over(*_GRAPH, "st AS (SELECT * FROM pairs WHERE weight >= 0.6)", "sd AS (SELECT lo AS via, hi AS e, weight FROM st UNION ALL SELECT hi, lo, weight FROM st)",
    then="""SELECT lo, hi, round(max(w), 6) AS weight FROM (SELECT a.e AS lo, b.e AS hi, a.weight * b.weight * 0.7 AS w FROM sd a JOIN sd b ON a.via = b.via AND a.e < b.e) t
    WHERE w > 0.15 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.lo = t.lo AND p.hi = t.hi) GROUP BY 1, 2"""))
def transitive_closure_all(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that two strong edges connect and no edge does, through hubs of any degree."""
    pairs = Scratch(spark, "graph").keep(memory.pairs(memory.edges(spark, folder)).select("lo", "hi", "weight"))
    return graph.transitive_all(pairs).select("lo", "hi", r6("weight", "weight"))


def _ppr(rounds: int) -> str:
    out = ["wk AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT node FROM seeds UNION ALL SELECT other FROM step JOIN seeds USING (node)))",
           "tot AS (SELECT node, sum(tw) AS total FROM step GROUP BY 1)",
           "fl AS MATERIALIZED (SELECT s.node, s.other, tw / total AS share FROM step s JOIN wk USING (node) JOIN tot USING (node) WHERE s.other IN (SELECT node FROM wk))",
           "p0 AS MATERIALIZED (SELECT node, CASE WHEN node IN (SELECT node FROM seeds) THEN 1.0 / (SELECT count(*) FROM seeds) ELSE 0.0 END AS rank FROM wk)"]
    out += [f"p{k} AS MATERIALIZED (SELECT p0.node, p0.rank * 0.15 + coalesce(s, 0.0) AS rank FROM p0 LEFT JOIN (SELECT other AS node, sum(rank * share * 0.85) AS s FROM p{k - 1} JOIN fl USING (node) GROUP BY 1) USING (node))" for k in range(1, rounds + 1)]
    return ",\n".join(out)


@query(S.over(*_GRAPH, _SEEDS, _ppr(10), then="SELECT node, round(rank, 6) AS rank FROM p10"))
def ppr_10rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Personalised rank around the five greatest hubs after ten rounds."""
    both = _both(spark, folder)
    return graph.pagerank(both, graph.hubs(both, 5), 10).select("node", r6("rank", "rank"))


@query()
def ppr_converged(spark: SparkSession, folder: str) -> DataFrame:
    """Personalised rank around the five greatest hubs, once it changes by less than 0.00001 in all, after thirty rounds at most."""
    both = _both(spark, folder)
    return graph.pagerank(both, graph.hubs(both, 5), 30, tolerance=1e-5).select("node", r6("rank", "rank"))


def _chains(depth: int) -> str:
    out = [f"cs AS MATERIALIZED (SELECT src, dst, max(weight) AS w FROM links WHERE edge_type IN {graph.CAUSAL} GROUP BY 1, 2)", "h0 AS (SELECT node AS s, node AS e, [node] AS path, 1.0::DOUBLE AS c FROM seeds)"]
    out += [f"h{k} AS MATERIALIZED (SELECT s, dst AS e, list_append(path, dst) AS path, c * w AS c FROM h{k - 1} JOIN cs ON src = e WHERE NOT list_contains(path, dst) AND c * w >= 0.2)" for k in range(1, depth + 1)]
    return ",\n".join(out)


@query(S.over(*_GRAPH, _SEEDS, _chains(3), then=" UNION ALL ".join(f"SELECT s AS start, e AS \"end\", {k} AS depth, array_to_string(path, '>') AS path, round(c * (1.0 + 0.2 * {k}), 6) AS score FROM h{k}" for k in (1, 2, 3))))
def causal_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Causal paths of up to three steps from the hubs, ranked by confidence and depth."""
    both = _both(spark, folder)
    paths = graph.causal_chains(memory.edges(spark, folder), graph.hubs(both, 5))
    return paths.select("start", "end", "depth", "path", r6(graph.rank_score(F.col("confidence"), F.col("depth")), "score"))


@query(S.over(S.MEM, *_GRAPH, _topo("SELECT NULL::VARCHAR AS node, 0 AS labels WHERE false"), then=f"""SELECT id, round(score, 6) AS score FROM (SELECT id, 0.6 * (coalesce(t, 0.0) * 0.7 + exp(-{S.hours('last_at')} / 168.0) * 0.3) AS score FROM mem LEFT JOIN topo ON node = id WHERE state <> 'ghost')
    ORDER BY round(score, 9) DESC, id LIMIT 20"""))
def topology_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 memories of the best topology and recency (a top-k report)."""
    t = graph.topology(_both(spark, folder)).select(F.col("node").alias("id"), "topology")
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).join(t, "id", "left")
    score = 0.6 * (F.coalesce("topology", F.lit(0.0)) * 0.7 + F.exp(-decay.hours("last_at", AS_OF) / 168.0) * 0.3)
    return a.select("id", score.alias("s")).orderBy(F.desc(F.round("s", 9)), "id").limit(20).select("id", r6("s", "score"))


@query(S.over(S.LINKS, S.PAIRS, S.BOTH, S.MEM, then="""SELECT state, edge_type, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM both_ways JOIN mem ON id = node GROUP BY ROLLUP (state, edge_type)"""))
def edges_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and mean weight by the node's state and edge type, with subtotals."""
    both = _once(spark, folder).withColumnRenamed("node", "id")
    j = both.join(memory.anchors(spark, folder).select("id", "state"), "id")
    return j.rollup("state", "edge_type").agg(F.count("*").alias("n"), r6(F.avg("weight"), "mean_weight"))
