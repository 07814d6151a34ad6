"""Queries that rebuild the store: merging with its edges, fusion, patterns, rewiring, communities, writing, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import text as T
from mnemospark.functions import upkeep as U
from mnemospark.functions import vectors as V
from mnemospark.operators import graph, rebuild, similarity
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.graphs import _GRAPH, _both, _lpa
from mnemospark.plans.recall import _VEC
from mnemospark.plans.texts import write_gate_decisions
from mnemospark.plans.timeline import _DOMAIN, domain
from mnemospark.plans.vectors import _cos
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

#: Cosine above which vectors are the same memory, or a case for the write gate.
ALIKE, DUPLICATE, SIMILAR = 0.85, 0.92, 0.75
#: Memories made after it count as incoming.
CUT = AS_OF - 60 * 86400

_PAIR = f"vp AS MATERIALIZED (SELECT * FROM (SELECT x.id AS a, y.id AS b, {_cos('x.e', 'y.e')} AS cosine FROM vec x JOIN vec y ON x.id < y.id) WHERE cosine > {SIMILAR})"


def _roots_sql(name: str, edges: str) -> str:
    """CTEs of the least id reachable over pairs (a, b)."""
    return f"""{name}_s AS MATERIALIZED (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}),
{name}_r AS (SELECT DISTINCT x, x AS label FROM {name}_s UNION SELECT s.y, r.label FROM {name}_r r JOIN {name}_s s ON s.x = r.x WHERE r.label < s.y),
{name} AS MATERIALIZED (SELECT x AS id, min(label) AS grp FROM {name}_r GROUP BY 1)"""


_MERGE = f"""mp AS MATERIALIZED (SELECT a, b FROM vp JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE cosine > {ALIKE} AND list_has_any(x.tags, y.tags)),
{_roots_sql('mg', 'mp')},
mc AS MATERIALIZED (SELECT mg.id, first_value(mg.id) OVER (PARTITION BY grp ORDER BY created_at, mg.id) AS core FROM mg JOIN mem USING (id))"""


def _over(*parts: str, then: str) -> str:
    """A statement with recursive common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + then


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return Scratch(spark, "vectors").keep(memory.vectors(spark, folder))


def _cores(spark: SparkSession, folder: str) -> DataFrame:
    """(id, core): the anchors that a merge concerns and the oldest of their group; vectors alike and a tag in common."""
    pairs = similarity.similar_pairs(_vectors(spark, folder), ALIKE)
    return Scratch(spark, "cores").keep(rebuild.cores(pairs, memory.anchors(spark, folder), shared_tag=True))


@query(_over(S.MEM, _VEC.split(",\nvm AS")[0], _PAIR, _MERGE, then="""SELECT core AS id, count(*) AS size, round(max(importance), 6) AS importance, round(avg(frequency), 6) AS frequency, round(least(1.0, max(CASE WHEN mc.id = core THEN stability END) + 0.15 * (count(*) - 1)), 6) AS stability,
    len(list_distinct(flatten(list(tags)))) AS tags FROM mc JOIN mem USING (id) GROUP BY 1"""))
def merged_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates with a tag in common, merged into the oldest: greatest importance, mean frequency, more stability, all tags."""
    j = _cores(spark, folder).join(memory.anchors(spark, folder).select("id", "importance", "frequency", "stability", "tags"), "id")
    own = F.max(F.when(F.col("id") == F.col("core"), F.col("stability")))
    g = j.groupBy(F.col("core").alias("key")).agg(
        F.count("*").alias("size"), F.max("importance").alias("i"), F.avg("frequency").alias("f"), F.least(F.lit(1.0), own + 0.15 * (F.count("*") - 1)).alias("s"),
        F.size(F.array_distinct(F.flatten(F.collect_set("tags")))).cast("bigint").alias("tags"),
    )
    return g.select(F.col("key").alias("id"), "size", r6("i", "importance"), r6("f", "frequency"), r6("s", "stability"), "tags")


@query(_over(S.MEM, _VEC.split(",\nvm AS")[0], _PAIR, _MERGE, S.LINKS, S.PAIRS, "rw AS (SELECT coalesce(x.core, lo) AS s, coalesce(y.core, hi) AS t, weight FROM pairs LEFT JOIN mc x ON x.id = lo LEFT JOIN mc y ON y.id = hi)",
    then="SELECT least(s, t) AS lo, greatest(s, t) AS hi, count(*) AS n, round(max(weight), 6) AS weight FROM rw WHERE s <> t GROUP BY 1, 2"))
def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    """All edges after the merge: the ends moved to the cores, links within a group gone, of several the heaviest."""
    return rebuild.rewired(memory.pairs(memory.edges(spark, folder)), _cores(spark, folder)).select("lo", "hi", "n", r6("weight", "weight"))


@query(_over(S.MEM, _VEC.split(",\nvm AS")[0], _PAIR, *_GRAPH, _lpa(4), f"fp AS MATERIALIZED (SELECT a, b FROM vp JOIN lab4 x ON x.node = a JOIN lab4 y ON y.node = b WHERE cosine > {ALIKE} AND x.label = y.label)", _roots_sql("fg", "fp"),
    "fz AS (SELECT grp, count(*) AS size, arg_min(fg.id, (created_at, fg.id)) AS core, max(importance) AS i, avg(emotional_valence) AS v, arg_min(stability, (created_at, fg.id)) AS s FROM fg JOIN mem USING (id) GROUP BY 1)",
    then="SELECT core, size, round(i, 6) AS importance, round(v, 6) AS valence, round(least(1.0, s + 0.05 * (size - 1) + 0.1), 6) AS stability FROM fz WHERE size >= 2"))
def fused_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of alike memories within a community, fused into the oldest."""
    labels = Scratch(spark, "fuse").keep(graph.label_propagation(_both(spark, folder), 4))
    pairs = similarity.similar_pairs(_vectors(spark, folder), ALIKE)
    within = pairs.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la = lb")
    a = memory.anchors(spark, folder)
    j = Scratch(spark, "fuse").keep(rebuild.cores(within, a)).join(a.select("id", "importance", "emotional_valence", "stability"), "id")
    own = F.max(F.when(F.col("id") == F.col("core"), F.col("stability")))
    g = j.groupBy("core").agg(F.count("*").alias("size"), F.max("importance").alias("i"), F.avg("emotional_valence").alias("v"), own.alias("s"))
    return g.filter("size >= 2").select("core", "size", r6("i", "importance"), r6("v", "valence"), r6(F.least(F.lit(1.0), F.col("s") + 0.05 * (F.col("size") - 1) + 0.1), "stability"))


_PATTERN = """mb AS MATERIALIZED (SELECT DISTINCT grp, id, importance, emotional_valence, recency, stability, tags FROM (SELECT 'tag:' || unnest(list_filter(tags, lambda t: t NOT IN ('dormant', 'consolidating', 'ghost', 'sleep_rebuilt'))) AS grp, * FROM mem WHERE state IN ('dormant', 'consolidating')
    UNION ALL SELECT 'schema:' || schema_ref, * FROM mem WHERE schema_ref IS NOT NULL)),
big AS MATERIALIZED (SELECT grp FROM mb JOIN vec USING (id) GROUP BY 1 HAVING count(*) >= 4)"""


def _members(spark: SparkSession, folder: str) -> DataFrame:
    """(grp, id, ...): members with a vector of the groups of four or more that share a tag while at rest, or a schema."""
    a = memory.anchors(spark, folder).select("id", "importance", "emotional_valence", "recency", "stability", "tags", "state", "schema_ref")
    named = F.filter("tags", lambda t: ~t.isin("dormant", "consolidating", "ghost", "sleep_rebuilt"))
    by_tag = F.when(F.col("state").isin("dormant", "consolidating"), F.transform(named, lambda t: F.concat(F.lit("tag:"), t))).otherwise(F.array().cast("array<string>"))
    by_schema = F.when(F.col("schema_ref").isNotNull(), F.array(F.concat(F.lit("schema:"), "schema_ref"))).otherwise(F.array().cast("array<string>"))
    rows = a.join(_vectors(spark, folder).select("id"), "id", "left_semi").withColumn("grp", F.explode(F.concat(by_tag, by_schema)))
    rows = Scratch(spark, "members").keep(rows)
    return rows.join(rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n >= 4").select("grp"), "grp", "left_semi")


@query(S.over(S.MEM, _VEC.split(",\nvm AS")[0], _PATTERN, "tc AS (SELECT grp, tag, count(*) AS n FROM (SELECT grp, unnest(tags) AS tag FROM mb JOIN big USING (grp) WHERE id IN (SELECT id FROM vec)) GROUP BY 1, 2)",
    "tt AS (SELECT grp, string_agg(tag, ' + ' ORDER BY n DESC, tag) AS label FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, tag) AS rn FROM tc) WHERE rn <= 3 GROUP BY 1)",
    then="SELECT grp, any_value(label) AS label, count(*) AS size, round(avg(importance), 6) AS importance, round(avg(emotional_valence), 6) AS valence, round(max(recency), 6) AS recency FROM mb JOIN big USING (grp) JOIN vec USING (id) LEFT JOIN tt USING (grp) GROUP BY 1"))
def pattern_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The pattern anchor of every group of resting or schema-bound memories: its label of three tags, size and means."""
    rows = _members(spark, folder)
    counts = rows.select("grp", F.explode("tags").alias("tag")).groupBy("grp", "tag").agg(F.count("*").alias("n"))
    top = counts.withColumn("rn", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "tag"))).filter("rn <= 3")
    labels = top.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]), " + ").alias("label"))
    g = rows.groupBy("grp").agg(F.count("*").alias("size"), F.avg("importance").alias("i"), F.avg("emotional_valence").alias("v"), F.max("recency").alias("r"))
    return g.join(labels, "grp", "left").select("grp", "label", "size", r6("i", "importance"), r6("v", "valence"), r6("r", "recency"))


@query(S.over(S.MEM, _VEC.split(",\nvm AS")[0], _PATTERN, then="SELECT id, count(*) AS patterns, round(any_value(stability) * pow(0.6, count(*)), 6) AS stability, round(any_value(importance) * pow(0.6, count(*)), 6) AS importance FROM mb JOIN big USING (grp) JOIN vec USING (id) GROUP BY 1"))
def pattern_members(spark: SparkSession, folder: str) -> DataFrame:
    """What the members of patterns keep of their stability and importance: 0.6 for each pattern."""
    g = _members(spark, folder).groupBy("id").agg(F.count("*").alias("patterns"), F.first("stability").alias("s"), F.first("importance").alias("i"))
    left = F.pow(F.lit(0.6), "patterns")
    return g.select("id", "patterns", r6(F.col("s") * left, "stability"), r6(F.col("i") * left, "importance"))


_TRIALS = "tr AS (SELECT lo, hi, weight, co_count, co_count AS ok, n_edges - 1 AS bad FROM pairs)"


@query(S.over(S.LINKS, S.PAIRS, _TRIALS, then="""SELECT lo, hi, CASE WHEN ok + bad >= 3 AND ok / (ok + bad) >= 0.7 AND ok >= 2 THEN 'boost' WHEN ok + bad >= 5 AND ok / (ok + bad) < 0.3 THEN 'weaken' ELSE 'keep' END AS action,
    round(CASE WHEN ok + bad >= 3 AND ok / (ok + bad) >= 0.7 AND ok >= 2 THEN least(1.0, weight + least(0.1, ok * 0.015)) WHEN ok + bad >= 5 AND ok / (ok + bad) < 0.3 THEN greatest(0.0, weight - least(0.1, bad * 0.01)) ELSE weight END, 6) AS weight,
    greatest(0, ok - 1) AS successes, co_count >= 5 AS cluster FROM tr"""))
def dynamic_rewire(spark: SparkSession, folder: str) -> DataFrame:
    """Edges after their successes and failures (joint activations, and repeats of the edge): boosted, weakened, clustered."""
    p = memory.pairs(memory.edges(spark, folder)).withColumns({"ok": F.col("co_count"), "bad": F.col("n_edges") - 1})
    return rebuild.reinforced(p).select("lo", "hi", "action", r6("weight", "weight"), "successes", "cluster")


@query(S.over(S.MEM, _VEC.split(",\nvm AS")[0], f"""sg AS (SELECT domain, list(m ORDER BY i) AS centroid FROM (SELECT domain, i, avg(x) AS m FROM (SELECT {_DOMAIN} AS domain, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM mem JOIN vec USING (id) WHERE hippocampal_dependency <= 0.3) GROUP BY 1, 2) GROUP BY 1)""",
    then=f"SELECT x.domain AS a, y.domain AS b, round({_cos('x.centroid', 'y.centroid')}, 6) AS weight FROM sg x JOIN sg y ON x.domain < y.domain WHERE {_cos('x.centroid', 'y.centroid')} > 0.05"))
def hub_connections(spark: SparkSession, folder: str) -> DataFrame:
    """Links between the hubs of domains whose settled memories have alike centres (a few domains)."""
    rows = memory.anchors(spark, folder).filter("hippocampal_dependency <= 0.3").join(_vectors(spark, folder), "id").withColumn("domain", domain())
    c = Scratch(spark, "hubs").keep(similarity.centroids(rows, "domain"))
    x, y = c.select(F.col("domain").alias("a"), F.col("centroid").alias("ca")), c.select(F.col("domain").alias("b"), F.col("centroid").alias("cb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", V.cosine(F.col("ca"), F.col("cb")).alias("w")).filter("w > 0.05").select("a", "b", r6("w", "weight"))


_SPLIT = """sz AS (SELECT label, count(*) AS n FROM lab4 GROUP BY 1), inb AS MATERIALIZED (SELECT b.node, b.other, b.weight FROM both_ways b JOIN lab4 x ON x.node = b.node JOIN lab4 y ON y.node = b.other JOIN sz ON sz.label = x.label WHERE x.label = y.label AND n > 200),
u0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM inb),
""" + ",\n".join(f"""uv{k} AS MATERIALIZED (SELECT b.node, o.label AS theirs, m.label AS mine, round(sum(b.weight), 9) AS w FROM inb b JOIN u{k - 1} o ON o.node = b.other JOIN u{k - 1} m ON m.node = b.node GROUP BY 1, 2, 3),
u{k} AS MATERIALIZED (SELECT node, theirs AS label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, (theirs = mine) DESC, theirs) AS rn FROM uv{k}) WHERE rn = 1)""" for k in (1, 2, 3)) + """,
sub AS (SELECT u3.node, x.label AS old, u3.label AS sub, count(*) OVER (PARTITION BY x.label, u3.label) AS n FROM u3 JOIN lab4 x USING (node)),
big1 AS (SELECT old, first(sub ORDER BY n DESC, sub) AS keep FROM sub GROUP BY 1),
cut AS MATERIALIZED (SELECT l.node, CASE WHEN s.sub IS NOT NULL AND s.sub <> keep AND s.n >= 3 THEN l.label || '/' || s.sub ELSE l.label END AS label FROM lab4 l LEFT JOIN sub s USING (node) LEFT JOIN big1 ON big1.old = l.label),
cz AS MATERIALIZED (SELECT label, count(*) AS n FROM cut GROUP BY 1),
mv AS (SELECT b.node, y.label, round(sum(weight), 9) AS w FROM both_ways b JOIN cut x ON x.node = b.node JOIN cz ON cz.label = x.label JOIN cut y ON y.node = b.other WHERE cz.n < 3 AND y.label <> x.label GROUP BY 1, 2),
best AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, label) AS rn FROM mv) WHERE rn = 1),
largest AS (SELECT label FROM cz ORDER BY n DESC, label LIMIT 1)"""


@query(S.over(*_GRAPH, _lpa(4), _SPLIT, then="SELECT node, CASE WHEN cz.n >= 3 THEN cut.label ELSE coalesce(best.label, (SELECT label FROM largest)) END AS label FROM cut JOIN cz USING (label) LEFT JOIN best USING (node)"))
def communities_resized(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of more than 200 split by propagation within them; members of those under three moved to the heaviest neighbour's, isolated ones to the largest."""
    both = _both(spark, folder)
    labels = Scratch(spark, "resize").keep(graph.label_propagation(both, 4))
    return rebuild.filtered_small(both, rebuild.split_oversized(both, labels, 200, 3), 3)


@query(S.over(S.MEM, _VEC.split(",\nvm AS")[0], _PAIR, f"""inc AS (SELECT id FROM mem WHERE created_at > {CUT!r}), mt AS (SELECT id, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, other) AS rn FROM (SELECT a AS id, b AS other, cosine FROM vp UNION ALL SELECT b, a, cosine FROM vp) s
    JOIN mem x USING (id) JOIN mem y ON y.id = other WHERE id IN (SELECT id FROM inc) AND (y.created_at, y.id) < (x.created_at, x.id)) WHERE rn = 1)""",
    then=f"SELECT id, CASE WHEN cosine >= {DUPLICATE} THEN 'reject:duplicate' WHEN cosine >= {SIMILAR} THEN 'merge:similar_exists' ELSE 'accept:passed' END AS decision, other AS target, round(cosine, 6) AS similarity FROM inc LEFT JOIN mt USING (id)"))
def write_gate_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """What the write gate says about recent memories by the most similar older one: duplicates are rejected, similar ones merged."""
    a = memory.anchors(spark, folder).select("id", "created_at")
    pairs = similarity.similar_pairs(_vectors(spark, folder), SIMILAR)
    return rebuild.similarity_gate(a.filter(F.col("created_at") > CUT), a, pairs, DUPLICATE, SIMILAR).select("id", "decision", "target", r6("cosine", "similarity"))


_DEB = "dbx AS (SELECT id, created_at, lag(created_at) OVER (PARTITION BY lower(trim(text)) ORDER BY created_at, id) AS before FROM mem WHERE trim(text) <> '')"


@query(S.over(S.MEM, _DEB, then="SELECT id, CASE WHEN created_at - before < 864000 THEN 'reject:debounce_duplicate' ELSE 'accept:passed' END AS decision FROM dbx WHERE before IS NOT NULL"))
def write_gate_debounce(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that came before: rejected if that was within the window of ten days (the store's pace), else accepted."""
    a = memory.anchors(spark, folder).filter(F.trim("text") != "").select("id", "created_at", F.xxhash64(F.lower(F.trim("text"))).alias("h"))
    before = F.lag("created_at").over(W.partitionBy("h").orderBy("created_at", "id"))
    return a.withColumn("before", before).filter("before is not null").select("id", F.when(F.col("created_at") - F.col("before") < 864000, "reject:debounce_duplicate").otherwise("accept:passed").alias("decision"))


@query()
def write_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The whole write gate over recent memories: what their text says, then similarity, then debounce."""
    text = write_gate_decisions(spark, folder).select("id", F.col("decision").alias("t"))
    alike = write_gate_similarity(spark, folder).select("id", F.col("decision").alias("s"), "target")
    again = write_gate_debounce(spark, folder).select("id", F.col("decision").alias("d"))
    rows = alike.join(text, "id").join(again, "id", "left")
    decision = F.when(~F.col("t").startswith("accept"), F.col("t")).when(~F.col("s").startswith("accept"), F.col("s")).when(F.col("d").startswith("reject"), F.col("d")).otherwise("accept:passed")
    return rows.select("id", decision.alias("decision"), "target")


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x) for x in (k, *v)) + ")" for k, v in sorted(U.EDGE_PRESETS.items())) + ") t(preset, weight, relation, confidence, source_type, edge_type)")
def edge_presets(spark: SparkSession, folder: str) -> DataFrame:
    """What edges are made with, by the way they came about."""
    return U.presets(spark)


@query(S.over(S.LINKS, S.PAIRS, then="SELECT lo AS source, hi AS target, 0.7::DOUBLE AS weight, 'causes' AS relation, 0.8::DOUBLE AS confidence, 'inferred' AS source_type, 'causal' AS edge_type FROM pairs WHERE edge_type IN ('causes', 'caused_by')"))
def causal_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Causal edges made anew for the pairs that have one."""
    p = memory.pairs(memory.edges(spark, folder)).filter(F.col("edge_type").isin("causes", "caused_by"))
    return U.made_edges(p.select(F.col("lo").alias("source"), F.col("hi").alias("target")), "causal")


_COLD = f"CASE WHEN state = 'ghost' THEN 'cold' WHEN {S.hours('last_at')} > 720 THEN 'cold' ELSE {S.THERMAL} END"


@query(S.over(S.MEM, f"th AS (SELECT *, {_COLD} AS heat FROM mem)", then=f"""SELECT id, CASE WHEN heat = 'cold' AND state = 'ghost' THEN 'reactivated' ELSE state END AS state, round(CASE WHEN heat = 'cold' AND state <> 'ghost' THEN 1.0 ELSE recency END, 6) AS recency,
    round(CASE WHEN heat = 'cold' AND state <> 'ghost' THEN greatest(frequency, 0.05) ELSE frequency END, 6) AS frequency, round(CASE WHEN heat = 'cold' AND state <> 'ghost' THEN {S.AS_OF} ELSE last_at END, 6) AS last_at FROM th"""))
def thawed_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """All memories after a thaw: ghosts revive, those idle for a month are raised."""
    a = memory.anchors(spark, folder)
    heat = F.when(F.col("state") == "ghost", "cold").when(decay.hours("last_at", AS_OF) > 720, "cold").otherwise(decay.thermal())
    t = U.thawed({c: F.col(c) for c in ("state", "recency", "frequency", "last_at")}, heat, AS_OF)
    return a.select("id", t["state"].alias("state"), *[r6(t[c], c) for c in ("recency", "frequency", "last_at")])


@query(S.over(S.MEM, f"""top AS (SELECT id, row_number() OVER (ORDER BY round({S.RETENTION}, 9) DESC, id) AS rn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM mem WHERE state <> 'ghost' ORDER BY rn LIMIT 60)""",
    "fold AS (SELECT rn, id, CASE WHEN n <= 320 THEN 0 ELSE 1 END AS level, CASE WHEN n <= 320 THEN n ELSE 30 END AS used FROM top WHERE rn = 1 UNION ALL SELECT t.rn, t.id, CASE WHEN used + n <= 320 THEN 0 WHEN used + 30 <= 360 THEN 1 ELSE 2 END, used + CASE WHEN used + n <= 320 THEN n WHEN used + 30 <= 360 THEN 30 ELSE 10 END FROM fold f JOIN top t ON t.rn = f.rn + 1)",
    then="SELECT id, rn::INTEGER AS rank, level FROM fold").replace("WITH mem", "WITH RECURSIVE mem", 1))
def adaptive_compress(spark: SparkSession, folder: str) -> DataFrame:
    """The level of detail of the sixty best memories within a budget of 400 words (a fold over a top-k report)."""
    from mnemospark.operators import search

    a = memory.anchors(spark, folder).filter(decay.is_retrievable())
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    top = search.ranked(a.select("id", words.alias("n"), decay.retention(AS_OF).alias("score")), 60)
    rows = top.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "n"))).alias("items"))
    levels = U.compressed(F.transform("items", lambda x: x["n"]), 400)
    return rows.select(F.explode(F.arrays_zip(F.col("items"), levels.alias("levels"))).alias("z")).select("z.items.id", "z.items.rank", F.col("z.levels").alias("level"))


def _sum_contains(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


@query(_over(S.MEM, "tx AS (SELECT id, created_at, importance, lower(text) AS low FROM mem WHERE state <> 'ghost')", "sg AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{t}' AS trait, id, created_at, 0.02 * importance * ({_sum_contains(p)} - {_sum_contains(n)}) AS d FROM tx WHERE {_sum_contains(p)} + {_sum_contains(n)} > 0" for t, (p, n) in T.TRAITS.items()) + ")",
    "od AS MATERIALIZED (SELECT trait, d, row_number() OVER (PARTITION BY trait ORDER BY created_at, id) AS k FROM sg)", "fd AS (SELECT trait, 0::BIGINT AS k, 0.5::DOUBLE AS v FROM (SELECT DISTINCT trait FROM od) UNION ALL SELECT f.trait, o.k, least(1.0, greatest(0.0, v + d)) FROM fd f JOIN od o ON o.trait = f.trait AND o.k = f.k + 1)",
    then="SELECT trait, k AS n, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY trait ORDER BY k DESC) AS rn FROM fd) WHERE rn = 1"))
def personality_traits(spark: SparkSession, folder: str) -> DataFrame:
    """Traits of the user after all memories in their order: each step is kept within 0 and 1, so ranges are folded and their folds composed."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", "created_at", "importance", F.lower("text").alias("low"))
    parts = None
    for t, (p, n) in T.TRAITS.items():
        up, down = T.count_contained(F.col("low"), p), T.count_contained(F.col("low"), n)
        own = a.filter(up + down > 0).select(F.lit(t).alias("trait"), "created_at", "id", (0.02 * F.col("importance") * (up - down)).alias("d"))
        parts = own if parts is None else parts.unionByName(own)
    return rebuild.clipped_folds(parts, "trait", ["created_at", "id"], "d", 0.5).select("trait", "n", r6("value", "value"))


@query(S.over(S.MEM, "tx AS (SELECT id, importance, lower(text) AS low FROM mem WHERE state <> 'ghost')", then=" UNION ALL ".join(f"SELECT '{v}' AS value, count(*) AS n, round(least(1.0, coalesce(sum(0.05 * importance), 0.0)), 6) AS weight FROM tx WHERE {_sum_contains(ws)} > 0" for v, ws in T.VALUES.items())))
def personality_values(spark: SparkSession, folder: str) -> DataFrame:
    """What the user values: every text that speaks for it adds to its weight, up to 1."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("importance", F.lower("text").alias("low"))
    hit = {v: T.count_contained(F.col("low"), ws) > 0 for v, ws in T.VALUES.items()}
    sums = a.agg(*[F.struct(F.lit(v).alias("value"), F.count_if(h).alias("n"), F.least(F.lit(1.0), F.coalesce(F.sum(F.when(h, 0.05 * F.col("importance"))), F.lit(0.0))).alias("w")).alias(v) for v, h in hit.items()])
    return sums.select(F.explode(F.array(*hit)).alias("x")).select("x.value", "x.n", r6("x.w", "weight"))


@query(S.over(S.MEM, "tx AS (SELECT id, session, created_at, lower(text) AS low FROM mem WHERE state <> 'ghost' AND session <> '')", "st AS (SELECT *, CASE " + " ".join(f"WHEN {_sum_contains(ws)} > 0 THEN '{k}'" for k, ws in reversed(T.LEARNING.items())) + " END AS style FROM tx)",
    then="SELECT session, arg_max(style, (created_at, id)) AS style FROM st WHERE style IS NOT NULL GROUP BY 1"))
def learning_styles(spark: SparkSession, folder: str) -> DataFrame:
    """How the user learned last in every session: of a text's styles the last named counts."""
    low, style = F.lower("text"), F.lit(None).cast("string")
    for k, ws in T.LEARNING.items():
        style = F.when(T.count_contained(low, ws) > 0, k).otherwise(style)
    a = memory.anchors(spark, folder).filter(decay.is_retrievable() & (F.col("session") != "")).select("session", "created_at", "id", style.alias("style"))
    return a.filter("style is not null").groupBy("session").agg(F.max_by("style", F.struct("created_at", "id")).alias("style"))


@query(S.over(S.LINKS, S.PAIRS, then="SELECT lo, hi, round(greatest(0.0, least(1.0, weight + 0.05) - 0.02), 6) AS weight, 2 AS versions, 'weaken' AS last_action FROM pairs"))
def edge_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge strengthened and then weakened, with the log of its changes."""
    kind = "array<struct<old:double,new:double,action:string,at:double>>"
    p = memory.pairs(memory.edges(spark, folder)).withColumn("versions", F.array().cast(kind))
    for action, delta in (("strengthen", 0.05), ("weaken", 0.02)):
        w, v = U.reweighted(F.col("weight"), F.col("versions"), F.lit(delta), action, F.lit(AS_OF))
        p = p.withColumns({"weight": w, "versions": v})
    return p.select("lo", "hi", r6("weight", "weight"), F.size("versions").alias("versions"), F.element_at("versions", -1)["action"].alias("last_action"))


@query(S.over(S.MEM, _VEC.split(",\nvm AS")[0], "nx AS (SELECT id, lead(id) OVER (PARTITION BY session ORDER BY created_at, id) AS nxt, emotional_valence FROM mem WHERE session <> '')", then=f"""SELECT nx.id, round(CASE WHEN x.e IS NOT NULL AND y.e IS NOT NULL THEN ((1.0 - {_cos('x.e', 'y.e')}) + abs(nx.emotional_valence - m.emotional_valence)) / 2.0 ELSE abs(nx.emotional_valence - m.emotional_valence) END, 6) AS error
    FROM nx JOIN mem m ON m.id = nxt LEFT JOIN vec x ON x.id = nx.id LEFT JOIN vec y ON y.id = nxt"""))
def prediction_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How far each memory's topic and tone are from those of the next one of its session."""
    from mnemospark.operators import ordered

    a = memory.anchors(spark, folder).filter("session <> ''").select("session", "created_at", "id", "emotional_valence")
    v = _vectors(spark, folder)
    rows = ordered.with_next(a, ["session"], ["created_at", "id"], ["id", "emotional_valence"], Scratch(spark, "errors")).filter("next_id is not null")
    rows = rows.join(v, "id", "left").join(v.toDF("next_id", "actual"), "next_id", "left")
    return rows.select("id", r6(U.prediction_error(F.col("embedding"), F.col("actual"), F.col("emotional_valence"), F.col("next_emotional_valence")), "error"))


@query(S.over(S.MEM, _VEC.split(",\nvm AS")[0], _PAIR, then=f"""SELECT a, b, round(cosine, 6) AS cosine, x.session = y.session AND x.session <> '' AS same_session, list_has_any(x.tags, y.tags) AS same_tag, abs(x.created_at - y.created_at) < 604800 AS same_week
    FROM vp JOIN mem x ON x.id = a JOIN mem y ON y.id = b WHERE (x.session = y.session AND x.session <> '') OR list_has_any(x.tags, y.tags) OR abs(x.created_at - y.created_at) < 604800"""))
def blocked_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similar memories of one session, with a tag in common, or made within a week."""
    p = similarity.similar_pairs(_vectors(spark, folder), SIMILAR)
    a = memory.anchors(spark, folder).select("id", "session", "tags", "created_at")
    j = p.join(a.toDF("a", "sa", "ta", "ca"), "a").join(a.toDF("b", "sb", "tb", "cb"), "b")
    session, tag, week = F.expr("sa = sb and sa <> ''"), F.arrays_overlap("ta", "tb"), F.abs(F.col("ca") - F.col("cb")) < 604800
    return j.filter(session | tag | week).select("a", "b", r6("cosine", "cosine"), session.alias("same_session"), tag.alias("same_tag"), week.alias("same_week"))


@query(S.over(S.MEM, *(), then="""SELECT session AS topic, count(*) AS n, approx.n_tags >= 0 AS sketched FROM mem JOIN (SELECT session AS s, count(DISTINCT id) AS n_tags FROM mem GROUP BY 1) approx ON approx.s = session GROUP BY 1, 3"""))
def session_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Memories of each session with mergeable sketches of their ids beside the exact number (a sketch is there for every session)."""
    g = memory.anchors(spark, folder).groupBy("session").agg(F.count("*").alias("n"), F.hll_sketch_agg("id").alias("ids"))
    return g.select(F.col("session").alias("topic"), "n", (F.hll_sketch_estimate("ids") >= 0).alias("sketched"))


@query(S.over(S.MEM, then=f"""SELECT id, round(0.8 * importance + 0.2 * confidence, 6) AS importance, round(exp(-{S.hours('last_at')} / 7200.0), 6) AS decay, stability >= 0.7 AS stable FROM mem"""))
def hub_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Hubs refreshed from their sources: importance blended, slow decay, and whether they are stable."""
    c = F.col
    return memory.anchors(spark, folder).select("id", r6(0.8 * c("importance") + 0.2 * c("confidence"), "importance"), r6(F.exp(-decay.hours("last_at", AS_OF) / 7200.0), "decay"), (c("stability") >= 0.7).alias("stable"))


@query(S.over(S.MEM, then=f"""SELECT id, round(CASE WHEN contains(lower(text), 'wrong') OR contains(lower(text), 'instead') THEN greatest(0.05, stability - 0.20) ELSE least(1.0, stability + 0.02) END, 6) AS touched, round(least(1.0, stability + 0.15), 6) AS reinforced,
    round(greatest(0.01, stability * exp(-{S.hours('last_at')} * ln(2) / 720.0)), 6) AS degraded, stability * exp(-{S.hours('last_at')} * ln(2) / 720.0) < 0.02 AS dropped FROM mem WHERE emotional_valence <> 0"""))
def narratives(spark: SparkSession, folder: str) -> DataFrame:
    """Felt memories as narratives about oneself: contradicted ones weakened, others accessed; reinforced; faded with a half-life of thirty days."""
    c = F.col
    low = F.lower("text")
    against = F.contains(low, F.lit("wrong")) | F.contains(low, F.lit("instead"))
    faded = c("stability") * F.exp(-decay.hours("last_at", AS_OF) * F.log(F.lit(2.0)) / 720.0)
    a = memory.anchors(spark, folder).filter("emotional_valence <> 0")
    return a.select("id", r6(F.when(against, F.greatest(F.lit(0.05), c("stability") - 0.20)).otherwise(F.least(F.lit(1.0), c("stability") + 0.02)), "touched"), r6(F.least(F.lit(1.0), c("stability") + 0.15), "reinforced"), r6(F.greatest(F.lit(0.01), faded), "degraded"), (faded < 0.02).alias("dropped"))


@query("""SELECT event_type AS category, count(*) AS scenarios, sum(CASE WHEN value >= 100 THEN 1 ELSE 0 END)::BIGINT AS passed, round(avg(CASE WHEN value >= 250 THEN 1.0 ELSE 0.0 END), 6) AS exact_match, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def benchmark_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Scored runs by category: how many, how many passed, exact matches and the mean."""
    g = table(spark, folder, "events").groupBy(F.col("event_type").alias("category"))
    return g.agg(F.count("*").alias("scenarios"), F.count_if(F.col("value") >= 100).alias("passed"), r6(F.avg(F.when(F.col("value") >= 250, 1.0).otherwise(0.0)), "exact_match"), r6(F.avg("value"), "mean"))
