"""Queries behind the store's smaller calls: indexes that are edited, buffers, templates, facts, bridges, staged sleep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay, links
from mnemospark.functions import text as T
from mnemospark.operators import graph, search
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.graphs import _GRAPH, _both, _rounds
from mnemospark.plans.texts import _DOCS, QUERY, _bm25, fact_rules
from mnemospark.plans.timeline import _TOPIC, topic
from mnemospark.plans.upkeep import _DOMAINS
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query(S.over(_bm25("SELECT id, CASE WHEN id % 7 = 0 THEN text || ' the recall path' ELSE text END AS text FROM (" + _DOCS + ") WHERE id % 11 <> 0"), then="SELECT id::VARCHAR AS id, round(score, 6) AS score FROM bm"))
def posting_index_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search of an inverted index after documents were added, replaced and removed."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    index = search.PostingIndex(spark, Scratch(spark, "postings").folder())
    index.add(docs)
    index.add(docs.filter("id % 7 = 0").withColumn("text", F.concat("text", F.lit(" the recall path"))))
    index.remove(docs.filter("id % 11 = 0"))
    return index.search(QUERY).select("id", r6("score", "score"))


# Words that say what was done, and the words of each domain, in the order they are tried.
ACTIONS = ("fix", "build", "test", "write", "review", "deploy", "debug", "plan", "discuss", "read", "update", "compare", "merge", "check")
DOMAINS = (
    ("debugging", ("bug", "error", "fix", "debug", "trace")), ("system design", ("architecture", "design", "pattern", "component", "module")),
    ("performance", ("optimize", "performance", "slow", "cache", "latency")), ("configuration", ("config", "settings", "env", "variable")), ("data processing", ("data", "parse", "transform", "csv", "json")),
)
_WORDS = "list_transform(string_split_regex(lower(text), '\\s+'), lambda x: trim(x, '.,;:!?()[]{}''\"'))"
_ACT = f"(list_contains({list(ACTIONS)!r}, w) OR (w LIKE '%ing' AND length(w) > 4) OR (w LIKE '%ed' AND length(w) > 4))"


def _score(words) -> str:
    return "(" + " + ".join(f"CASE WHEN bool_or(contains(lower(text), '{w}')) THEN 1 ELSE 0 END" for w in words) + ")"


@query(S.over(S.MEM, f"aw AS (SELECT session, w, count(*) AS n FROM (SELECT DISTINCT session, id, unnest({_WORDS}) AS w FROM mem WHERE session <> '') WHERE {_ACT} GROUP BY 1, 2)",
    "acts AS (SELECT session, string_agg(w, ', ' ORDER BY n DESC, w) AS action FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, w) AS rn FROM aw WHERE n >= 2) WHERE rn <= 3 GROUP BY 1)",
    "ds AS (SELECT session, count(*) AS n, [" + ", ".join(_score(ws) for _, ws in DOMAINS) + "] AS s FROM mem WHERE session <> '' GROUP BY 1)",
    then=f"SELECT session, n, coalesce(action, 'discussed topics related to') AS action, CASE WHEN list_max(s) > 0 THEN {[d for d, _ in DOMAINS]!r}[list_position(s, list_max(s))] ELSE 'general' END AS domain FROM ds LEFT JOIN acts USING (session) WHERE n >= 3"))
def session_templates(spark: SparkSession, folder: str) -> DataFrame:
    """What fills the summary of every session of three or more memories: its commonest actions and its domain."""
    a = memory.anchors(spark, folder).filter("session <> ''").select("session", "id", "text")
    words = F.transform(F.split(F.lower("text"), r"\s+"), lambda x: F.btrim(x, F.lit(".,;:!?()[]{}'\"")))
    w = F.col("w")
    acts = a.select("session", "id", F.explode(F.array_distinct(words)).alias("w")).filter(w.isin(*ACTIONS) | ((w.endswith("ing") | w.endswith("ed")) & (F.length(w) > 4)))
    counts = acts.groupBy("session", "w").agg(F.count("*").alias("n")).filter("n >= 2")
    top = counts.withColumn("rn", F.row_number().over(W.partitionBy("session").orderBy(F.desc("n"), "w"))).filter("rn <= 3")
    action = top.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "w"))), lambda x: x["w"]), ", ").alias("action"))
    scores = F.array(*[sum((F.max(F.contains(F.lower("text"), F.lit(x)).cast("int")) for x in ws), F.lit(0)) for _, ws in DOMAINS])
    g = a.groupBy("session").agg(F.count("*").alias("n"), scores.alias("s")).filter("n >= 3")
    names = F.array(*[F.lit(d) for d, _ in DOMAINS])
    best = F.when(F.array_max("s") > 0, F.element_at(names, F.array_position("s", F.array_max("s")).cast("int"))).otherwise("general")
    return g.join(action, "session", "left").select("session", "n", F.coalesce("action", F.lit("discussed topics related to")).alias("action"), best.alias("domain"))


@query()
def fact_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The facts that texts state as memories of their own: stable, near the cortex, tagged by kind and subject."""
    f = fact_rules(spark, folder)
    tags = F.array(F.lit("atom_fact"), F.concat(F.lit("fact_type:"), "kind"), F.concat(F.lit("subject:"), "subject"), F.concat(F.lit("predicate:"), "predicate"))
    return f.select(
        F.substring(F.sha2(F.concat("id", F.lit("|"), "predicate"), 256), 1, 16).alias("fact_id"), F.col("id").alias("source_id"), tags.alias("tags"),
        F.lit(0.9).alias("stability"), F.lit(0.05).alias("hippocampal_dependency"), F.col("confidence").alias("importance"), "confidence",
    )


@query(S.over(S.MEM, then=f"""SELECT id, CASE WHEN replay_count >= 3 AND importance > 0.3 THEN 'promote' WHEN greatest(0.0, 1.0 - {S.hours('last_at')} / 24.0) < 0.1 AND importance < 0.3 THEN 'discard' WHEN replay_count >= 5 AND importance > 0.6 THEN 'promote' ELSE 'keep' END AS decision FROM mem WHERE state IN ('active', 'rehearsing')"""))
def hippocampus_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What sleep decides about each buffered memory: promote, discard or keep."""
    c = F.col
    left = F.greatest(F.lit(0.0), 1.0 - decay.hours("last_at", AS_OF) / 24.0)
    d = F.when((c("replay_count") >= 3) & (c("importance") > 0.3), "promote").when((left < 0.1) & (c("importance") < 0.3), "discard").when((c("replay_count") >= 5) & (c("importance") > 0.6), "promote").otherwise("keep")
    return memory.anchors(spark, folder).filter(c("state").isin("active", "rehearsing")).select("id", d.alias("decision"))


@query(S.over(S.MEM, then="SELECT id, contains(lower(text), 'recall') AS by_text, list_contains(tags, 'memory') AS by_tag FROM mem WHERE state IN ('active', 'rehearsing') AND (contains(lower(text), 'recall') OR list_contains(tags, 'memory'))"))
def hippocampus_search(spark: SparkSession, folder: str) -> DataFrame:
    """Buffered memories whose text holds a word or that carry a tag."""
    by_text, by_tag = F.contains(F.lower("text"), F.lit("recall")), F.array_contains("tags", "memory")
    return memory.anchors(spark, folder).filter(F.col("state").isin("active", "rehearsing") & (by_text | by_tag)).select("id", by_text.alias("by_text"), by_tag.alias("by_tag"))


_PRIO = f"0.6 * importance + 0.3 * exp(-greatest(0.0, {S.AS_OF} - last_at) / 600.0) + 0.15 * ln(1 + replay_count)"
_QW = sorted(w for w in search.query_tokens(QUERY) if w not in T.STOP_WORDS)


@query(S.over(S.MEM, f"wm AS (SELECT id, {_PRIO} AS p, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')), {_QW!r})) / {len(_QW)}.0 AS k FROM mem WHERE state = 'active')",
    then="SELECT id, round(s, 6) AS score FROM (SELECT id, 0.6 * k + 0.4 * p AS s FROM wm WHERE k > 0) ORDER BY round(s, 9) DESC, id LIMIT 10"))
def working_memory_relevant(spark: SparkSession, folder: str) -> DataFrame:
    """The ten items of working memory that fit a query by keywords and priority (a top-k report)."""
    p = 0.6 * F.col("importance") + 0.3 * F.exp(-F.greatest(F.lit(0.0), AS_OF - F.col("last_at")) / 600.0) + 0.15 * F.log(1 + F.col("replay_count"))
    k = F.size(F.array_intersect(F.array_distinct(T.tokens("text")), F.array(*map(F.lit, _QW)))) / float(len(_QW))
    a = memory.anchors(spark, folder).filter("state = 'active'").select("id", k.alias("k"), p.alias("p")).filter("k > 0")
    return search.ranked(a.select("id", (0.6 * F.col("k") + 0.4 * F.col("p")).alias("score")), 10).select("id", r6("score", "score"))


@query(S.over(S.MEM, then=f"""SELECT floor(created_at / 86400)::BIGINT AS day, {_TOPIC} AS topic, count(*) AS n, round(least(1.0, max(importance) + CASE WHEN {_TOPIC} = 'memory' THEN 0.1 ELSE 0.0 END), 6) AS importance FROM mem WHERE state <> 'ghost' GROUP BY 1, 2"""))
def timespine_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of the timeline without removed memories, one topic raised."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).withColumns({"day": F.floor(F.col("created_at") / 86400).cast("bigint"), "topic": topic()})
    g = a.groupBy("day", "topic").agg(F.count("*").alias("n"), F.max("importance").alias("i"))
    return g.select("day", "topic", "n", r6(F.least(F.lit(1.0), F.col("i") + F.when(F.col("topic") == "memory", 0.1).otherwise(0.0)), "importance"))


@query("SELECT domain, count(*) AS words, max(depth)::INTEGER AS depth, string_agg(word, '/' ORDER BY depth, word) AS path FROM (SELECT * FROM (VALUES " + ", ".join(map(str, _DOMAINS)) + ", ('custom', 'harbour', 1)) t(domain, word, depth)) WHERE word <> 'rent' GROUP BY 1")
def domain_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The domain words after one was added and one removed, with each domain's path."""
    d = spark.createDataFrame([*_DOMAINS, ("custom", "harbour", 1)], "domain string, word string, depth int").filter("word <> 'rent'")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "word"))), lambda x: x["word"]), "/")
    return d.groupBy("domain").agg(F.count("*").alias("words"), F.max("depth").alias("depth"), path.alias("path"))


@query(S.over(S.MEM, "g AS (SELECT schema_ref, count(*) AS n, count(DISTINCT session) AS sessions, arg_max(id, (round(0.7 * importance + 0.3 * stability, 9), id)) AS best FROM mem WHERE schema_ref IS NOT NULL GROUP BY 1)", then="SELECT schema_ref AS hub, n, sessions, best FROM g WHERE n >= 2"))
def hub_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The hubs that two or more memories belong to, with the member that says most."""
    a = memory.anchors(spark, folder).filter("schema_ref is not null")
    best = F.max_by("id", F.struct(F.round(0.7 * F.col("importance") + 0.3 * F.col("stability"), 9), "id"))
    g = a.groupBy(F.col("schema_ref").alias("hub")).agg(F.count("*").alias("n"), F.countDistinct("session").alias("sessions"), best.alias("best"))
    return g.filter("n >= 2")


@query(S.over(S.LINKS, S.MEM, "r AS (SELECT edge_type AS kind, src, dst, last_at FROM links WHERE edge_type IN ('invalidated_by', 'superseded_by', 'contradicts', 'conflicts_with'))", then="SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, count(*) FILTER (contains(lower(text), 'memory')) AS on_topic, round(max(r.last_at), 6) AS latest FROM r LEFT JOIN mem ON id = src GROUP BY 1"))
def reflection_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What reflection has recorded: by kind, how many, from how many memories, on a topic, and the latest."""
    r = memory.edges(spark, folder).filter(F.col("edge_type").isin("invalidated_by", "superseded_by", "contradicts", "conflicts_with"))
    t = memory.anchors(spark, folder).select(F.col("id").alias("src"), "text")
    g = r.select(F.col("edge_type").alias("kind"), "src", "last_at").join(t, "src", "left").groupBy("kind")
    return g.agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.count_if(F.contains(F.lower("text"), F.lit("memory"))).alias("on_topic"), r6(F.max("last_at"), "latest"))


_SIX = ("importance", "frequency", "recency", "emotional_valence", "stability", "surprise")


@query(S.over(S.MEM, *_GRAPH, _rounds(16), "cp AS (SELECT node AS id, label AS root FROM c16)", "big AS (SELECT root FROM cp GROUP BY 1 ORDER BY count(*) DESC, root LIMIT 20)",
    "ce AS MATERIALIZED (SELECT root, min(id) AS rep, " + ", ".join(f"avg({c}) AS {c}" for c in _SIX) + ", avg(natural_frequency) AS f FROM cp JOIN big USING (root) JOIN mem USING (id) GROUP BY 1)",
    "br AS (SELECT x.rep AS a, y.rep AS b, (" + " + ".join(f"x.{c} * y.{c}" for c in _SIX) + ") / (sqrt(" + " + ".join(f"x.{c} * x.{c}" for c in _SIX) + ") * sqrt(" + " + ".join(f"y.{c} * y.{c}" for c in _SIX) + ") + 1e-8) AS sim, greatest(x.f, y.f) / (least(x.f, y.f) + 1e-8) AS ratio FROM ce x JOIN ce y ON x.root < y.root)",
    then="SELECT a, b, round(sim + CASE WHEN abs(ratio - round(ratio)) < 0.15 THEN 0.2 ELSE 0.0 END * (1.0 - sim), 6) AS score FROM br WHERE sim + CASE WHEN abs(ratio - round(ratio)) < 0.15 THEN 0.2 ELSE 0.0 END * (1.0 - sim) > 0.6"))
def distant_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Bridges between the twenty largest constellations whose means are alike, harmonic ones more (a top-k report; no edge joins two of them)."""
    pairs = memory.pairs(memory.edges(spark, folder))
    groups = Scratch(spark, "bridges").keep(graph.components(pairs))
    big = groups.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(20).select("component")
    a = memory.anchors(spark, folder).withColumnRenamed("id", "node")
    means = [F.avg(c).alias(c) for c in (*_SIX, "natural_frequency")]
    c = Scratch(spark, "bridges").keep(groups.join(big, "component").join(a, "node").groupBy("component").agg(F.min("node").alias("rep"), *means).withColumn("v", F.array(*map(F.col, _SIX))))
    from mnemospark.functions.vectors import cosine

    x, y = (c.select(F.col("component").alias(f"c{s}"), F.col("rep").alias(s), F.col("v").alias(f"v{s}"), F.col("natural_frequency").alias(f"f{s}")) for s in "ab")
    sim, ratio = cosine(F.col("va"), F.col("vb")), F.greatest("fa", "fb") / (F.least("fa", "fb") + 1e-8)
    score = F.col("sim") + F.when(F.abs(F.col("ratio") - F.round("ratio")) < 0.15, 0.2).otherwise(0.0) * (1.0 - F.col("sim"))
    met = x.join(y, F.col("ca") < F.col("cb")).select("a", "b", sim.alias("sim"), ratio.alias("ratio")).withColumn("s", score)
    return met.filter("s > 0.6").select("a", "b", r6("s", "score"))


@query(S.over(S.LINKS, S.PAIRS, then=f"""SELECT 'fade' AS phase, count(*) AS n FROM pairs WHERE {S.AS_OF} > created_at + CASE WHEN edge_type IN {links.STRONG} THEN 7776000.0 ELSE 1209600.0 END UNION ALL SELECT 'learn', count(*) FROM pairs WHERE {S.hours('last_at')} < 24 AND co_count > 0
    UNION ALL SELECT 'link', count(*) FROM pairs WHERE weight > 0.6"""))
def micro_sleep(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges each phase of a short sleep concerns; every phase is stored, so that a stopped run goes on with the next one."""
    from mnemospark.operators.stages import Stages

    p = Scratch(spark, "micro").keep(memory.pairs(memory.edges(spark, folder)))
    run = Stages(spark, Scratch(spark, "micro").folder())
    run.add("fade", lambda: p.filter(links.is_expired(AS_OF)))
    run.add("learn", lambda: p.filter((decay.hours("last_at", AS_OF) < 24) & (F.col("co_count") > 0)))
    run.add("link", lambda: p.filter("weight > 0.6"))
    out = None
    for name, df in run.run().items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("phase"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query(S.over(S.MEM, then=f"""SELECT session, count(*) AS relevant, round(avg(importance), 6) AS importance, string_agg(id, ',' ORDER BY created_at DESC, id) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id) AS rn FROM mem WHERE session <> '' AND state <> 'ghost' AND (importance >= 0.6 OR list_contains(tags, 'preference'))) WHERE rn <= 3 GROUP BY 1"""))
def scheduler_context(spark: SparkSession, folder: str) -> DataFrame:
    """What of each session's history goes into a context: its three latest important or preferred memories."""
    a = memory.anchors(spark, folder).filter((F.col("session") != "") & decay.is_retrievable() & ((F.col("importance") >= 0.6) | F.array_contains("tags", "preference")))
    rn = F.row_number().over(W.partitionBy("session").orderBy(F.desc("created_at"), "id"))
    top = a.withColumn("rn", rn).filter("rn <= 3")
    latest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",")
    return top.groupBy("session").agg(F.count("*").alias("relevant"), r6(F.avg("importance"), "importance"), latest.alias("latest"))
