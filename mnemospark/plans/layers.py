"""Queries that condense memories: session summaries, layers, beliefs, expertise, hierarchies, tier caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators import ordered, search
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.timeline import topic
from mnemospark.plans.vectors import _Q, _VM, _cos, _query_vector, memories
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

_TOPIC = "coalesce(tags[1], 'general')"


@query(S.over(S.MEM, then=f"""SELECT session, {_TOPIC} AS topic, count(*) AS n, arg_max(text, (importance, id)) || ' (' || count(*) || ' memories)' AS summary, round(avg(importance), 6) AS importance, 0.85::DOUBLE AS stability FROM mem GROUP BY 1, 2 HAVING count(*) >= 3"""))
def session_compression(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of three or more memories of a session on one topic, by their most important one."""
    g = memory.anchors(spark, folder).groupBy("session", topic().alias("topic")).agg(F.count("*").alias("n"), F.max_by("text", F.struct("importance", "id")).alias("t"), F.avg("importance").alias("i"))
    return g.filter("n >= 3").select("session", "topic", "n", F.concat("t", F.lit(" ("), F.col("n"), F.lit(" memories)")).alias("summary"), r6("i", "importance"), F.lit(0.85).alias("stability"))


@query(S.over(S.MEM, then=f"""SELECT id, round(importance * CASE WHEN count(*) OVER (PARTITION BY session, {_TOPIC}) >= 3 THEN 0.3 ELSE 1.0 END, 6) AS importance FROM mem"""))
def compressed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Importance of memories after those that a summary covers were reduced."""
    a = memory.anchors(spark, folder).select("id", "session", topic().alias("topic"), "importance")
    covered = a.groupBy("session", "topic").agg(F.count("*").alias("n"))
    return a.join(covered, ["session", "topic"]).select("id", r6(F.col("importance") * F.when(F.col("n") >= 3, 0.3).otherwise(1.0), "importance"))


@query(S.over(S.MEM, "m AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY created_at, id) - 1) // 8 AS batch FROM mem)", "e AS (SELECT session, batch FROM m GROUP BY 1, 2 HAVING count(*) = 8)", "s AS (SELECT session, count(*) AS events FROM e GROUP BY 1)",
    then="SELECT layer, n FROM (SELECT 'message' AS layer, count(*) AS n FROM mem UNION ALL SELECT 'event', count(*) FROM e UNION ALL SELECT 'semantic', count(*) FROM s WHERE events >= 5 UNION ALL SELECT 'personality', count(*) FROM s WHERE events >= 20)"))
def four_layers(spark: SparkSession, folder: str) -> DataFrame:
    """How many items each layer holds: messages, events of eight, semantic and personality units."""
    placed = ordered.with_position(memory.anchors(spark, folder).select("session", "created_at", "id"), ["session"], ["created_at", "id"], Scratch(spark, "layers"))
    m = placed.select("session", F.floor((F.col("position") - 1) / 8).alias("batch"))
    batches = m.groupBy("session", "batch").agg(F.count("*").alias("n"))
    sessions = batches.groupBy("session").agg(F.sum("n").alias("messages"), F.count_if(F.col("n") == 8).alias("events"))
    t = sessions.agg(F.sum("messages").alias("message"), F.sum("events").alias("event"), F.count_if(F.col("events") >= 5).alias("semantic"), F.count_if(F.col("events") >= 20).alias("personality"))
    layers = F.array(*[F.struct(F.lit(x).alias("layer"), F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias("n")) for x in t.columns])
    return t.select(F.explode(layers).alias("l")).select("l.layer", "l.n")


@query(S.over(S.MEM, "t AS (SELECT session, unnest(tags) AS tag, stability, confidence, last_at, id FROM mem)", then=f"""SELECT tag AS belief, count(DISTINCT session) AS sessions, round(avg(stability), 6) AS stability, round(avg(confidence) * least(1.0, count(DISTINCT session) / 5.0), 6) AS confidence,
    round(avg(stability) * exp(-{S.hours('max(last_at)')} / 168.0), 6) AS strength FROM t GROUP BY 1 HAVING count(DISTINCT session) >= 3"""))
def worldviews(spark: SparkSession, folder: str) -> DataFrame:
    """Beliefs that three or more sessions share, with stability, confidence and present strength."""
    t = memory.anchors(spark, folder).select("session", F.explode("tags").alias("belief"), "stability", "confidence", "last_at")
    g = t.groupBy("belief").agg(F.countDistinct("session").alias("sessions"), F.avg("stability").alias("s"), F.avg("confidence").alias("c"), F.max("last_at").alias("last"))
    strength = F.col("s") * F.exp(-decay.hours("last", AS_OF) / 168.0)
    return g.filter("sessions >= 3").select("belief", "sessions", r6("s", "stability"), r6(F.col("c") * F.least(F.lit(1.0), F.col("sessions") / 5.0), "confidence"), r6(strength, "strength"))


@query(S.over(S.MEM, "t AS (SELECT unnest(tags) AS tag, importance FROM mem)", then="SELECT tag AS area, round(least(1.0, sum(0.03 * importance)), 6) AS expertise FROM t WHERE tag NOT IN ('test', 'debug', 'chat', 'conversation') GROUP BY 1"))
def expertise(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of expertise: tags by the importance of what carries them, at most 1."""
    t = memory.anchors(spark, folder).select(F.explode("tags").alias("area"), "importance").filter(~F.col("area").isin("test", "debug", "chat", "conversation"))
    return t.groupBy("area").agg(r6(F.least(F.lit(1.0), F.sum(0.03 * F.col("importance"))), "expertise"))


_QUESTION = ("how to", "what", "why", "which", "can you", "怎么", "如何", "为什么", "能不能")


@query(S.over(S.MEM, then="SELECT session, count(*) AS messages, round(avg(length(text)), 6) AS mean_length, count(*) FILTER (contains(text, '?') OR " + " OR ".join(f"contains(lower(text), '{w}')" for w in _QUESTION) + ") AS questions FROM mem GROUP BY 1"))
def communication_style(spark: SparkSession, folder: str) -> DataFrame:
    """Messages, mean length and questions of every session."""
    asks = F.contains("text", F.lit("?")) | (T.count_contained(F.lower("text"), _QUESTION) > 0)
    return memory.anchors(spark, folder).groupBy("session").agg(F.count("*").alias("messages"), r6(F.avg(F.length("text")), "mean_length"), F.count_if(asks).alias("questions"))


@query(S.over(S.MEM, S.LINKS, S.PAIRS, f"r AS (SELECT id, {S.RETENTION} AS r FROM mem)", then="""SELECT lo, hi, CASE WHEN a.r > b.r OR (a.r = b.r AND lo < hi) THEN hi ELSE lo END AS loser, round(least(a.r, b.r) * 0.7, 6) AS weakened FROM pairs JOIN r a ON a.id = lo JOIN r b ON b.id = hi WHERE edge_type IN ('contradicts', 'conflicts_with')"""))
def reflection_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Contradicting memories: which of the two is invalidated and what is left of it."""
    r = memory.anchors(spark, folder).select("id", decay.retention(AS_OF).alias("r"))
    p = memory.pairs(memory.edges(spark, folder)).filter(F.col("edge_type").isin("contradicts", "conflicts_with")).select("lo", "hi")
    j = p.join(r.toDF("lo", "ra"), "lo").join(r.toDF("hi", "rb"), "hi")
    return j.select("lo", "hi", F.when(F.col("ra") >= F.col("rb"), F.col("hi")).otherwise(F.col("lo")).alias("loser"), r6(F.least("ra", "rb") * 0.7, "weakened"))


_CAPS = {"stm": 100, "mtm": 2000, "ltm": 500, "core": 50}
_TIER = "CASE WHEN stability >= 0.7 AND confidence >= 0.7 THEN 'core' WHEN stability >= 0.5 THEN 'ltm' WHEN replay_count >= 2 THEN 'mtm' ELSE 'stm' END"


def tier() -> Column:
    """The memory tier by stability, confidence and replays."""
    return F.when((F.col("stability") >= 0.7) & (F.col("confidence") >= 0.7), "core").when(F.col("stability") >= 0.5, "ltm").when(F.col("replay_count") >= 2, "mtm").otherwise("stm")


@query(S.over(S.MEM, f"t AS (SELECT id, {_TIER} AS tier, {S.RETENTION} AS r FROM mem)", then=f"SELECT id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round(r, 9) DESC, id)::INTEGER AS rank FROM t) WHERE rank <= {S.case('tier', _CAPS, 0)}"))
def tier_caps(spark: SparkSession, folder: str) -> DataFrame:
    """The memories that each tier's capacity keeps (capacities are the tiers' feature)."""
    t = memory.anchors(spark, folder).select("id", tier().alias("tier"), F.round(decay.retention(AS_OF), 9).alias("r"))
    rank = F.row_number().over(W.partitionBy("tier").orderBy(F.desc("r"), "id"))
    return t.withColumn("rank", rank).filter(F.col("rank") <= decay.lookup(_CAPS, F.col("tier"))).select("id", "tier", "rank")


@query(S.over(S.MEM, then="SELECT text, id, copies FROM (SELECT lower(trim(text)) AS text, min(id) AS id, count(*) AS copies FROM mem GROUP BY 1) WHERE copies > 1 AND text <> ''"))
def repeated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that several memories have, with the least id."""
    g = memory.anchors(spark, folder).groupBy(F.lower(F.trim("text")).alias("text")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return g.filter("copies > 1 and text <> ''")


@query("""SELECT r_name AS goal, count(*) AS subgoals, round(avg(p), 6) AS progress, CASE WHEN avg(p) >= 0.95 THEN 'achieved' WHEN avg(p) > 0.5 THEN 'active' ELSE 'stale' END AS status FROM (SELECT r_name, n_name, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS p
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2) GROUP BY 1""")
def goal_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of a tree of goals from its leaves up: the mean of the means below."""
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = c.groupBy("n_regionkey", "n_name").agg(F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("p"))
    up = leaves.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("goal")).agg(F.count("*").alias("subgoals"), F.avg("p").alias("p"))
    return up.select("goal", "subgoals", r6("p", "progress"), F.when(F.col("p") >= 0.95, "achieved").when(F.col("p") > 0.5, "active").otherwise("stale").alias("status"))


@query("SELECT s_suppkey AS leaf, n_name || '>' || r_name || '>global' AS chain FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def parent_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The chain of parents of every leaf of a hierarchy."""
    s = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("leaf"), F.concat_ws(">", "n_name", "r_name", F.lit("global")).alias("chain"))


@query(S.over(_VM, _Q, f"""s AS (SELECT id, {_cos('e', 'qe')} AS c, {S.RETENTION} AS r FROM vm CROSS JOIN q)""", "a AS (SELECT id FROM s ORDER BY round(c, 9) DESC, id LIMIT 10)", "b AS (SELECT id FROM s ORDER BY round(greatest(0.0, c) * r, 9) DESC, id LIMIT 10)",
    then="SELECT count(*) AS common, round(count(*) / 10.0, 6) AS recall FROM a JOIN b USING (id)"))
def recall_at_10(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the ten most similar vectors the retention-weighted ranking returns."""
    s = memories(spark, folder).select("id", V.cosine(F.col("embedding"), _query_vector(spark, folder)).alias("c"), decay.retention(AS_OF).alias("r"))
    a = search.ranked(s.select("id", F.col("c").alias("score")), 10).select("id")
    b = search.ranked(s.select("id", (F.greatest(F.lit(0.0), "c") * F.col("r")).alias("score")), 10).select("id")
    return a.join(b, "id").agg(F.count("*").alias("common"), r6(F.count("*") / 10.0, "recall"))


@query(S.over(S.MEM, then=f"SELECT id FROM mem WHERE {S.THERMAL} = 'hot' ORDER BY last_at DESC, id LIMIT 50"))
def hot_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty hot memories used last (a top-k report)."""
    return memory.anchors(spark, folder).filter(decay.thermal() == "hot").orderBy(F.desc("last_at"), "id").limit(50).select("id")


@query(S.over(S.MEM, "d AS (SELECT session, created_at - lag(created_at) OVER (PARTITION BY session ORDER BY created_at, id) AS gap FROM mem)", then="SELECT session, count(gap) AS gaps, count(*) FILTER (gap > 86400) AS breaks, round(median(gap), 6) AS median_gap FROM d GROUP BY 1 HAVING count(gap) > 0"))
def session_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps between the memories of every session: number, those of more than a day, median."""
    scratch = Scratch(spark, "gaps")
    a = memory.anchors(spark, folder).select("session", "created_at", "id")
    before = ordered.with_next(a, ["session"], ["created_at", "id"], ["created_at"], scratch, -1)
    d = scratch.keep(before.select("session", (F.col("created_at") - F.col("next_created_at")).alias("gap")).filter("gap is not null"))
    counts = d.groupBy("session").agg(F.count("gap").alias("gaps"), F.count_if(F.col("gap") > 86400).alias("breaks"))
    return counts.join(ordered.medians(d, "session", "gap", scratch), "session").select("session", "gaps", "breaks", r6("median", "median_gap"))
