"""Queries on time: timeline, sessions, tiers, beliefs, event windows and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.operators import ordered
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table
from mnemospark.streaming import windows
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

_DAY = "floor(created_at / 86400)::BIGINT"
_TOPIC = "coalesce(tags[1], 'general')"


def day() -> Column:
    """The number of the day of creation."""
    return F.floor(F.col("created_at") / 86400).cast("bigint")


def topic() -> Column:
    """The first tag, or general."""
    return F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("general"))


@query(S.over(S.MEM, f"c AS (SELECT {_DAY} AS day, {_TOPIC} AS topic, count(*) AS n, max(importance) AS importance FROM mem GROUP BY 1, 2)", then="SELECT day, topic, n, round(importance, 6) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY importance DESC, topic) AS rn FROM c) WHERE rn <= 10"))
def timespine_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most important topics of every day."""
    return _clusters(spark, folder).select("day", "topic", "n", r6("importance", "importance"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    c = memory.anchors(spark, folder).groupBy(day().alias("day"), topic().alias("topic")).agg(F.count("*").alias("n"), F.max("importance").alias("importance"))
    return c.withColumn("rn", F.row_number().over(W.partitionBy("day").orderBy(F.desc("importance"), "topic"))).filter("rn <= 10")


@query(S.over(S.MEM, f"c AS (SELECT {_DAY} AS day, {_TOPIC} AS topic, count(*) AS n, max(importance) AS importance FROM mem GROUP BY 1, 2)", then=f"""SELECT day, topic, n, round(importance, 6) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY importance DESC, topic) AS rn FROM c)
    WHERE rn <= 10 AND day >= floor({S.AS_OF} / 86400) - 30 ORDER BY day DESC, importance DESC, topic LIMIT 20"""))
def timespine_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 clusters, newest day first and by importance within it (a top-k report)."""
    c = _clusters(spark, folder).filter(F.col("day") >= int(AS_OF // 86400) - 30)
    return c.orderBy(F.desc("day"), F.desc("importance"), "topic").limit(20).select("day", "topic", "n", r6("importance", "importance"))


@query(S.over(S.MEM, then=f"SELECT id, {_DAY} AS day FROM mem WHERE {_DAY} BETWEEN floor({S.AS_OF} / 86400) - 60 AND floor({S.AS_OF} / 86400) - 30"))
def timespine_window(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of a window of days."""
    d = int(AS_OF // 86400)
    return memory.anchors(spark, folder).select("id", day().alias("day")).filter(F.col("day").between(d - 60, d - 30))


@query(S.over(S.MEM, then="""SELECT id, session, lag(id) OVER w AS previous, lead(id) OVER w AS following, row_number() OVER w AS position FROM mem WHERE session <> '' WINDOW w AS (PARTITION BY session ORDER BY created_at, id)"""))
def episode_links(spark: SparkSession, folder: str) -> DataFrame:
    """The episodes of every session as a linked list."""
    scratch = Scratch(spark, "episodes")
    a = memory.anchors(spark, folder).filter("session <> ''").select("id", "session", "created_at")
    placed = scratch.keep(ordered.with_position(a, ["session"], ["created_at", "id"], scratch))
    before = ordered.beside(placed, ["session"], "position", ["id"], -1, "previous").withColumnRenamed("previous_id", "previous").select("session", "position", "previous")
    after = ordered.beside(placed, ["session"], "position", ["id"], 1, "following").withColumnRenamed("following_id", "following")
    return after.join(before, ["session", "position"]).select("id", "session", "previous", "following", "position")


@query(S.over(S.MEM, "tg AS (SELECT session, tag, count(*) AS n FROM (SELECT session, unnest(tags) AS tag FROM mem) GROUP BY 1, 2)", "tt AS (SELECT session, string_agg(tag, ',' ORDER BY n DESC, tag) AS top_tags FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, tag) AS rn FROM tg) WHERE rn <= 5 GROUP BY 1)",
    then="""SELECT session, count(*) AS episodes, round(max(created_at) - min(created_at), 6) AS span, round(avg(importance), 6) AS importance, round(avg(emotional_valence), 6) AS valence, count(*) FILTER (importance >= 0.6) AS important, coalesce(any_value(top_tags), '') AS top_tags FROM mem LEFT JOIN tt USING (session) GROUP BY 1"""))
def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Length, importance, emotion and commonest tags of every session."""
    a = memory.anchors(spark, folder)
    t = a.select("session", F.explode("tags").alias("tag")).groupBy("session", "tag").agg(F.count("*").alias("n"))
    rn = F.row_number().over(W.partitionBy("session").orderBy(F.desc("n"), "tag"))
    top = t.withColumn("rn", rn).filter("rn <= 5").groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]), ",").alias("top_tags"))
    s = a.groupBy("session").agg(
        F.count("*").alias("episodes"), r6(F.max("created_at") - F.min("created_at"), "span"), r6(F.avg("importance"), "importance"),
        r6(F.avg("emotional_valence"), "valence"), F.count_if(F.col("importance") >= 0.6).alias("important"),
    )
    return s.join(top, "session", "left").withColumn("top_tags", F.coalesce("top_tags", F.lit("")))


@query(S.over(S.MEM, "h AS (SELECT session, emotional_valence AS e, ntile(2) OVER (PARTITION BY session ORDER BY created_at, id) AS half FROM mem)", then="""SELECT session, round(avg(e), 6) AS mean, CASE WHEN avg(e) FILTER (half = 2) - avg(e) FILTER (half = 1) > 0.1 THEN 'rising' WHEN avg(e) FILTER (half = 2) - avg(e) FILTER (half = 1) < -0.1 THEN 'falling' ELSE 'steady' END AS trend FROM h GROUP BY 1"""))
def emotional_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Mean emotion of every session and how its halves differ."""
    scratch = Scratch(spark, "trend")
    a = memory.anchors(spark, folder).select("session", "created_at", "id", F.col("emotional_valence").alias("e"))
    placed = ordered.sizes(scratch.keep(ordered.with_position(a, ["session"], ["created_at", "id"], scratch)), ["session"])
    h = placed.withColumn("half", ordered.tile(F.col("position"), F.col("size"), 2))
    g = h.groupBy("session").agg(F.avg("e").alias("m"), (F.avg(F.when(F.col("half") == 2, F.col("e"))) - F.avg(F.when(F.col("half") == 1, F.col("e")))).alias("d"))
    return g.select("session", r6("m", "mean"), F.when(F.col("d") > 0.1, "rising").when(F.col("d") < -0.1, "falling").otherwise("steady").alias("trend"))


@query(S.over(S.MEM, "x AS (SELECT session, max(created_at) AS last FROM mem GROUP BY 1)", "k AS (SELECT session FROM x ORDER BY last DESC, session LIMIT 5)", then="SELECT id, session FROM (SELECT id, session, row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id) AS rn FROM mem WHERE session IN (SELECT session FROM k)) WHERE rn <= 50"))
def last_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The raw buffer: the last 50 items of the last five sessions (a top-k report)."""
    a = memory.anchors(spark, folder).select("id", "session", "created_at")
    keep = a.groupBy("session").agg(F.max("created_at").alias("last")).orderBy(F.desc("last"), "session").limit(5).select("session")
    rn = F.row_number().over(W.partitionBy("session").orderBy(F.desc("created_at"), "id"))
    return a.join(keep, "session", "left_semi").withColumn("rn", rn).filter("rn <= 50").select("id", "session")


@query(S.over(S.MEM, f"w AS (SELECT id, 0.6 * importance + 0.3 * exp(-greatest(0.0, {S.AS_OF} - last_at) / 86400.0) + 0.15 * ln(1 + replay_count) AS p FROM mem WHERE state <> 'ghost')", then="SELECT id, round(p, 6) AS priority FROM w ORDER BY round(p, 9) DESC, id LIMIT 15"))
def working_memory_top15(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen items that stay in working memory (a top-k report)."""
    p = 0.6 * F.col("importance") + 0.3 * F.exp(-F.greatest(F.lit(0.0), AS_OF - F.col("last_at")) / 86400.0) + 0.15 * F.log(1 + F.col("replay_count"))
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", p.alias("p"))
    return a.orderBy(F.desc(F.round("p", 9)), "id").limit(15).select("id", r6("p", "priority"))


@query(S.over(S.MEM, then=f"SELECT {_TOPIC} AS topic, id, row_number() OVER w AS version, lag(id) OVER w AS supersedes, lead(id) OVER w IS NULL AS current FROM mem WINDOW w AS (PARTITION BY {_TOPIC} ORDER BY created_at, id)"))
def belief_chain(spark: SparkSession, folder: str) -> DataFrame:
    """What is held on each topic as versions that supersede each other."""
    scratch = Scratch(spark, "beliefs")
    a = memory.anchors(spark, folder).select(topic().alias("topic"), "id", "created_at")
    placed = scratch.keep(ordered.with_position(a, ["topic"], ["created_at", "id"], scratch, "version"))
    rows = ordered.sizes(ordered.beside(placed, ["topic"], "version", ["id"], -1, "before"), ["topic"])
    return rows.select("topic", "id", "version", F.col("before_id").alias("supersedes"), (F.col("version") == F.col("size")).alias("current"))


@query(S.over(S.MEM, f"t AS (SELECT unnest(tags) AS tag, id, {S.RETENTION} AS r FROM mem)", then="SELECT tag, id, rank, round(pow(0.85, rank - 1), 6) AS bonus FROM (SELECT tag, id, row_number() OVER (PARTITION BY tag ORDER BY round(r, 9) DESC, id)::INTEGER AS rank FROM t) WHERE rank <= 20"))
def topic_cache_top20(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty anchors of each tag that are remembered best."""
    t = memory.anchors(spark, folder).select(F.explode("tags").alias("tag"), "id", F.round(decay.retention(AS_OF), 9).alias("r"))
    rank = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("r"), "id"))
    return t.withColumn("rank", rank).filter("rank <= 20").select("tag", "id", "rank", r6(F.pow(F.lit(0.85), F.col("rank") - 1), "bonus"))


@query(S.over(S.MEM, f"d AS (SELECT id, CASE WHEN {S.hours('last_at')} > 720 THEN 'archive' WHEN {S.hours('last_at')} > 72 THEN 'cold' ELSE 'hot' END AS level, text FROM mem)", then="SELECT level, count(*) AS n, sum(length(CASE level WHEN 'archive' THEN left(text, 200) ELSE text END))::BIGINT AS chars FROM d GROUP BY 1"))
def thermal_demotion(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors and characters kept after demotion by idle time."""
    h = decay.hours("last_at", AS_OF)
    level = F.when(h > 720, "archive").when(h > 72, "cold").otherwise("hot")
    a = memory.anchors(spark, folder).select(level.alias("level"), "text")
    kept = F.length(F.when(F.col("level") == "archive", F.substring("text", 1, 200)).otherwise(F.col("text")))
    return a.groupBy("level").agg(F.count("*").alias("n"), F.sum(kept).cast("bigint").alias("chars"))


@query(S.over(S.MEM, "t AS (SELECT unnest(tags) AS tag, importance, stability, confidence FROM mem)", then="""SELECT tag, count(*) AS n, round(avg(stability), 6) AS stability, round(avg(confidence), 6) AS confidence, CASE WHEN count(*) >= 3 AND avg(stability) >= 0.7 AND avg(confidence) >= 0.7 THEN 'core' WHEN count(*) >= 3 AND avg(stability) >= 0.5 THEN 'ltm' WHEN count(*) >= 2 THEN 'mtm' ELSE 'stm' END AS tier FROM t GROUP BY 1"""))
def tier_promotions(spark: SparkSession, folder: str) -> DataFrame:
    """The memory tier each topic is promoted to by number, stability and confidence."""
    t = memory.anchors(spark, folder).select(F.explode("tags").alias("tag"), "stability", "confidence").groupBy("tag").agg(F.count("*").alias("n"), F.avg("stability").alias("s"), F.avg("confidence").alias("c"))
    tier = F.when((F.col("n") >= 3) & (F.col("s") >= 0.7) & (F.col("c") >= 0.7), "core").when((F.col("n") >= 3) & (F.col("s") >= 0.5), "ltm").when(F.col("n") >= 2, "mtm").otherwise("stm")
    return t.select("tag", "n", r6("s", "stability"), r6("c", "confidence"), tier.alias("tier"))


@query(S.over(S.MEM, "t AS (SELECT unnest(tags) AS tag, id, stability FROM mem)", "k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY stability DESC, id) AS rn, count(*) OVER (PARTITION BY tag) AS n FROM t)", then="SELECT tag, n, string_agg(id, ',' ORDER BY rn) AS instances, round(avg(stability), 6) AS stability FROM k WHERE rn <= 3 AND n >= 3 GROUP BY 1, 2"))
def schema_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Schemas: the three most stable anchors of every tag that three or more carry."""
    t = memory.anchors(spark, folder).select(F.explode("tags").alias("tag"), "id", "stability")
    sizes = t.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 3")
    top = t.withColumn("rn", F.row_number().over(W.partitionBy("tag").orderBy(F.desc("stability"), "id"))).filter("rn <= 3")
    g = top.groupBy("tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: x["id"]), ",").alias("instances"), r6(F.avg("stability"), "stability"))
    return g.join(sizes, "tag").select("tag", "n", "instances", "stability")


_DOMAIN = """CASE WHEN list_has_any(tags, ['reflection', 'self', 'meta']) THEN 'reflection' WHEN list_has_any(tags, ['preference', 'workflow', 'style', 'habit', 'rule']) OR replay_count >= 4 THEN 'procedural'
    WHEN list_has_any(tags, ['fact', 'knowledge', 'schema', 'cache', 'deploy']) OR schema_ref IS NOT NULL THEN 'semantic' ELSE 'episodic' END"""


def domain() -> Column:
    has = lambda *ws: F.arrays_overlap("tags", F.array(*map(F.lit, ws)))
    return (
        F.when(has("reflection", "self", "meta"), "reflection").when(has("preference", "workflow", "style", "habit", "rule") | (F.col("replay_count") >= 4), "procedural")
        .when(has("fact", "knowledge", "schema", "cache", "deploy") | F.col("schema_ref").isNotNull(), "semantic").otherwise("episodic")
    )


@query(S.over(S.MEM, then=f"""SELECT domain, quarter, month, count(*) AS n FROM (SELECT {_DOMAIN} AS domain, year(to_timestamp(created_at)) || '_Q' || quarter(to_timestamp(created_at)) AS quarter, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m') AS month FROM mem) GROUP BY ROLLUP (domain, quarter, month)"""))
def shard_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors by inferred domain and time bucket, with subtotals: the layout of the sharded store."""
    ts = F.timestamp_seconds("created_at")
    a = memory.anchors(spark, folder).select(domain().alias("domain"), F.concat(F.year(ts), F.lit("_Q"), F.quarter(ts)).alias("quarter"), F.date_format(ts, "yyyy-MM").alias("month"))
    return a.rollup("domain", "quarter", "month").agg(F.count("*").alias("n"))


@query("""SELECT r_name AS global, n_name AS domain, count(*) AS leaves, round(avg(c_acctbal), 6) AS importance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def hub_hierarchy_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves and mean weight at each level of a three-level hierarchy."""
    c = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = c.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("global"), F.col("n_name").alias("domain"), "c_acctbal")
    return j.rollup("global", "domain").agg(F.count("*").alias("leaves"), r6(F.avg("c_acctbal"), "importance"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type by the hour."""
    return windows.tumbling(table(spark, folder, "events")).select("start", "event_type", "n", r6("total", "total"))


@query("""SELECT start, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS start FROM events) GROUP BY 1""")
def events_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Events in windows of six hours, every three hours."""
    return windows.sliding(table(spark, folder, "events")).select("start", "n", r6("total", "total"))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def events_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of every user: events with less than two hours between them."""
    return windows.sessions(table(spark, folder, "events"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def events_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of every user, type and content."""
    return windows.deduplicated(table(spark, folder, "events"), "user_id", "event_type", "props").select("event_id")


@query("SELECT event_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap >= INTERVAL 3600 SECOND")
def events_debounced(spark: SparkSession, folder: str) -> DataFrame:
    """Events that do not follow one of the same user and type within an hour."""
    return windows.debounced(table(spark, folder, "events"), 3600, "user_id", "event_type").select("event_id")


@query("""SELECT user_id, count(*) FILTER (recent >= 2) AS promoted, count(*) AS n FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events) GROUP BY 1""")
def access_promotions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each user's items are promoted: two accesses within a day."""
    scratch = Scratch(spark, "accesses")
    e = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    placed = scratch.keep(ordered.with_position(e, ["user_id"], ["at", "event_id"], scratch))
    before = scratch.keep(ordered.beside(placed, ["user_id"], "position", ["at"], -1, "before"))
    rows = ordered.beside(before, ["user_id"], "position", ["at"], 1, "after")
    # a day before it, or at the same time
    again = F.coalesce(F.col("at") - F.col("before_at") <= 86_400_000_000, F.lit(False)) | F.coalesce(F.col("after_at") == F.col("at"), F.lit(False))
    return rows.groupBy("user_id").agg(F.count_if(again).alias("promoted"), F.count("*").alias("n"))


@query("""SELECT session, tag, n, CASE WHEN n >= 2 THEN text || ' (+' || (n - 1) || ' related)' ELSE text END AS text, round(importance, 6) AS importance FROM (SELECT user_id % 50 AS session, event_type AS tag, count(*) AS n, arg_max('item ' || event_id, (value, event_id)) AS text, avg(value / 500.0) AS importance FROM events GROUP BY 1, 2)""")
def stream_promotion(spark: SparkSession, folder: str) -> DataFrame:
    """What a flush of the ingest buffer promotes, with events as items."""
    e = table(spark, folder, "events").select((F.col("user_id") % 50).alias("session"), F.col("event_type").alias("tag"), F.col("event_id").alias("item_id"), F.concat(F.lit("item "), "event_id").alias("text"), (F.col("value") / 500.0).alias("importance"))
    # value / 500 keeps the order of value
    return windows.promoted(e).select("session", "tag", "n", "text", r6("importance", "importance"))


@query(S.over(S.MEM, then="SELECT floor(semantic * 10) / 10.0 AS band, count(*) AS n, round(avg(stability), 6) AS stability FROM (SELECT 1.0 - hippocampal_dependency AS semantic, stability FROM mem) GROUP BY 1"))
def density_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors and stability by bands of cortical independence."""
    a = memory.anchors(spark, folder).select((1.0 - F.col("hippocampal_dependency")).alias("semantic"), "stability")
    return a.groupBy((F.floor(F.col("semantic") * 10) / 10.0).alias("band")).agg(F.count("*").alias("n"), r6(F.avg("stability"), "stability"))
