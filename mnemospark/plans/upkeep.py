"""Further queries: ranking with reasons, merging of channels, sessions in batches, boosts, caches, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators import drift, graph, ordered, search
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.graphs import _GRAPH, _lpa
from mnemospark.plans.pipelines import _PLANE, plane_score
from mnemospark.plans.texts import _DOCS, QUERY, _bm25
from mnemospark.plans.vectors import _Q, _VM, _cos, _query_vector, memories
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("""SELECT substr(sha256(t || s), 1, 16) AS new_id, id, length(left(t, 280)) AS n_chars, round(0.4 * 0.5 + 0.35 * least(1.0, length(t) / 200.0), 6) AS salience FROM (SELECT DISTINCT id, coalesce(text, '') AS t, coalesce(source_session, '') AS s FROM anchors WHERE id IS NOT NULL)""")
def anchor_create(spark: SparkSession, folder: str) -> DataFrame:
    """What creating each stored text anew would give: id by content, clipped text and salience."""
    a = table(spark, folder, "anchors").filter("id is not null").select("id", F.coalesce("text", F.lit("")).alias("t"), F.coalesce("source_session", F.lit("")).alias("s")).distinct()
    salience = 0.4 * 0.5 + 0.35 * F.least(F.lit(1.0), F.length("t") / 200.0)
    return a.select(F.substring(F.sha2(F.concat("t", "s"), 256), 1, 16).alias("new_id"), "id", F.length(F.substring("t", 1, 280)).cast("bigint").alias("n_chars"), r6(salience, "salience"))


@query(S.over(S.MEM, f"k AS (SELECT id, greatest(1, length(text) // 4) AS tokens, row_number() OVER (ORDER BY round({S.RETENTION}, 9) DESC, id)::INTEGER AS rank FROM mem WHERE state <> 'ghost')",
    then="SELECT id, rank, tokens, total FROM (SELECT *, sum(tokens) OVER (ORDER BY rank)::BIGINT AS total FROM k WHERE rank <= 24) WHERE total <= 400"))
def retrieval_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The best 24 memories as far as their texts fit into 400 tokens of four characters (a top-k report)."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable())
    top = search.ranked(a.select("id", decay.retention(AS_OF).alias("score")), 24).join(a.select("id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint").alias("tokens")), "id")
    total = F.sum("tokens").over(W.orderBy("rank"))
    return top.withColumn("total", total).filter("total <= 400").select("id", "rank", "tokens", "total")


@query(S.over(S.MEM, "b AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY created_at, id) - 1) // 8 AS batch, created_at, importance FROM mem)",
    then="SELECT session, batch, round(max(created_at) - min(created_at), 6) AS span, round(avg(importance), 6) AS importance FROM b GROUP BY 1, 2 HAVING count(*) = 8 AND max(created_at) - min(created_at) <= 864000"))
def message_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's messages in whole batches of eight within ten days."""
    a = memory.anchors(spark, folder).select("session", "created_at", "id", "importance")
    placed = ordered.with_position(a, ["session"], ["created_at", "id"], Scratch(spark, "batches"))
    b = placed.withColumn("batch", F.floor((F.col("position") - 1) / 8).cast("bigint"))
    span = F.max("created_at") - F.min("created_at")
    g = b.groupBy("session", "batch").agg(F.count("*").alias("n"), span.alias("s"), F.avg("importance").alias("i"))
    return g.filter("n = 8 and s <= 864000").select("session", "batch", r6("s", "span"), r6("i", "importance"))


@query(S.over(S.MEM, then="SELECT id, round(1.0 - (1.0 - importance) * pow(0.97, least(replay_count, 10)), 6) AS importance FROM mem"))
def evolve_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Importance after boosts for up to ten replays, in closed form."""
    return memory.anchors(spark, folder).select("id", r6(1.0 - (1.0 - F.col("importance")) * F.pow(F.lit(0.97), F.least("replay_count", F.lit(10))), "importance"))


@query(S.over(S.LINKS, S.PAIRS, S.BOTH, S.MEM, "s AS (SELECT node, exp(sum(ln(1.0 - 0.3 * weight))) AS f, count(*) AS n FROM both_ways WHERE edge_type IN ('contradicts', 'conflicts_with', 'invalidated_by') GROUP BY 1)", then="SELECT id, n, round(greatest(0.1, f), 6) AS factor FROM s JOIN mem ON id = node"))
def suppression_product(spark: SparkSession, folder: str) -> DataFrame:
    """How much contradicting memories suppress each anchor, not below a tenth."""
    both = memory.both_ways(memory.pairs(memory.edges(spark, folder))).filter(F.col("edge_type").isin("contradicts", "conflicts_with", "invalidated_by"))
    s = both.groupBy(F.col("node").alias("id")).agg(F.product(1.0 - 0.3 * F.col("weight")).alias("f"), F.count("*").alias("n"))
    return s.join(memory.anchors(spark, folder).select("id"), "id").select("id", "n", r6(F.greatest(F.lit(0.1), "f"), "factor"))


@query(S.over(S.LINKS, S.PAIRS, S.MEM, then="""SELECT lo, hi, round(0.3 * shared + 0.2, 6) AS competition FROM (SELECT lo, hi, CASE WHEN len(a.tags) = 0 OR len(b.tags) = 0 THEN 0.0 ELSE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))::DOUBLE END AS shared
    FROM pairs JOIN mem a ON a.id = lo JOIN mem b ON b.id = hi) WHERE 0.3 * shared + 0.2 > 0.2"""))
def tag_competition(spark: SparkSession, folder: str) -> DataFrame:
    """Linked memories that compete because they share tags."""
    a = memory.anchors(spark, folder).select("id", "tags")
    p = memory.pairs(memory.edges(spark, folder)).select("lo", "hi").join(a.toDF("lo", "ta"), "lo").join(a.toDF("hi", "tb"), "hi")
    c = 0.3 * T.jaccard(F.col("ta"), F.col("tb")) + 0.2
    return p.select("lo", "hi", c.alias("c")).filter("c > 0.2").select("lo", "hi", r6("c", "competition"))


@query(S.over(S.MEM, S.LINKS, S.PAIRS, "n AS (SELECT id, lead(id) OVER (PARTITION BY session ORDER BY created_at, id) AS nxt FROM mem WHERE session <> '')", then="SELECT lo, hi, count(*) AS used, round(least(1.0, any_value(weight) + 0.03 * count(*)), 6) AS weight FROM n JOIN pairs ON lo = least(id, nxt) AND hi = greatest(id, nxt) GROUP BY 1, 2"))
def chain_success(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between consecutive memories of a session, strengthened once for each use."""
    a = memory.anchors(spark, folder).filter("session <> ''").select("session", "created_at", "id")
    nxt = ordered.with_next(a, ["session"], ["created_at", "id"], ["id"], Scratch(spark, "chain")).filter("next_id is not null")
    steps = nxt.select(F.least("id", "next_id").alias("lo"), F.greatest("id", "next_id").alias("hi"))
    used = steps.groupBy("lo", "hi").agg(F.count("*").alias("used"))
    return memory.pairs(memory.edges(spark, folder)).join(used, ["lo", "hi"]).select("lo", "hi", "used", r6(F.least(F.lit(1.0), F.col("weight") + 0.03 * F.col("used")), "weight"))


@query(S.over(S.MEM, S.LINKS, S.PAIRS, S.BOTH, "d AS (SELECT node, count(*) AS n FROM both_ways GROUP BY 1)", f"c AS (SELECT id, 0.25 * confidence + 0.25 * exp(-{S.hours('last_at')} / 168.0) + 0.3 * {S.RETENTION} + 0.2 * coalesce(n, 0) / (SELECT max(n) FROM d) AS s FROM mem LEFT JOIN d ON node = id WHERE state <> 'ghost')",
    then="SELECT id, round(s, 6) AS score FROM c ORDER BY round(s, 9) DESC, id LIMIT 25"))
def composite_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 best by confidence, recency, retention and degree (a top-k report)."""
    degree = memory.both_ways(memory.pairs(memory.edges(spark, folder))).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("n"))
    most = degree.agg(F.max("n")).first()[0] or 1
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).join(degree, "id", "left")
    s = 0.25 * F.col("confidence") + 0.25 * F.exp(-decay.hours("last_at", AS_OF) / 168.0) + 0.3 * decay.retention(AS_OF) + 0.2 * F.coalesce("n", F.lit(0)) / float(most)
    return search.ranked(a.select("id", s.alias("score")), 25).select("id", r6("score", "score"))


@query(S.over(_VM, _Q, then=f"SELECT id, round(s, 6) AS score FROM (SELECT id, ({_cos('e', 'qe')} + 0.2 * CASE WHEN label = 3 THEN 1 ELSE 0 END + 0.1 * abs(emotional_valence)) AS s FROM vm CROSS JOIN q) WHERE s > 0.02 ORDER BY round(s, 9) DESC, id LIMIT 10"))
def discover_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The ten seeds by similarity, session and emotion (a top-k report)."""
    s = V.cosine(F.col("embedding"), _query_vector(spark, folder)) + 0.2 * F.when(F.col("label") == 3, 1).otherwise(0) + 0.1 * F.abs("emotional_valence")
    return search.ranked(memories(spark, folder).select("id", s.alias("score")).filter("score > 0.02"), 10).select("id", r6("score", "score"))


_CHANNELS = (S.MEM, _bm25("SELECT id, text FROM mem WHERE state <> 'ghost'"), "a AS (SELECT id, 1.0 - exp(-score / 1.5) AS s FROM bm ORDER BY round(1.0 - exp(-score / 1.5), 9) DESC, id LIMIT 50)", f"b AS (SELECT id, {_PLANE} AS s FROM mem WHERE state <> 'ghost' ORDER BY round({_PLANE}, 9) DESC, id LIMIT 50)")


@query(S.over(*_CHANNELS, then="SELECT id, CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN 'both' WHEN a.s IS NOT NULL THEN 'fast' ELSE 'slow' END AS channel, round(CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN greatest(a.s, b.s) * 1.15 ELSE coalesce(a.s, b.s) END, 6) AS score FROM a FULL JOIN b USING (id)"))
def dual_channel_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The fast and the slow channel merged: the better score, more where both agree."""
    live = memory.anchors(spark, folder).filter(decay.is_retrievable())
    a = search.ranked(search.bm25(live.select("id", "text"), QUERY).select("id", (1.0 - F.exp(-F.col("score") / 1.5)).alias("score")), 50).select("id", F.col("score").alias("a"))
    b = search.ranked(live.select("id", plane_score().alias("score")), 50).select("id", F.col("score").alias("b"))
    agree = F.col("a").isNotNull() & F.col("b").isNotNull()
    score = F.when(agree, F.greatest("a", "b") * 1.15).otherwise(F.coalesce("a", "b"))
    channel = F.when(agree, "both").when(F.col("a").isNotNull(), "fast").otherwise("slow")
    return a.join(b, "id", "full").select("id", channel.alias("channel"), r6(score, "score"))


_QTERMS = "['" + "', '".join(sorted(search.query_tokens(QUERY))) + "']"


@query(S.over(_bm25(_DOCS), then=f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(toks, lambda x: list_contains({_QTERMS}, x)))), ' ') AS terms, concat_ws(' + ', CASE WHEN score > 3 THEN 'strong keywords' WHEN score > 1 THEN 'keywords' ELSE 'weak keywords' END, CASE WHEN dl < 30 THEN 'short text' END) AS reasons FROM bm JOIN bd USING (id)"""))
def trace_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why each document matched: the matched terms and the reasons in words."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = search.bm25(docs, QUERY).join(docs.select("id", T.tokens("text").alias("toks")), "id")
    terms = F.array_sort(F.array_distinct(F.filter("toks", lambda x: x.isin(*search.query_tokens(QUERY)))))
    reasons = F.concat_ws(" + ", F.when(F.col("score") > 3, "strong keywords").when(F.col("score") > 1, "keywords").otherwise("weak keywords"), F.when(F.size("toks") < 30, "short text"))
    return hits.select("id", F.array_join(terms, " ").alias("terms"), reasons.alias("reasons"))


@query(S.over(S.MEM, *_GRAPH, _lpa(4), "t AS (SELECT label, tag, count(*) AS n FROM (SELECT label, unnest(tags) AS tag FROM lab4 JOIN mem ON id = node) GROUP BY 1, 2)", then="SELECT label, string_agg(tag, ',' ORDER BY n DESC, tag) AS topic FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, tag) AS rn FROM t) WHERE rn <= 3 GROUP BY 1"))
def community_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The three commonest tags of every community."""
    both = Scratch(spark, "graph").keep(memory.both_ways(memory.pairs(memory.edges(spark, folder))))
    labels = graph.label_propagation(both, 4).withColumnRenamed("node", "id")
    t = labels.join(memory.anchors(spark, folder).select("id", F.explode("tags").alias("tag")), "id").groupBy("label", "tag").agg(F.count("*").alias("n"))
    top = t.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "tag"))).filter("rn <= 3")
    return top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tag"))), lambda x: x["tag"]), ",").alias("topic"))


@query(S.over(*_GRAPH, _lpa(4), "a AS (SELECT label, count(*) AS n FROM lab2 GROUP BY 1)", "b AS (SELECT label, count(*) AS n FROM lab4 GROUP BY 1)", "c AS (SELECT x.label AS old, y.label AS new, count(*) AS n FROM lab2 x JOIN lab4 y USING (node) GROUP BY 1, 2)",
    then="SELECT old, new, round(c.n / (a.n + b.n - c.n)::DOUBLE, 6) AS jaccard FROM c JOIN a ON a.label = old JOIN b ON b.label = new WHERE c.n / (a.n + b.n - c.n)::DOUBLE > 0.4"))
def community_match(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of two runs that are the same: more than 0.4 of their members in common."""
    both = Scratch(spark, "graph").keep(memory.both_ways(memory.pairs(memory.edges(spark, folder))))
    x, y = graph.label_propagation(both, 2).toDF("node", "old"), graph.label_propagation(both, 4).toDF("node", "new")
    c = x.join(y, "node").groupBy("old", "new").agg(F.count("*").alias("n"))
    j = c.join(x.groupBy("old").agg(F.count("*").alias("na")), "old").join(y.groupBy("new").agg(F.count("*").alias("nb")), "new")
    return j.select("old", "new", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j")).filter("j > 0.4").select("old", "new", r6("j", "jaccard"))


@query(S.over(S.MEM, f"k AS (SELECT 'tag:' || unnest(tags) AS key, id, round({S.RETENTION}, 9) AS r FROM mem)", then="SELECT key, id, round(0.95 + 0.05 * r, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC, id) AS rn FROM k) WHERE rn <= 5"))
def exact_match_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five entries for each exact-match key."""
    k = memory.anchors(spark, folder).select(F.explode("tags").alias("tag"), "id", F.round(decay.retention(AS_OF), 9).alias("r"))
    rn = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("r"), "id"))
    return k.withColumn("rn", rn).filter("rn <= 5").select(F.concat(F.lit("tag:"), "tag").alias("key"), "id", r6(0.95 + 0.05 * F.col("r"), "score"))


@query(S.over(S.MEM, then="SELECT id FROM mem WHERE list_contains(tags, 'memory') AND importance >= 0.5 AND emotional_valence > 0 ORDER BY created_at DESC, id LIMIT 20"))
def contextual_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 20 memories that meet all conditions of a context (a top-k report)."""
    a = memory.anchors(spark, folder).filter(F.array_contains("tags", "memory") & (F.col("importance") >= 0.5) & (F.col("emotional_valence") > 0))
    return a.orderBy(F.desc("created_at"), "id").limit(20).select("id")


_DOMAINS = (("technical", "cache", 1), ("technical", "deploy", 2), ("technical", "schema", 3), ("personal", "garden", 1), ("personal", "rent", 2), ("mind", "memory", 1), ("mind", "sleep", 2))


@query(S.over(S.MEM, "dom AS (SELECT * FROM (VALUES " + ", ".join(map(str, _DOMAINS)) + ") d(domain, word, depth))", "h AS (SELECT id, domain, sum(1 + 0.3 * depth)::DOUBLE AS s FROM mem JOIN dom ON contains(array_to_string(tags, ' ') || ' ' || lower(text), word) GROUP BY 1, 2)",
    then="SELECT id, domain, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, domain) AS rn FROM h) WHERE rn = 1"))
def domain_route(spark: SparkSession, folder: str) -> DataFrame:
    """The domain whose keywords speak most for each memory, deeper ones more."""
    text = F.concat_ws(" ", F.array_join("tags", " "), F.lower("text"))
    score: dict[str, Column] = {}
    for d, w, depth in _DOMAINS:
        score[d] = score.get(d, F.lit(0.0)) + F.when(F.contains(text, F.lit(w)), 1 + 0.3 * depth).otherwise(0.0)
    # the greatest score first, then the first name
    best = F.array_max(F.array(*[F.struct(F.round(s, 9).alias("s"), F.lit(-i).alias("i"), F.lit(d).alias("domain")) for i, (d, s) in enumerate(sorted(score.items(), key=lambda x: x[0]))]))
    return memory.anchors(spark, folder).select("id", best.alias("b")).filter("b.s > 0").select("id", "b.domain", r6("b.s", "score"))


@query("""SELECT month, n, n - coalesce(lag(n) OVER (ORDER BY month), 0) AS growth, sum(n) OVER (ORDER BY month)::BIGINT AS total FROM (SELECT strftime(first_at, '%Y-%m') AS month, count(*) AS n FROM (SELECT id, min(loaded_at) AS first_at FROM anchors WHERE id IS NOT NULL GROUP BY 1) GROUP BY 1)""")
def load_growth(spark: SparkSession, folder: str) -> DataFrame:
    """New anchors of every load month, their growth and running total (a window over the few months)."""
    first = table(spark, folder, "anchors").filter("id is not null").groupBy("id").agg(F.min("loaded_at").alias("at"))
    m = first.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    w = W.orderBy("month")
    return m.select("month", "n", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("growth"), F.sum("n").over(w).alias("total"))


@query("""SELECT user_id, event_type, CASE WHEN n >= 3 AND mean > 250 THEN 'promote' WHEN n >= 3 THEN 'consolidate' WHEN idle > 86400 THEN 'evict' ELSE 'keep' END AS decision FROM (SELECT user_id, event_type, count(*) AS n, avg(value) AS mean, date_diff('second', max(ts), (SELECT max(ts) FROM events)) AS idle FROM events GROUP BY 1, 2)""")
def buffer_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What happens to each user's buffered items of a type: promote, consolidate, evict or keep."""
    e = table(spark, folder, "events")
    last = e.agg(F.max("ts")).first()[0]
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max("ts").alias("at"))
    seconds = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000)
    idle = seconds(F.lit(last)) - seconds(F.col("at"))
    decision = F.when((F.col("n") >= 3) & (F.col("m") > 250), "promote").when(F.col("n") >= 3, "consolidate").when(idle > 86400, "evict").otherwise("keep")
    return g.select("user_id", "event_type", decision.alias("decision"))


@query(S.over(S.MEM, S.LINKS, S.PAIRS, then="SELECT (SELECT count(*) FROM mem) AS anchors, (SELECT count(*) FROM pairs) AS edges, round((SELECT count(*) FROM mem) / 100.0 * (0.5 + 0.3 + 0.1 + 0.2) + (SELECT count(*) FROM pairs) / 100.0 * 0.05, 6) AS seconds"))
def cost_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """What a consolidation is estimated to take, by the numbers of anchors and edges."""
    a = memory.anchors(spark, folder).agg(F.count("*").alias("anchors"))
    p = memory.pairs(memory.edges(spark, folder)).agg(F.count("*").alias("edges"))
    both = a.withColumn("k", F.lit(1)).join(p.withColumn("k", F.lit(1)), "k")
    return both.select("anchors", "edges", r6(F.col("anchors") / 100.0 * (0.5 + 0.3 + 0.1 + 0.2) + F.col("edges") / 100.0 * 0.05, "seconds"))


@query()
def state_timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Transitions of the recorded state histories with their number and mean duration in hours."""
    h = table(spark, folder, "anchors").select("id", "state_history_json").distinct().select("id", drift.history("state_history_json").alias("h"))
    steps = F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.struct(F.col("h")[i].alias("a"), F.col("h")[i + 1].alias("b")))
    s = h.filter(F.size("h") >= 2).select(F.explode(steps).alias("s"))
    return s.groupBy(F.col("s.a.state").alias("old"), F.col("s.b.state").alias("new")).agg(F.count("*").alias("n"), r6(F.avg((F.col("s.b.at") - F.col("s.a.at")) / 3600.0), "hours"))


@query()
def replay_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the recent memories drawn by priority without replacement, the same in every run (a sampling operator)."""
    a = memory.anchors(spark, folder).filter(decay.hours("last_at", AS_OF) < 720)
    p = F.greatest(F.lit(1e-6), F.abs("emotional_valence") * 0.25 + F.col("surprise") * 0.25 + F.col("frequency") * 0.20 + F.abs(1.0 - F.col("stability")) * 0.15)
    # weighted sampling by the greatest of u to the power of 1 / weight
    u = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) + 1) / 1_000_004.0
    keyed = a.select("id", (F.log(u) / p).alias("key"), p.alias("p"))
    placed = ordered.with_position(keyed, [], [F.desc("key"), F.col("id")], Scratch(spark, "sample"))
    return placed.filter(F.col("position") <= max(1, a.count() // 3)).select("id", r6("p", "priority"))
