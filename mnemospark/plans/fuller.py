"""Queries that take vectors, order and whole months into account where others of the same kind look at tags and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators import graph, ordered, similarity
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.plans.rebuild import _over, _roots_sql, _vectors
from mnemospark.plans.recall import _VEC
from mnemospark.plans.vectors import _cos
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.store import Scratch

CATALOGUE = Catalogue()
query = CATALOGUE.query

_ONLY = _VEC.split(",\nvm AS")[0]


@query(S.over(S.MEM, _ONLY, "tv AS (SELECT tag, id, e, row_number() OVER (PARTITION BY tag ORDER BY stability DESC, id) AS rn, count(*) OVER (PARTITION BY tag) AS n FROM (SELECT unnest(tags) AS tag, id, stability FROM mem WHERE state <> 'ghost') JOIN vec USING (id))",
    then=f"SELECT x.tag, any_value(x.n) AS n, round(avg({_cos('x.e', 'y.e')}), 6) AS cohesion, avg({_cos('x.e', 'y.e')}) >= 0.6 AS schema FROM tv x JOIN tv y ON x.tag = y.tag AND x.rn < y.rn WHERE x.rn <= 3 AND y.rn <= 3 AND x.n >= 3 GROUP BY 1"))
def schema_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    """How alike the three most stable memories of every tag are, and whether they make a schema."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable()).select("id", "stability", F.explode("tags").alias("tag")).join(_vectors(spark, folder), "id")
    counts = a.groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 3")
    rn = F.row_number().over(W.partitionBy("tag").orderBy(F.desc("stability"), "id"))
    top = a.withColumn("rn", rn).filter("rn <= 3").groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "embedding"))), lambda x: x["embedding"]).alias("v"))
    v = F.col("v")
    pairs = F.array(*[V.cosine(v[i], v[j]) for i, j in ((0, 1), (0, 2), (1, 2))])
    mean = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 3.0
    return top.join(counts, "tag").select("tag", "n", mean.alias("m")).select("tag", "n", r6("m", "cohesion"), (F.col("m") >= 0.6).alias("schema"))


_NEAR = 0.55


@query(_over(S.MEM, _ONLY, f"sp AS MATERIALIZED (SELECT * FROM (SELECT x.id AS a, y.id AS b, {_cos('x.e', 'y.e')} AS cosine FROM (SELECT vec.*, session FROM vec JOIN mem USING (id)) x JOIN (SELECT vec.*, session FROM vec JOIN mem USING (id)) y ON x.session = y.session AND x.session <> '' AND x.id < y.id) WHERE cosine > {_NEAR})",
    _roots_sql("sc", "sp"), "sz AS (SELECT grp, count(*) AS n FROM sc GROUP BY 1 HAVING count(*) >= 3)",
    then="SELECT grp AS cluster, any_value(session) AS session, any_value(n) AS n, round(avg(importance), 6) AS importance, round(avg(emotional_valence), 6) AS valence, 0.85::DOUBLE AS stability FROM sz JOIN sc USING (grp) JOIN mem USING (id) GROUP BY 1"))
def session_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of three or more alike memories of one session, as the summary that stands for each."""
    a = memory.anchors(spark, folder).select("id", "session", "importance", "emotional_valence")
    s = Scratch(spark, "clusters").keep(_vectors(spark, folder).join(a.filter("session <> ''").select("id", "session"), "id"))
    p = similarity.alike_within(s, "session", _NEAR)
    groups = Scratch(spark, "clusters").keep(graph.components(p.select(F.col("a").alias("lo"), F.col("b").alias("hi")))).toDF("id", "cluster")
    g = groups.join(a, "id").groupBy("cluster").agg(F.min("session").alias("session"), F.count("*").alias("n"), F.avg("importance").alias("i"), F.avg("emotional_valence").alias("v"))
    return g.filter("n >= 3").select("cluster", "session", "n", r6("i", "importance"), r6("v", "valence"), F.lit(0.85).alias("stability"))


@query(S.over(S.MEM, "m AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY created_at, id) - 1) // 8 AS batch FROM mem)", "g AS (SELECT session, batch, count(*) AS n, max(created_at) - min(created_at) AS span, arg_max(id, (importance, id)) AS best, avg(importance) AS i, avg(stability) AS s FROM m GROUP BY 1, 2 HAVING count(*) = 8)",
    "k AS (SELECT session, batch, tag FROM (SELECT session, batch, tag, row_number() OVER (PARTITION BY session, batch ORDER BY count(*) DESC, tag) AS rn FROM (SELECT session, batch, unnest(tags) AS tag FROM m) GROUP BY 1, 2, 3) WHERE rn = 1)",
    then="SELECT session, batch, coalesce(tag, 'general') AS topic, best, round(span, 6) AS span, round(i, 6) AS importance, round(least(1.0, s + 0.2), 6) AS stability FROM g LEFT JOIN k USING (session, batch)"))
def layer_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of every session: eight messages in a row with their topic, the message that says most, span and means."""
    a = memory.anchors(spark, folder).select("session", "created_at", "id", "importance", "stability", "tags")
    m = Scratch(spark, "events").keep(ordered.with_position(a, ["session"], ["created_at", "id"], Scratch(spark, "events")).withColumn("batch", F.floor((F.col("position") - 1) / 8).cast("bigint")))
    at = ["session", "batch"]
    g = m.groupBy(*at).agg(F.count("*").alias("n"), (F.max("created_at") - F.min("created_at")).alias("span"), F.max_by("id", F.struct("importance", "id")).alias("best"), F.avg("importance").alias("i"), F.avg("stability").alias("s")).filter("n = 8")
    counts = m.select(*at, F.explode("tags").alias("tag")).groupBy(*at, "tag").agg(F.count("*").alias("k"))
    tops = counts.groupBy(*at).agg(F.min(F.struct((-F.col("k")).alias("least"), "tag"))["tag"].alias("tag"))
    return g.join(tops, at, "left").select(*at, F.coalesce("tag", F.lit("general")).alias("topic"), "best", r6("span", "span"), r6("i", "importance"), r6(F.least(F.lit(1.0), F.col("s") + 0.2), "stability"))


@query(S.over(S.MEM, _ONLY, S.LINKS, S.PAIRS, f"""c AS (SELECT lo, hi, CASE WHEN len(a.tags) = 0 OR len(b.tags) = 0 THEN 0.0 ELSE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))::DOUBLE END AS shared, {_cos('x.e', 'y.e')} AS cosine, a.importance AS ia, b.importance AS ib
    FROM pairs JOIN mem a ON a.id = lo JOIN mem b ON b.id = hi JOIN vec x ON x.id = lo JOIN vec y ON y.id = hi)""",
    then="SELECT CASE WHEN ia < ib OR (ia = ib AND lo > hi) THEN lo ELSE hi END AS loser, count(*) AS rivals, round(max(0.3 * shared + 0.5 * greatest(0.0, cosine) + 0.2), 6) AS strongest, round(exp(sum(ln(1.0 - 0.1 * (0.3 * shared + 0.5 * greatest(0.0, cosine) + 0.2)))), 6) AS factor FROM c WHERE 0.3 * shared + 0.5 * greatest(0.0, cosine) + 0.2 > 0.25 GROUP BY 1"))
def competition(spark: SparkSession, folder: str) -> DataFrame:
    """Linked memories that compete by tags, vectors and nearness; what the less important one of each pair keeps."""
    a = memory.anchors(spark, folder).select("id", "tags", "importance").join(_vectors(spark, folder), "id")
    p = memory.pairs(memory.edges(spark, folder)).select("lo", "hi").join(a.toDF("lo", "ta", "ia", "ea"), "lo").join(a.toDF("hi", "tb", "ib", "eb"), "hi")
    c = 0.3 * T.jaccard(F.col("ta"), F.col("tb")) + 0.5 * F.greatest(F.lit(0.0), V.cosine(F.col("ea"), F.col("eb"))) + 0.2
    loser = F.when((F.col("ia") < F.col("ib")) | ((F.col("ia") == F.col("ib")) & (F.col("lo") > F.col("hi"))), F.col("lo")).otherwise(F.col("hi"))
    rows = p.select(loser.alias("loser"), c.alias("c")).filter("c > 0.25")
    return rows.groupBy("loser").agg(F.count("*").alias("rivals"), r6(F.max("c"), "strongest"), r6(F.product(1.0 - 0.1 * F.col("c")), "factor"))


@query(S.over(S.MEM, f"mm AS (SELECT strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n, avg(stability) AS s, avg({S.RETENTION}) AS r, count(*) FILTER (state = 'ghost') / count(*)::DOUBLE AS lost FROM mem WHERE created_at IS NOT NULL GROUP BY 1)",
    then="SELECT month, n, round(s, 6) AS stability, round(r, 6) AS retention, round(lost, 6) AS lost, round(s - lag(s) OVER (ORDER BY month), 6) AS stability_change, round(r - lag(r) OVER (ORDER BY month), 6) AS retention_change FROM mm"))
def metrics_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Stability, retention and losses of the memories of every month beside those of the month before (a window over the few months)."""
    a = memory.anchors(spark, folder).filter("created_at is not null").select(F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM").alias("month"), "stability", decay.retention(AS_OF).alias("r"), (F.col("state") == "ghost").alias("g"))
    m = a.groupBy("month").agg(F.count("*").alias("n"), F.avg("stability").alias("s"), F.avg("r").alias("r"), (F.count_if("g") / F.count("*")).alias("lost"))
    w = W.orderBy("month")
    return m.select("month", "n", r6("s", "stability"), r6("r", "retention"), r6("lost", "lost"), r6(F.col("s") - F.lag("s").over(w), "stability_change"), r6(F.col("r") - F.lag("r").over(w), "retention_change"))
