"""Queries on texts: keyword search, write gate, and what texts say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import decay
from mnemospark.functions import text as T
from mnemospark.operators import search
from mnemospark.plans import base_sql as S
from mnemospark.plans.catalogue import Catalogue, r6
from mnemospark.sources import memory
from mnemospark.sources.memory import AS_OF
from mnemospark.sources.tables import table

CATALOGUE = Catalogue()
query = CATALOGUE.query

QUERY = "the recall path and the sleep cycle lost two anchors in the recall path"
_TOK = f"regexp_extract_all(lower(text), '{T.TOKEN}')"


def _quoted(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _bm25(docs: str) -> str:
    wanted = search.query_tokens(QUERY)
    values = ", ".join(f"('{w}', {n})" for w, n in wanted.items())
    return f"""bd AS MATERIALIZED (SELECT id, toks, len(toks) AS dl FROM (SELECT id, {_TOK} AS toks FROM ({docs}) WHERE text IS NOT NULL AND text <> '')),
bq AS (SELECT * FROM (VALUES {values}) q(term, times)), bs AS (SELECT count(*) AS n, greatest(1.0, avg(dl)) AS avgdl FROM bd),
bp AS MATERIALIZED (SELECT id, dl, term, times, count(*) AS tf FROM (SELECT id, dl, unnest(toks) AS term FROM bd) JOIN bq USING (term) GROUP BY ALL), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY 1),
bm AS MATERIALIZED (SELECT id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM bp JOIN bf USING (term) CROSS JOIN bs GROUP BY 1)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"


@query(S.over(_bm25(_DOCS), then="SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 10"))
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that match a query best (a top-k report)."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.ranked(search.bm25(docs, QUERY), 10).select("id", r6("score", "score"))


@query(S.over(_bm25(_DOCS), then="SELECT id, round(score, 6) AS score FROM bm"))
def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The BM25 score of every document that matches."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, QUERY).select("id", r6("score", "score"))


@query(S.over(S.MEM, _bm25("SELECT id, text FROM mem"), f"""a AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm), b AS (SELECT id, row_number() OVER (ORDER BY round(r, 9) DESC, id) AS rank FROM (SELECT id, {S.RETENTION} AS r FROM mem))""",
    then="SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY 1"))
def bm25_rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 best by keywords and the 100 best by retention, fused by their ranks."""
    a = memory.anchors(spark, folder)
    by_text = search.ranked(search.bm25(a.select("id", "text"), QUERY), 100)
    by_retention = search.ranked(a.select("id", decay.retention(AS_OF).alias("score")), 100)
    return search.fuse([by_text, by_retention]).select("id", r6("score", "score"))


@query(S.over(S.MEM, _bm25("SELECT id, text FROM mem"), then="""SELECT id, round(s, 6) AS score FROM (SELECT id, 0.5 / (1.0 + exp(-score / 3.0)) + CASE WHEN session = 'sess-00-00007' THEN 0.15 ELSE 0.0 END + 0.05 * importance AS s FROM bm JOIN mem USING (id)) WHERE s > 0.01"""))
def raw_buffer_search(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword matches with a bonus for the session at hand and for importance."""
    a = memory.anchors(spark, folder)
    hits = search.bm25(a.select("id", "text"), QUERY).join(a.select("id", "session", "importance"), "id")
    s = 0.5 / (1.0 + F.exp(-F.col("score") / 3.0)) + F.when(F.col("session") == "sess-00-00007", 0.15).otherwise(0.0) + 0.05 * F.col("importance")
    return hits.select("id", s.alias("s")).filter("s > 0.01").select("id", r6("s", "score"))


@query(S.over(S.MEM, _bm25("SELECT id, text FROM mem"), then=f"""SELECT id, round(s, 6) AS score FROM (SELECT id, 0.80 * (1.0 - exp(-score / 1.5)) + 0.05 * len(list_intersect(tags, ['memory', 'sleep'])) + 0.1 * pow(0.5, {S.hours('created_at')} / 168.0) + 0.05 * importance AS s FROM bm JOIN mem USING (id))
    ORDER BY round(s, 9) DESC, id LIMIT 20"""))
def bm25_anchor_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 anchors that match best by keywords, tags, age and importance (a top-k report)."""
    a = memory.anchors(spark, folder)
    hits = search.bm25(a.select("id", "text"), QUERY).join(a.select("id", "tags", "created_at", "importance"), "id")
    s = (
        0.80 * (1.0 - F.exp(-F.col("score") / 1.5)) + 0.05 * F.size(F.array_intersect("tags", F.array(F.lit("memory"), F.lit("sleep"))))
        + 0.1 * F.pow(F.lit(0.5), decay.hours("created_at", AS_OF) / 168.0) + 0.05 * F.col("importance")
    )
    return search.ranked(hits.select("id", s.alias("score")), 20).select("id", r6("score", "score"))


_KW = f"list_sort(list_filter(list_distinct({_TOK}), lambda x: x NOT IN {_quoted(T.STOP_WORDS)}))"
_QKW = sorted(w for w in search.query_tokens(QUERY) if w not in T.STOP_WORDS)
_QL = "['" + "', '".join(_QKW) + "']"


@query(S.over(S.MEM, f"k AS (SELECT id, tags, {_KW} AS kw FROM mem)", then=f"""SELECT id, round(j, 6) AS jaccard FROM (SELECT id, CASE WHEN len(kw) = 0 THEN 0.0 ELSE len(list_intersect(kw, {_QL})) / len(list_distinct(list_concat(kw, {_QL})))::DOUBLE END AS j FROM k
    WHERE list_has_any(tags, ['memory', 'sleep-log', 'chat'])) WHERE j >= 0.08"""))
def symbolic_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors that share a tag with the query and enough of its keywords."""
    wanted = F.array(*map(F.lit, _QKW))
    a = memory.anchors(spark, folder).filter(F.arrays_overlap("tags", F.array(F.lit("memory"), F.lit("sleep-log"), F.lit("chat"))))
    return a.select("id", T.jaccard(T.keywords("text"), wanted).alias("j")).filter("j >= 0.08").select("id", r6("j", "jaccard"))


@query(S.over(S.MEM, f"t AS (SELECT session AS grp, {_TOK} AS toks FROM mem)", "n AS (SELECT grp, count(*) AS n FROM t GROUP BY 1)", """p AS (SELECT grp, term, count(*) AS tf, count(DISTINCT row) AS df FROM (SELECT grp, row, unnest(toks) AS term FROM (SELECT *, row_number() OVER () AS row FROM t)) GROUP BY 1, 2)""",
    then="""SELECT session, term, round(score, 6) AS score, rank FROM (SELECT grp AS session, term, score, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term)::INTEGER AS rank FROM (SELECT grp, term, round(tf * (ln((n + 1) / (df + 1)) + 1.0), 9) AS score FROM p JOIN n USING (grp))) WHERE rank <= 8"""))
def key_terms_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The eight terms that tell most about each session."""
    a = memory.anchors(spark, folder).select(F.col("session").alias("grp"), "text")
    return search.key_terms(a).select(F.col("grp").alias("session"), "term", r6("score", "score"), "rank")


def _contains(words) -> str:
    return " + ".join(f"CASE WHEN contains(low, '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for w in words)


_LIST = lambda ws: "['" + "', '".join(ws) + "']"
_NOISE = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN {s}" for p, s in T.NOISE) + f""" WHEN len(found) = 0 THEN 0.9 WHEN len(list_filter(found, lambda x: x IN {_quoted(T.FILLERS)})) / len(found) > 0.5 THEN 0.6
    ELSE least(1.0, greatest(0.0, 1.0 - len(found) / greatest(5, len(words)))) END"""


@query(S.over(S.MEM, r"g0 AS (SELECT id, trim(text) AS t, lower(trim(text)) AS low, importance, emotional_valence AS ev, tags, regexp_extract_all(lower(trim(text)), '[一-鿿]+|[a-z]{3,}') AS found, list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda x: x <> '') AS words FROM mem)",
    f"""g1 AS (SELECT *, {_NOISE} AS noise, CASE WHEN abs(ev) > 0.8 AND length(t) < 50 THEN 0.9 WHEN abs(ev) > 0.6 AND len(list_distinct(words)) / greatest(1, len(words)) < 0.3 AND len(words) < 30 THEN 0.8 ELSE abs(ev) * 0.5 END AS emo,
    {S.clip(f"CASE WHEN length(t) < 20 THEN importance * 0.5 WHEN length(t) > 100 THEN importance * 1.2 ELSE importance END * (1.0 + len(list_intersect(tags, {_LIST(T.HIGH_VALUE_TAGS)})) * 0.15) * (1.0 + least(0.5, ({_contains(T.SUBSTANCE)}) * 0.1))", 0.0, 1.0)} AS score FROM g0)""",
    then="""SELECT id, CASE WHEN t = '' THEN 'reject:empty_text' WHEN length(t) < 8 THEN 'reject:too_short' WHEN noise > 0.7 THEN 'reject:noise_pattern' WHEN emo > 0.85 THEN 'defer:emotional_noise' WHEN score < 0.05 THEN 'reject:too_low_importance'
    WHEN score < 0.15 THEN 'defer:low_importance' ELSE 'accept:passed' END AS decision, round(score, 6) AS importance FROM g1"""))
def write_gate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What the write gate would decide about every stored text."""
    c = F.col
    return memory.anchors(spark, folder).select(
        "id", T.gate(c("text"), c("importance"), c("emotional_valence"), c("tags")).alias("decision"), r6(T.write_importance(F.trim("text"), c("importance"), c("tags")), "importance")
    )


@query(S.over(S.MEM, then=f"""SELECT id, CASE WHEN list_contains(tags, 'working') THEN 'working' WHEN state = 'active' AND replay_count = 0 AND stability < 0.2 AND len(tags) = 0 THEN 'working'
    WHEN list_has_any(tags, ['preference', 'style', 'habit', 'convention', 'pattern', 'workflow', 'rule']) OR replay_count >= 4 OR hippocampal_dependency < 0.4 THEN 'procedural'
    WHEN list_has_any(tags, ['fact', 'knowledge', 'tech-stack', 'config', 'setup', 'infra', 'architecture', 'definition', 'reference']) OR stability > 0.4 OR schema_ref IS NOT NULL THEN 'semantic' ELSE 'episodic' END AS kind FROM mem"""))
def memory_type(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of every memory."""
    return memory.anchors(spark, folder).select("id", T.memory_type().alias("kind"))


_VOTES = ", ".join("(" + " + ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN 1 ELSE 0 END" for p in ps) + f") AS v{i}" for i, ps in enumerate(T.CAUSAL.values()))
_MOST = "greatest(" + ", ".join(f"v{i}" for i in range(len(T.CAUSAL))) + ")"


@query(S.over(S.MEM, S.LINKS, S.PAIRS, f"cv AS (SELECT lo, hi, {_VOTES} FROM (SELECT lo, hi, lower(a.text || ' ' || b.text) AS low FROM pairs JOIN mem a ON a.id = lo JOIN mem b ON b.id = hi))",
    then="SELECT lo, hi, CASE " + " ".join(f"WHEN v{i} = {_MOST} THEN '{k}'" for i, k in enumerate(T.CAUSAL)) + f" END AS relation, round(CASE WHEN {_MOST} = 0 THEN 0.1 ELSE least(0.9, 0.3 + {_MOST} * 0.15) END, 6) AS confidence FROM cv"))
def causal_vote(spark: SparkSession, folder: str) -> DataFrame:
    """The causal relation that the texts of both ends of every edge speak for."""
    a = memory.anchors(spark, folder).select("id", "text")
    p = memory.pairs(memory.edges(spark, folder)).select("lo", "hi").join(a.toDF("lo", "ta"), "lo").join(a.toDF("hi", "tb"), "hi")
    kind, confidence = T.causal_vote(F.concat_ws(" ", "ta", "tb"))
    return p.select("lo", "hi", kind.alias("relation"), r6(confidence, "confidence"))


def _extracted(patterns) -> str:
    return " UNION ALL ".join(f"SELECT id, unnest(regexp_extract_all(text, '{p}', 1)) AS found, {c} AS confidence FROM mem WHERE state <> 'ghost'" for p, c in patterns)


@query(S.over(S.MEM, f"x AS ({_extracted(T.GOALS)})", then="SELECT left(trim(found), 120) AS goal, max(confidence)::DOUBLE AS confidence, count(DISTINCT id) AS anchors FROM x GROUP BY 1"))
def goal_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Goals that texts state, with the best confidence and how many anchors state them."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable())
    hits = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: F.struct(F.substring(F.trim(x), 1, 120).alias("goal"), F.lit(c).alias("confidence"))) for p, c in T.GOALS]))
    return a.select("id", F.explode(hits).alias("g")).groupBy("g.goal").agg(F.max("g.confidence").alias("confidence"), F.countDistinct("id").alias("anchors"))


@query(S.over(S.MEM, f"x AS ({_extracted([(p, 0) for p in T.BELIEFS])})", then="SELECT lower(trim(found)) AS topic, count(*) AS n, count(DISTINCT id) AS anchors FROM x GROUP BY 1"))
def belief_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Beliefs about the user that texts state."""
    a = memory.anchors(spark, folder).filter(decay.is_retrievable())
    hits = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in T.BELIEFS])
    return a.select("id", F.explode(hits).alias("b")).groupBy(F.lower(F.trim("b")).alias("topic")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("anchors"))


_CHANGED = "CASE " + " ".join(f"WHEN contains(low, '{w}') THEN '{w}'" for w in T.CHANGE) + " END"


@query(S.over(S.MEM, r"f0 AS (SELECT id, text, lower(text) AS low, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+')) AS names FROM mem)", f"""f1 AS (SELECT id, CASE WHEN ({_contains(T.PREFERENCE)}) > 0 THEN 'preference' WHEN {_CHANGED} IS NOT NULL THEN 'change' WHEN ({_contains(T.OUTCOME)}) > 0 THEN 'outcome' WHEN len(names) >= 2 THEN 'relationship' END AS k, {_CHANGED} AS ch, names FROM f0)""",
    then="""SELECT id, CASE k WHEN 'preference' THEN 'User' WHEN 'relationship' THEN names[1] ELSE 'System' END AS subject, CASE k WHEN 'preference' THEN 'prefers' WHEN 'change' THEN ch WHEN 'outcome' THEN 'resulted_in' ELSE 'met_with' END AS predicate,
    CASE k WHEN 'preference' THEN 'preference' WHEN 'relationship' THEN 'relationship' ELSE 'event' END AS kind, CASE k WHEN 'preference' THEN 0.6 WHEN 'change' THEN 0.65 WHEN 'outcome' THEN 0.55 ELSE 0.5 END::DOUBLE AS confidence FROM f1 WHERE k IS NOT NULL"""))
def fact_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The fact that each text states, by wording rules."""
    return memory.anchors(spark, folder).select("id", T.fact(F.col("text")).alias("f")).filter("f is not null").select("id", "f.subject", "f.predicate", "f.kind", "f.confidence")


@query(S.over(S.MEM, f"w AS (SELECT id, tags, {_TOK} AS toks FROM mem)", f"""k AS (SELECT id, unnest(list_transform(list_filter(tags, lambda t: length(t) > 2), lambda t: 'tag:' || replace(t, ' ', '_'))) AS key, 0.6 AS confidence FROM w
    UNION ALL SELECT id, list_filter(toks, lambda x: length(x) > 2)[1] || '-' || list_filter(toks, lambda x: length(x) > 2)[2], 0.4 FROM w WHERE len(list_filter(tags, lambda t: length(t) > 2)) = 0 AND len(list_filter(toks, lambda x: length(x) > 2)) >= 2)""",
    then="SELECT id, key, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, key) AS rn FROM k) WHERE rn <= 5"))
def entity_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five exact-match keys of each anchor: its tags, else its first two words."""
    long_tags = F.transform(F.filter("tags", lambda t: F.length(t) > 2), lambda t: F.concat(F.lit("tag:"), F.replace(t, F.lit(" "), F.lit("_"))))
    words = F.filter(T.tokens("text"), lambda x: F.length(x) > 2)
    fallback = F.when(F.size(words) >= 2, F.array(F.concat_ws("-", F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    a = memory.anchors(spark, folder).select("id", long_tags.alias("t"), fallback.alias("w"))
    keys = F.when(F.size("t") > 0, F.slice(F.array_sort("t"), 1, 5)).otherwise(F.col("w"))
    return a.select("id", F.explode(keys).alias("key"), F.when(F.size("t") > 0, 0.6).otherwise(0.4).alias("confidence"))
