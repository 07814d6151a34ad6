"""DuckDB common table expressions for the memory model, written independently of the Spark plans."""

from __future__ import annotations

AS_OF = 1754006400.0
WS = "' ' || chr(9) || chr(10) || chr(13)"


def key(c: str) -> str:
    return f"nullif(lower(trim({c}, {WS})), '')"


def elements(c: str, field: str, wrapper: str) -> str:
    s = f"trim({c}, {WS})"
    return f"""CASE WHEN {c} IS NULL OR {s} = '' OR lower({s}) = 'null' THEN []::VARCHAR[]
        WHEN regexp_matches({s}, '^\\[\\s*\\{{') THEN json_extract_string({s}, '$[*].{field}')
        WHEN {s}[1] = '{{' THEN json_extract_string({s}, '$.{wrapper}[*]')
        WHEN {s}[1] = '[' AND json_valid({s}) THEN json_extract_string({s}, '$[*]')
        WHEN {s}[1] = '[' THEN json_extract_string(replace({s}, '''', '"'), '$[*]')
        ELSE string_split({s}, ',') END"""


def tags(c: str) -> str:
    return f"""list_sort(list_distinct(list_filter(list_transform({elements(c, 'tag', 'tags')},
        lambda x: trim(regexp_replace(lower(trim(x, {WS})), '^#', ''), {WS})), lambda x: x IS NOT NULL AND x <> '')))"""


def ids(c: str) -> str:
    return f"list_distinct(list_filter(list_transform({elements(c, 'id', 'ids')}, lambda x: lower(trim(x, {WS}))), lambda x: x IS NOT NULL AND x <> ''))"


def edge_types(c: str) -> str:
    s = f"trim({c}, {WS})"
    return f"""list_distinct(list_filter(list_transform(CASE WHEN {c} IS NULL OR {s} = '' OR lower({s}) = 'null' THEN []::VARCHAR[]
        WHEN {s}[1] = '{{' THEN [json_extract_string({s}, '$.relation')]
        WHEN {s}[1] = '[' THEN json_extract_string({s}, '$[*]') ELSE [{s}] END,
        lambda x: regexp_replace(regexp_replace(lower(trim(x, {WS})), '^edgetype\\.', ''), '[\\s\\-]+', '_', 'g')), lambda x: x IS NOT NULL AND x <> ''))"""


def first_type(c: str) -> str:
    """The first relation name; list_distinct would not keep the order."""
    return edge_types(c).removeprefix("list_distinct(")[:-1] + "[1]"


def state(c: str) -> str:
    s = f"trim({c}, {WS})"
    raw = f"regexp_replace(lower(trim(CASE WHEN {s}[1] = '{{' THEN json_extract_string({s}, '$.name') ELSE {s} END, {WS})), '^memorystate\\.', '')"
    named = f"CASE {raw} WHEN '0' THEN 'active' WHEN '1' THEN 'rehearsing' WHEN '2' THEN 'consolidating' WHEN '3' THEN 'dormant' WHEN '4' THEN 'ghost' WHEN '5' THEN 'reactivated' ELSE {raw} END"
    return f"CASE WHEN ({named}) IN ('active','rehearsing','consolidating','dormant','ghost','reactivated') THEN ({named}) END"


def clip(x: str, low: float, high: float) -> str:
    return f"least({high}, greatest({low}, {x}))"


def case(column: str, of: dict, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in of.items()) + f" ELSE {default!r} END"


def hours(column: str) -> str:
    return f"greatest(0.0, ({AS_OF}::DOUBLE - {column}) / 3600.0)"


_V = ["importance", "frequency", "recency", "emotional_valence", "stability", "surprise", "hippocampal_dependency", "success_feedback", "confidence", "decay_rate"]
_D = [0.5, 0.0, 1.0, 0.0, 0.0, 0.5, 1.0, 0.5, 0.5, 0.01]


def _field(i: int, name: str, default: float) -> str:
    one = f"coalesce(v[{i}], {default})::DOUBLE"
    merged = {"surprise": 10, "importance": 11}.get(name)
    return (f"CASE WHEN len(v) >= 13 THEN greatest({one}, v[{merged}]) ELSE {one} END" if merged else one) + f" AS {name}"


#: mem: one row for each anchor id.
MEM = f"""mem AS MATERIALIZED (SELECT k AS id, coalesce(text, '') AS text, coalesce(source_session, '') AS session, {tags('tags_json')} AS tags,
    {key('schema_ref')} AS schema_ref, created_at, last_activated_at AS last_at, coalesce(replay_count, 0) AS replay_count,
    coalesce({state('state')}, 'active') AS state, {', '.join(_field(i + 1, n, d) for i, (n, d) in enumerate(zip(_V, _D, strict=True)))},
    {', '.join(f"coalesce(TRY_CAST(json_extract_string(oscillator_json, '$.{n}') AS DOUBLE), {d}) AS {n}" for n, d in (('natural_frequency', 0.5), ('phase_offset', 0.0), ('coupling_strength', 0.3), ('damping', 0.1)))}
    FROM (SELECT *, TRY_CAST(vector_json AS DOUBLE[]) AS v FROM (SELECT *, {key('id')} AS k, row_number() OVER (PARTITION BY {key('id')}
        ORDER BY loaded_at DESC NULLS LAST, last_activated_at DESC NULLS LAST, load_file DESC NULLS LAST, state DESC NULLS LAST) AS rn FROM anchors) WHERE rn = 1 AND k IS NOT NULL))"""

#: links: one row for each edge_id; pairs: one for each unordered pair; both: pairs from either end.
LINKS = f"""links AS MATERIALIZED (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi FROM (SELECT edge_id, {key('source')} AS src, {key('target')} AS dst, weight,
    coalesce({first_type('edge_type')}, 'topical') AS edge_type, co_activation_count AS co_count, created_at, coalesce(last_activated_at, created_at) AS last_at
    FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC NULLS LAST, load_file DESC NULLS LAST, weight DESC NULLS LAST) AS rn FROM edges WHERE edge_id IS NOT NULL) WHERE rn = 1)
    WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"""
PAIRS = """pairs AS MATERIALIZED (SELECT lo, hi, edge_type, weight, co_count, last_at, created_at, n_edges FROM (SELECT lo, hi, edge_type, weight,
    sum(co_count) OVER p AS co_count, max(last_at) OVER p AS last_at, min(created_at) OVER p AS created_at, count(*) OVER p AS n_edges,
    row_number() OVER (PARTITION BY lo, hi ORDER BY weight DESC, edge_id) AS rn FROM links WINDOW p AS (PARTITION BY lo, hi)) WHERE rn = 1)"""
BOTH = """both_ways AS MATERIALIZED (SELECT lo AS node, hi AS other, * EXCLUDE (lo, hi) FROM pairs UNION ALL SELECT hi, lo, * EXCLUDE (lo, hi) FROM pairs)"""
GHOSTS = f"""gone AS MATERIALIZED (SELECT k AS id, {tags('original_tags_json')} AS tags, pruned_at, coalesce(revival_count, 0) AS revival_count, coalesce(original_importance, 0.5) AS importance
    FROM (SELECT *, {key('id')} AS k, row_number() OVER (PARTITION BY {key('id')} ORDER BY pruned_at DESC NULLS LAST, original_importance DESC NULLS LAST) AS rn FROM ghosts) WHERE rn = 1 AND k IS NOT NULL)"""

STRENGTH = "(importance * 0.30 + stability * 0.25 + abs(emotional_valence) * 0.20 + frequency * 0.15 + confidence * 0.10)"
RELEVANCE = clip("importance * greatest(success_feedback, 0.01) * (1.0 + abs(emotional_valence) * 0.2)", 0.01, 1.0)
IMPORTANCE = clip("importance * 0.5 + abs(emotional_valence) * 0.25 + surprise * 0.25", 0.01, 1.0)
EBBINGHAUS = f"exp(-{hours('last_at')} / (1.0 + {STRENGTH} * 335.0))"
DECAY = f"greatest(0.01, {EBBINGHAUS} + (1.0 - {EBBINGHAUS}) * stability * 0.5)"
RETENTION = clip(
    f"pow(greatest(0.01, {RELEVANCE}) * greatest(0.01, recency) * greatest(0.01, frequency + 0.01) * greatest(0.01, success_feedback) * greatest(0.01, confidence), 0.2)"
    f" * CASE state WHEN 'rehearsing' THEN 1.3 WHEN 'ghost' THEN 0.3 WHEN 'reactivated' THEN 0.7 ELSE 1.0 END * {DECAY} * (1.0 + {IMPORTANCE} * 0.3)", 0.0, 1.0,
)
THERMAL = "CASE state WHEN 'active' THEN 'hot' WHEN 'rehearsing' THEN 'hot' WHEN 'reactivated' THEN 'hot' WHEN 'ghost' THEN 'dead' ELSE 'warm' END"


def over(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + then
