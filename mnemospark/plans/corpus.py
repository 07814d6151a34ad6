"""Queries on references between tables (p3) and on drifting schemas (p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark import store
from mnemospark.operators import drift, orphans
from mnemospark.plans import base_sql as S
from mnemospark.sources.tables import table
from mnemospark.store import Scratch


def _memory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    anchors, schemas = table(spark, folder, "anchors"), table(spark, folder, "schemas")
    return orphans.memory_references(table(spark, folder, "edges"), anchors, schemas), orphans.memory_parents(anchors, schemas)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference whose record is missing or was loaded only after the reference, after batches of a quarter's loads."""
    references, parents = _memory(spark, folder)
    state = orphans.OrphanState.empty(spark)
    for _, state in orphans.periods(state, references, parents, store.empty(spark, orphans.PARENT), "quarter"):
        pass
    return orphans.orphans(state)


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """After each month: open and resolved orphans per table, field and load week, prunings included."""
    references, _ = _memory(spark, folder)
    parents = orphans.memory_arrivals(table(spark, folder, "anchors"), table(spark, folder, "schemas"))
    deletions = orphans.memory_deletions(table(spark, folder, "ghosts"))
    scratch, out = Scratch(spark, "p3-counts"), None
    for period, state in orphans.periods(orphans.OrphanState.empty(spark), references, parents, deletions):
        rows = scratch.keep(orphans.snapshot(state).select(F.lit(period).cast("timestamp").alias("as_of"), "*"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else orphans.snapshot(orphans.OrphanState.empty(spark)).select(F.lit(None).cast("timestamp").alias("as_of"), "*")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of a field between the files of a store."""
    return drift.changes(table(spark, folder, "raw_exports")).select("file_name", "record_kind", "change_kind", "old_name", "new_name")


def p5_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The migration steps that the changes stand for."""
    return drift.migration_steps(drift.changes(table(spark, folder, "raw_exports")))


def p5_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The anchors of all exported files in one table; names are tied by renames and values alone."""
    return drift.anchors_table(table(spark, folder, "raw_exports"), None)


def p5_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of all exported files in one table; names are tied by renames and values alone."""
    return drift.edges_table(table(spark, folder, "raw_exports"), None)


def p5_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Where each field of each exported file goes in the common tables."""
    scratch = Scratch(spark, "p5-routes")
    return drift.routes(drift.stored_lines(table(spark, folder, "raw_exports"), scratch), scratch, None)


def p5_states(spark: SparkSession, folder: str) -> DataFrame:
    """State and state history of every stored anchor in one notation."""
    return drift.anchor_states(table(spark, folder, "anchors"))


def p5_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The relations of every stored edge in one notation."""
    return drift.edge_relations(table(spark, folder, "edges"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_counts, p5_found, p5_steps, p5_anchors, p5_edges, p5_routes, p5_states, p5_relations)}


_REFS = f"""anchor_first AS (SELECT {S.key('id')} AS k, min(loaded_at) AS first_at FROM anchors GROUP BY 1 HAVING k IS NOT NULL),
schema_first AS (SELECT {S.key('id')} AS k, min(loaded_at) AS first_at FROM schemas GROUP BY 1 HAVING k IS NOT NULL),
edge_first AS (SELECT edge_id, min(loaded_at) AS first_at FROM edges WHERE edge_id IS NOT NULL GROUP BY 1),
refs AS (SELECT DISTINCT * FROM (
    SELECT 'edges.source' AS ref_field, edge_id::VARCHAR AS record_key, {S.key('source')} AS missing_key, 'anchors' AS target, edge_first.first_at AS seen_at FROM edges JOIN edge_first USING (edge_id)
    UNION ALL SELECT 'edges.target', edge_id::VARCHAR, {S.key('target')}, 'anchors', edge_first.first_at AS seen_at FROM edges JOIN edge_first USING (edge_id)
    UNION ALL SELECT 'anchors.schema_ref', k, {S.key('schema_ref')}, 'schemas', first_at FROM anchors JOIN anchor_first ON k = {S.key('id')}
    UNION ALL SELECT 'schemas.instance_ids_json', k, unnest({S.ids('instance_ids_json')}), 'anchors', first_at FROM schemas JOIN schema_first ON k = {S.key('id')}) WHERE missing_key IS NOT NULL),
known AS (SELECT 'anchors' AS target, * FROM anchor_first UNION ALL SELECT 'schemas', * FROM schema_first)"""


_DRIFT = """lines AS MATERIALIZED (SELECT * EXCLUDE (rn, first_export), first_export AS exported_at FROM (SELECT store_name, record_kind, file_name, line_no, payload,
    min(exported_at) OVER l AS first_export, row_number() OVER (PARTITION BY store_name, record_kind, file_name, line_no ORDER BY loaded_at, payload) AS rn
    FROM raw_exports WHERE file_name IS NOT NULL AND record_kind IS NOT NULL WINDOW l AS (PARTITION BY store_name, record_kind, file_name, line_no))
    WHERE rn = 1 AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
values_ AS MATERIALIZED (SELECT *, json_extract(payload, '$."' || field || '"') AS v FROM (SELECT *, unnest(json_keys(payload)) AS field FROM lines)),
typed AS MATERIALIZED (SELECT *, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN NULL WHEN json_type(v) = 'VARCHAR' THEN 'string' WHEN json_type(v) = 'BOOLEAN' THEN 'boolean'
    WHEN json_type(v) = 'ARRAY' THEN 'array' WHEN json_type(v) = 'OBJECT' THEN 'object' ELSE 'number' END AS t,
    CASE WHEN record_kind = 'edge' THEN json_extract(payload, '$.source')::VARCHAR || chr(1) || json_extract(payload, '$.target')::VARCHAR ELSE json_extract(payload, '$.id')::VARCHAR END AS rid FROM values_),
fields AS MATERIALIZED (SELECT store_name, record_kind, file_name, field, coalesce(string_agg(DISTINCT t, '|' ORDER BY t), '') AS t, min(exported_at) AS first_at FROM typed GROUP BY ALL),
files AS MATERIALIZED (SELECT *, row_number() OVER w AS seq, lag(file_name) OVER w AS old_file, lag(print) OVER w AS old_print FROM
    (SELECT store_name, record_kind, file_name, min(first_at) AS first_at, string_agg(field || ':' || t, ',' ORDER BY field) AS print FROM fields GROUP BY 1, 2, 3)
    WINDOW w AS (PARTITION BY store_name, record_kind ORDER BY first_at, file_name)),
versions AS MATERIALIZED (SELECT *, sum(CASE WHEN old_print = print THEN 0 ELSE 1 END) OVER (PARTITION BY store_name, record_kind ORDER BY seq)::BIGINT AS version FROM files),
old_fields AS (SELECT f.*, o.field, o.t FROM files f JOIN fields o ON o.store_name = f.store_name AND o.record_kind = f.record_kind AND o.file_name = f.old_file),
new_fields AS (SELECT f.*, o.field, o.t FROM files f JOIN fields o USING (store_name, record_kind, file_name) WHERE old_file IS NOT NULL),
gone AS MATERIALIZED (SELECT * FROM old_fields ANTI JOIN new_fields USING (store_name, record_kind, file_name, field)),
came AS MATERIALIZED (SELECT * FROM new_fields ANTI JOIN old_fields USING (store_name, record_kind, file_name, field)),
held AS MATERIALIZED (SELECT store_name, record_kind, file_name, rid, field, min(v::VARCHAR) AS v FROM typed WHERE t IS NOT NULL AND rid IS NOT NULL GROUP BY ALL),
pairs AS MATERIALIZED (SELECT g.store_name, g.record_kind, g.file_name, g.field AS old_name, c.field AS new_name, count(*) AS n
    FROM gone g JOIN came c USING (store_name, record_kind, file_name)
    JOIN held o ON o.store_name = g.store_name AND o.record_kind = g.record_kind AND o.file_name = g.old_file AND o.field = g.field
    JOIN held w ON w.store_name = g.store_name AND w.record_kind = g.record_kind AND w.file_name = g.file_name AND w.field = c.field AND w.rid = o.rid
    GROUP BY ALL HAVING count(*) = count(*) FILTER (o.v = w.v)),
renamed AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_name, record_kind, file_name, old_name ORDER BY n DESC, new_name) AS a,
    row_number() OVER (PARTITION BY store_name, record_kind, file_name, new_name ORDER BY n DESC, old_name) AS b FROM pairs) WHERE a = 1 AND b = 1),
found AS (SELECT store_name, record_kind, file_name, 'renamed' AS change_kind, old_name, new_name FROM renamed
    UNION ALL SELECT g.store_name, g.record_kind, g.file_name, 'removed', g.field, '' FROM gone g ANTI JOIN renamed r ON r.store_name = g.store_name AND r.record_kind = g.record_kind AND r.file_name = g.file_name AND r.old_name = g.field
    UNION ALL SELECT c.store_name, c.record_kind, c.file_name, 'added', '', c.field FROM came c ANTI JOIN renamed r ON r.store_name = c.store_name AND r.record_kind = c.record_kind AND r.file_name = c.file_name AND r.new_name = c.field
    UNION ALL SELECT store_name, record_kind, file_name, 'retyped', field, field FROM new_fields n JOIN old_fields o USING (store_name, record_kind, file_name, field) WHERE n.t <> '' AND o.t <> '' AND n.t <> o.t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH {_REFS} SELECT DISTINCT ref_field, record_key, missing_key FROM refs
            LEFT JOIN known ON known.target = refs.target AND known.k = refs.missing_key WHERE known.k IS NULL OR known.first_at > refs.seen_at""",
        # at the end of each month, with what had come by then; loads without a time do not occur in the tables
        "p3_counts": f"""WITH {_REFS}, moves AS (SELECT DISTINCT 'anchors' AS target, {S.key('id')} AS k, loaded_at AS moved_at, false AS gone FROM anchors
                UNION SELECT 'schemas', {S.key('id')}, loaded_at, false FROM schemas UNION SELECT 'anchors', {S.key('id')}, make_timestamp((pruned_at * 1000000)::BIGINT), true FROM ghosts WHERE pruned_at IS NOT NULL),
            months AS (SELECT DISTINCT date_trunc('month', t) AS as_of FROM (SELECT seen_at AS t FROM refs UNION SELECT moved_at FROM moves WHERE k IS NOT NULL)),
            timed AS (SELECT as_of, target, k, min(moved_at) FILTER (NOT gone) AS first_at, max(moved_at) FILTER (NOT gone) AS last_at, max(moved_at) FILTER (gone) AS gone_at
                FROM months JOIN moves ON moved_at < as_of + INTERVAL 1 MONTH GROUP BY 1, 2, 3)
            SELECT m.as_of, split_part(ref_field, '.', 1) AS ref_table, ref_field, date_trunc('week', seen_at) AS period, kind, count(*) AS n, count(DISTINCT missing_key) AS n_keys
            FROM (SELECT m.as_of, r.*, CASE WHEN t.last_at IS NOT NULL AND (t.gone_at IS NULL OR t.last_at >= t.gone_at) THEN 'resolved' WHEN t.first_at IS NULL THEN 'waiting' ELSE 'reopened' END AS kind, t.first_at
                FROM months m JOIN refs r ON r.seen_at < m.as_of + INTERVAL 1 MONTH LEFT JOIN timed t ON t.as_of = m.as_of AND t.target = r.target AND t.k = r.missing_key) m
            WHERE kind <> 'resolved' OR first_at > seen_at GROUP BY ALL""",
        "p5_found": f"WITH {_DRIFT} SELECT file_name, record_kind, change_kind, old_name, new_name FROM found",
        "p5_steps": f"""WITH {_DRIFT} SELECT found.*, seq, version - 1 AS from_version, version AS to_version,
            coalesce((SELECT t FROM fields f WHERE f.store_name = v.store_name AND f.record_kind = v.record_kind AND f.file_name = v.old_file AND f.field = old_name), '') AS old_type,
            coalesce((SELECT t FROM fields f WHERE f.store_name = v.store_name AND f.record_kind = v.record_kind AND f.file_name = v.file_name AND f.field = new_name), '') AS new_type,
            CASE change_kind WHEN 'renamed' THEN 'rename ' || old_name || ' to ' || new_name WHEN 'added' THEN 'default ' || new_name || ' to null before'
                WHEN 'removed' THEN 'keep ' || old_name || ' as null after' ELSE 'cast ' || new_name END AS step
            FROM found JOIN versions v USING (store_name, record_kind, file_name)""",
    }
