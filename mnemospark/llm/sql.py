"""DuckDB statements that the driver compares with the queries of this subpackage."""

from __future__ import annotations

from mnemospark.plans import base_sql as S

_TAGS = f"""carried AS MATERIALIZED (SELECT DISTINCT id, tag FROM (SELECT {S.key('id')} AS id, unnest({S.tags('tags_json')}) AS tag FROM anchors) WHERE id IS NOT NULL),
total AS (SELECT count(DISTINCT id) AS n FROM carried), alone AS MATERIALIZED (SELECT tag, count(*) AS n FROM carried GROUP BY 1),
together AS MATERIALIZED (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM carried a JOIN carried b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2),
counted AS MATERIALIZED (SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n FROM together JOIN alone x ON x.tag = tag_a JOIN alone y ON y.tag = tag_b CROSS JOIN total)"""


def _h(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0.0 END)"


_LLR = "greatest(0.0, 2.0 * (" + " + ".join(map(_h, ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab"))) + " - " + " - ".join(map(_h, ("n_a", "n - n_a", "n_b", "n - n_b"))) + f" + {_h('n')}))"

_MATCHES = f"""matches AS MATERIALIZED (SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM (SELECT {S.key('source')} AS s, {S.key('target')} AS t FROM edges
    WHERE list_has_any({S.edge_types('edge_type')}, ['duplicates', 'duplicate_of'])) WHERE s IS NOT NULL AND t IS NOT NULL AND s <> t),
sides AS MATERIALIZED (SELECT a AS node, b AS other FROM matches UNION ALL SELECT b, a FROM matches),
reach AS (SELECT DISTINCT node, node AS label FROM sides UNION SELECT s.other, r.label FROM reach r JOIN sides s ON s.node = r.node WHERE r.label < s.other)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_TAGS} SELECT tag_a, tag_b FROM counted WHERE n_ab >= 8 AND n_ab * n >= 3 * n_a * n_b",
        "p1_pairs": f"WITH {_TAGS} SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) + 1e-9, 6) AS lift, round({_LLR} + 1e-9, 4) AS llr FROM counted",
        "p1_significant": f"WITH {_TAGS} SELECT tag_a, tag_b, n_ab, round({_LLR} + 1e-9, 4) AS llr FROM counted WHERE n_ab::DOUBLE * n > n_a::DOUBLE * n_b AND {_LLR} >= 10.827566",
        "p4_found": f"WITH RECURSIVE {_MATCHES} SELECT node AS anchor_id, min(label) AS group_id FROM reach GROUP BY 1",
    }
