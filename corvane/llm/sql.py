"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LINKS = """WITH ok AS (
    SELECT source_unit_id, lower(relation) AS relation, target_unit_id, provenance, score, recorded_at FROM soft_relationships
    WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND source_unit_id IS NOT NULL AND target_unit_id IS NOT NULL),
  last AS (
    SELECT *, row_number() OVER (PARTITION BY source_unit_id, relation, target_unit_id, provenance ORDER BY recorded_at DESC NULLS LAST, score DESC) AS rn FROM ok),
  links AS (
    SELECT source_unit_id, relation, target_unit_id, max(score) AS score FROM last
    WHERE rn = 1 AND source_unit_id <> target_unit_id GROUP BY ALL)"""

SQL = {
    "p4_found": LINKS + """
SELECT source_unit_id, target_unit_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_unit_id ORDER BY score DESC, target_unit_id) AS rk
  FROM links WHERE relation = 'similar_to') WHERE rk <= 5""",
    "p5_found": LINKS.replace("WITH ok", "WITH RECURSIVE ok") + """,
  pairs AS (SELECT source_unit_id AS a, target_unit_id AS b FROM links WHERE relation = 'matches' AND score >= 0.6),
  both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.m)
SELECT n AS unit_id, min(m) AS group_id FROM reach GROUP BY n""",
}
