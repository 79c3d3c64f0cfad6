"""The queries of the general problems, each over its whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.history import current_units
from ..operators.incremental import KEY, VERSION, Target, pending_work, processed_states, unit_states
from ..operators.orphans import orphan_references, orphan_report
from ..operators.scale import shared_dir
from ..session import load


def p1_found(spark, d):
    return pending_work(load(spark, d, "units"), load(spark, d, "unit_checkpoints"), load(spark, d, "index_runs"), load(spark, d, "hard_relationships"))


def p1_target(spark, d):
    """The same units through a versioned target: its first version is what checkpoints say
    was processed, its second what a run over the current states publishes."""
    target = Target(spark, f"{shared_dir(spark)}/corvane/target-{uuid.uuid4().hex}")
    current = current_units(load(spark, d, "units"))
    base = target.publish(processed_states(load(spark, d, "unit_checkpoints"), load(spark, d, "index_runs")), 0)
    target.run(unit_states(current), lambda todo: todo.select(KEY, VERSION))
    return target.read().where(F.col("target_version") > base).select(KEY, VERSION)


def p3_found(spark, d):
    return orphan_references(load(spark, d, "hard_relationships"), load(spark, d, "units")).select("rel_id", "orphan_kind", "period")


def p3_report(spark, d):
    return orphan_report(load(spark, d, "hard_relationships"), load(spark, d, "soft_relationships"), load(spark, d, "units"))


QUERIES = {"p1_found": p1_found, "p1_target": p1_target, "p3_found": p3_found, "p3_report": p3_report}

CURRENT = """SELECT unit_id, removed, body_hash FROM (
    SELECT unit_id, coalesce(removed, false) AS removed, coalesce(body_hash, '') AS body_hash,
           row_number() OVER (PARTITION BY unit_id ORDER BY run_id DESC, ingested_at DESC) AS rn
    FROM units WHERE unit_id IS NOT NULL) WHERE rn = 1"""

ORPHANS = """WITH refs AS (
    SELECT DISTINCT rel_id, regexp_replace(target_ref, '^\\s+|\\s+$', '', 'g') AS target_ref, recorded_at FROM hard_relationships
    WHERE lower(trim(target_kind, ' \t\r\n')) = 'unit' AND regexp_replace(target_ref, '^\\s+|\\s+$', '', 'g') <> ''),
  cur AS (""" + CURRENT + """),
  seen AS (SELECT unit_id, min(indexed_at) AS first_seen FROM units GROUP BY unit_id),
  found AS (
    SELECT DISTINCT rel_id, target_ref,
      CASE WHEN cur.unit_id IS NULL THEN 'missing' WHEN removed THEN 'removed' WHEN first_seen > recorded_at THEN 'late' END AS orphan_kind,
      strftime(recorded_at, '%Y-%m') AS period
    FROM refs LEFT JOIN cur ON cur.unit_id = target_ref LEFT JOIN seen ON seen.unit_id = target_ref)
"""

DONE = """WITH cur AS (""" + CURRENT + """),
  ok AS (SELECT DISTINCT run_id, attempt FROM index_runs WHERE status = 'ok'),
  done AS (SELECT unit_id, body_hash FROM (
      SELECT unit_id, body_hash, row_number() OVER (PARTITION BY unit_id ORDER BY run_id DESC, attempt DESC, processed_at DESC) AS rn
      FROM unit_checkpoints SEMI JOIN ok USING (run_id, attempt)) WHERE rn = 1)
"""

SQL = {
    "p1_found": DONE + """SELECT 'units' AS record_table, cur.unit_id AS record_key FROM cur LEFT JOIN done USING (unit_id)
WHERE (CASE WHEN removed THEN '' ELSE cur.body_hash END) <> coalesce(done.body_hash, '')
UNION ALL
SELECT 'hard_relationships', CAST(rel_id AS VARCHAR) FROM (
  SELECT DISTINCT rel_id FROM hard_relationships h JOIN cur ON cur.unit_id = h.source_unit_id
  WHERE NOT removed AND coalesce(source_hash, '') <> body_hash)""",
    "p1_target": DONE + """SELECT unit_id AS source_key, CASE WHEN removed THEN '' ELSE cur.body_hash END AS source_version FROM cur LEFT JOIN done USING (unit_id)
WHERE (CASE WHEN removed THEN '' ELSE cur.body_hash END) <> coalesce(done.body_hash, '')""",
    "p3_found": ORPHANS + "SELECT rel_id, orphan_kind, period FROM found WHERE orphan_kind IS NOT NULL",
    "p3_report": r"""WITH refs AS (
    SELECT DISTINCT 'hard_relationships' AS record_table, CAST(rel_id AS VARCHAR) AS record, regexp_replace(target_ref, '^\s+|\s+$', '', 'g') AS key, recorded_at FROM hard_relationships
    WHERE lower(regexp_replace(target_kind, '^\s+|\s+$', '', 'g')) = 'unit'
    UNION ALL
    SELECT 'soft_relationships', concat_ws(chr(0), source_unit_id, relation, target_unit_id, provenance), regexp_replace(unnest([source_unit_id, target_unit_id]), '^\s+|\s+$', '', 'g'), recorded_at
    FROM (SELECT DISTINCT source_unit_id, relation, target_unit_id, provenance, recorded_at FROM soft_relationships)),
  cur AS (""" + CURRENT + r"""),
  seen AS (SELECT unit_id, min(indexed_at) AS first_seen FROM units GROUP BY unit_id),
  found AS (SELECT record_table, key, strftime(recorded_at, '%Y-%m') AS period,
      CASE WHEN cur.unit_id IS NULL THEN 'missing' WHEN removed THEN 'removed' WHEN first_seen > recorded_at THEN 'late' END AS orphan_kind
    FROM refs LEFT JOIN cur ON cur.unit_id = key LEFT JOIN seen ON seen.unit_id = key WHERE key <> '')
SELECT record_table, orphan_kind, period, count(*) AS n_references, count(DISTINCT key) AS n_targets FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL""",
}
