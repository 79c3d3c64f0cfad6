"""Streaming queries over events and references, and publishing of an index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import build, graph, intervals
from ..operators.incremental import KEY, VERSION, Target
from ..operators.scale import shared_dir
from ..session import load
from ..streaming import windows as W
from .edges import LIVE, SLICE, _slices, live


def _utc(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def st_tumbling(spark, d):
    return _utc(W.drain(W.tumbling(W.stream_table(spark, d, "events")), "complete")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def st_sliding(spark, d):
    out = W.drain(W.tumbling(W.stream_table(spark, d, "events"), "2 hours", slide="1 hour"), "complete")
    return _utc(out).select("start", "event_type", "n")


def st_sessions(spark, d):
    """Sessions in batch: the same plan as on a stream."""
    return _utc(W.sessions(load(spark, d, "events")))


def st_once(spark, d):
    """References of a stream once per rel_id."""
    return W.drain(W.first_deliveries(W.stream_table(spark, d, "hard_relationships"), ["rel_id"], "recorded_at")).select("rel_id")


def _indexed(spark, d):
    index = build.Index(spark, f"{shared_dir(spark)}/corvane/index-{uuid.uuid4().hex}")
    s = load(spark, d, "source_files")
    index.rebuild(s.where("version = 'base'").select("path", "text"))
    return index, s.where("version = 'head'").select("path", "text")


def snk1(spark, d):
    """Units of an index built from the base files and updated with the head files."""
    index, head = _indexed(spark, d)
    index.update(head)
    return index.units().select("unit_id", "path", "start_line", "end_line")


def snk9(spark, d):
    """Edges of an index of the head files, per relation and kind of target."""
    index = build.Index(spark, f"{shared_dir(spark)}/corvane/index-{uuid.uuid4().hex}")
    index.rebuild(load(spark, d, "source_files").where("version = 'head'").select("path", "text"))
    return index.read("edges").groupBy("relation", "target_kind").agg(F.count("*").alias("n"), F.sum(F.size("lines")).alias("n_lines"))


def snk4(spark, d):
    """Current bodies through a versioned target, run after run: what a run publishes is
    what changed since the run before."""
    target = Target(spark, f"{shared_dir(spark)}/corvane/target-{uuid.uuid4().hex}")
    u = load(spark, d, "units").where("unit_id is not null")
    for until in (20, 40, 10**6):
        rows = u.where(F.col("run_id") <= until).groupBy("unit_id").agg(F.max(F.struct("run_id", "ingested_at", F.coalesce("removed", F.lit(False)).alias("removed"), F.coalesce("body_hash", F.lit("")).alias("h"))).alias("v"))
        state = rows.select(F.col("unit_id").alias(KEY), F.when(F.col("v.removed"), "").otherwise(F.col("v.h")).alias(VERSION))
        target.run(state, lambda todo: todo.select(KEY, VERSION))
    return target.current().select(F.col(KEY).alias("unit_id"), F.col(VERSION).alias("body_hash"))


def snk12(spark, d):
    """Each live unit with its slice as Markdown: its length and hash."""
    u = live(spark, d)
    code = intervals.unit_code(u, load(spark, d, "source_files"))
    return build.rendered(_slices(spark, d), u, code).select("root", F.length("markdown").alias("n_chars"), F.sha2("markdown", 256).alias("digest"))


def snk13(spark, d):
    """The field log: events as JSON lines, appended, read back as a stream and counted."""
    place = f"{shared_dir(spark)}/corvane/log-{uuid.uuid4().hex}"
    e = load(spark, d, "events").select(F.col("ts").cast("string").alias("at"), F.col("event_type").alias("command"), F.col("value").alias("ms"))
    e.write.mode("append").json(place)
    rows = spark.readStream.schema("at string, command string, ms double").json(place)
    return W.drain(rows.groupBy("command").agg(F.count("*").alias("n"), F.max("ms").alias("slowest")), "complete")


def grf5(spark, d):
    """Slices given as member lists: every tested unit with its tests and their calls of it."""
    calls = graph.unit_edges(load(spark, d, "hard_relationships"), "CALLS")
    tests = graph.unit_edges(load(spark, d, "hard_relationships"), "TESTED_BY").select(F.col("source").alias("root"), F.col("target").alias("member")).distinct()
    sites = calls.groupBy(F.col("source").alias("member"), F.col("target").alias("root")).agg(F.count("line").alias("n_sites"))
    return tests.join(sites, ["root", "member"], "left").select("root", "member", F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


QUERIES = {
    "ST_tumbling": st_tumbling, "ST_sliding": st_sliding, "ST_sessions": st_sessions, "ST_once": st_once, "SNK1": snk1, "SNK4": snk4, "SNK9": snk9, "SNK12": snk12, "SNK13": snk13, "GRF5": grf5,
}

SQL = {
    "ST_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ST_sliding": """WITH w AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w GROUP BY ALL""",
    "ST_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "ST_once": "SELECT DISTINCT rel_id FROM hard_relationships",
    "SNK1": f"WITH {LIVE} SELECT unit_id, path, start_line, end_line FROM live",
    "SNK4": """SELECT unit_id, CASE WHEN removed THEN '' ELSE body_hash END AS body_hash FROM (SELECT unit_id, coalesce(removed, false) AS removed, coalesce(body_hash, '') AS body_hash, row_number() OVER (PARTITION BY unit_id ORDER BY run_id DESC, ingested_at DESC) AS rn FROM units WHERE unit_id IS NOT NULL) x
WHERE rn = 1 AND (NOT removed OR unit_id IN (SELECT unit_id FROM (SELECT unit_id, coalesce(removed, false) AS removed, row_number() OVER (PARTITION BY unit_id ORDER BY run_id DESC, ingested_at DESC) AS rn FROM units WHERE run_id <= 20) WHERE rn = 1 AND NOT removed
  UNION SELECT unit_id FROM (SELECT unit_id, coalesce(removed, false) AS removed, row_number() OVER (PARTITION BY unit_id ORDER BY run_id DESC, ingested_at DESC) AS rn FROM units WHERE run_id <= 40) WHERE rn = 1 AND NOT removed))""",
    "SNK12": SLICE + r""", h AS (SELECT path, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM source_files WHERE version = 'head'),
  parts AS (SELECT root, unit_id, role, depth FROM sl UNION ALL SELECT unit_id, unit_id, 'target', 0 FROM live),
  shown AS (SELECT root, role <> 'target' AS rest, role, depth, parts.unit_id, '## ' || role || ': ' || parts.unit_id || chr(10) || live.path || ':' || start_line || '-' || end_line || chr(10) || '```python' || chr(10)
      || coalesce(array_to_string(ls[start_line:end_line], chr(10)), '') || chr(10) || '```' AS part FROM parts JOIN live ON live.unit_id = parts.unit_id LEFT JOIN h ON h.path = live.path),
  md AS (SELECT root, string_agg(part, chr(10) || chr(10) ORDER BY rest, role, depth, unit_id) AS m FROM shown GROUP BY root)
SELECT root, CAST(length(m) AS INTEGER) AS n_chars, sha256(m) AS digest FROM md""",
    "SNK13": "SELECT event_type AS command, count(*) AS n, max(value) AS slowest FROM events GROUP BY event_type",
    "GRF5": """WITH t AS (SELECT DISTINCT source_unit_id AS root, trim(target_ref) AS member FROM hard_relationships WHERE relation = 'TESTED_BY' AND lower(trim(target_kind)) = 'unit' AND source_unit_id IS NOT NULL AND trim(target_ref) <> ''),
  c AS (SELECT source_unit_id AS member, target AS root, count(DISTINCT line) AS n FROM (SELECT source_unit_id, trim(target_ref) AS target, unnest(CAST(json_extract(evidence_json, '$.lines') AS INTEGER[])) AS line FROM hard_relationships WHERE relation = 'CALLS' AND lower(trim(target_kind)) = 'unit') GROUP BY ALL)
SELECT root, member, coalesce(n, 0) AS n_sites FROM t LEFT JOIN c USING (root, member)""",
}
