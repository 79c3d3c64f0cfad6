"""Scans, interval joins, edge aggregation and graph queries over the code index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import edge_module_key, is_test_path
from ..operators import build, graph, intervals
from ..operators.history import current_units
from ..session import load

EVIDENCE = "lines array<int>, path string, resolutions array<string>"


def live(spark, d):
    """Rows of the current versions, not removed, once each."""
    units = load(spark, d, "units")
    keys = current_units(units).where(~F.col("removed")).select("unit_id", "run_id")
    return units.join(keys, ["unit_id", "run_id"], "left_semi").dropDuplicates(["unit_id"])


def refs(spark, d):
    """References once per rel_id, tidied."""
    h = load(spark, d, "hard_relationships").where("source_unit_id is not null")
    e = F.from_json("evidence_json", EVIDENCE)
    return h.select("rel_id", "source_unit_id", "relation", F.lower(F.regexp_replace("target_kind", r"^\s+|\s+$", "")).alias("target_kind"), F.regexp_replace("target_ref", r"^\s+|\s+$", "").alias("target_ref"), "provenance", e["path"].alias("path"), e["lines"].alias("lines"), e["resolutions"].alias("resolutions"), "source_hash", "target_hash").distinct()


def src17(spark, d):
    return live(spark, d).select("path", "start_line", "unit_id", "kind")


def src18(spark, d):
    """Point lookups: the unit of every distinct unit target."""
    wanted = refs(spark, d).where("target_kind = 'unit' and target_ref <> ''").select(F.col("target_ref").alias("unit_id")).distinct()
    return live(spark, d).join(wanted, "unit_id", "left_semi").select("unit_id", "path", "start_line", "end_line")


def src19(spark, d):
    return refs(spark, d).where("provenance = 'python-ast' and relation = 'CALLS'").select("rel_id", "source_unit_id", "target_ref")


def src20(spark, d):
    """Indexed paths: of units or of source files."""
    return load(spark, d, "units").select("path").union(load(spark, d, "source_files").select("path")).distinct()


def src21(spark, d):
    """Owners of the unit ids that files with a base version hold."""
    changed = load(spark, d, "source_files").where("version = 'base'").select("path")
    return live(spark, d).join(changed, "path", "left_semi").select("unit_id", "path")


def src23(spark, d):
    """The exact lines of every live unit, as a hash and a length."""
    code = intervals.unit_code(live(spark, d), load(spark, d, "source_files"))
    return code.select("unit_id", F.sha2("code", 256).alias("code_hash"), F.octet_length("code").alias("n_bytes"))


def src25(spark, d):
    """Member lines "role: ref" read back into role and reference."""
    role = F.when(F.col("relation") == "CALLS", "callee: ").when(F.col("relation") == "TESTED_BY", "test: ").otherwise("")
    lines = refs(spark, d).where("target_ref is not null").select(F.concat(F.lit("  "), role, F.col("target_ref"), F.lit("  # seen")).alias("text"))
    bare = F.trim(F.regexp_replace("text", r"\s#.*$", ""))
    found = lines.select(F.regexp_extract(bare, r"^(caller|callee|test):", 1).alias("role"), F.trim(F.regexp_replace(bare, r"^(caller|callee|test):", "")).alias("ref")).where("ref <> ''")
    return found.groupBy(F.when(F.col("role") == "", "caller").otherwise(F.col("role")).alias("role"), "ref").agg(F.count("*").alias("n"))


def _points(spark, d):
    return refs(spark, d).where("relation = 'CALLS'").select("path", F.explode("lines").alias("line"))


def _spans(spark, d, classes=True):
    units = live(spark, d).select("path", "start_line", "end_line", "unit_id", "kind")
    return units if classes else units.where("kind <> 'class'")


def jon7(spark, d):
    return intervals.enclosing(_points(spark, d), _spans(spark, d), "narrowest")


def jon8(spark, d):
    return intervals.enclosing(_points(spark, d), _spans(spark, d), "innermost")


def jon9(spark, d):
    return intervals.enclosing(_points(spark, d), _spans(spark, d, classes=False), "smallest")


def agg1(spark, d):
    """Call edges: per caller and target sorted lines and resolutions."""
    calls = refs(spark, d).where("relation = 'CALLS' and target_ref <> ''")
    got = calls.groupBy("source_unit_id", "target_kind", "target_ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("ls"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("resolutions")))).alias("rs"))
    return got.select("source_unit_id", "target_kind", "target_ref", F.array_join("ls", ",").alias("lines"), F.array_join("rs", ",").alias("resolutions"))


def agg18(spark, d):
    """Resolved and unresolved references per relation, percent with two places."""
    r = refs(spark, d).groupBy("relation").agg(F.count_if(F.col("target_kind") == "unit").alias("resolved"), F.count("*").alias("n"))
    return r.select("relation", "resolved", (F.col("n") - F.col("resolved")).alias("unresolved"), F.round(F.col("resolved") * 100.0 / F.col("n"), 2).alias("percent"))


def jon5(spark, d):
    """(module, name) to unit: of several top-level units of a name the last one in
    path and line order."""
    top = live(spark, d).where(~F.col("qualname").contains("."))
    return top.groupBy(edge_module_key(F.col("path")).alias("module"), "name").agg(F.max(F.struct("path", "start_line", "unit_id"))["unit_id"].alias("unit_id"))


def jon6(spark, d):
    """(module, class, name) to unit, if only one method has the name and the class is indexed."""
    units = live(spark, d)
    cls = F.regexp_extract("qualname", r"^(.*)\.[^.]+$", 1)
    m = units.where("kind <> 'class' and qualname like '%.%'").select(edge_module_key(F.col("path")).alias("module"), cls.alias("class"), "name", "unit_id")
    classes = units.where("kind = 'class'").select(edge_module_key(F.col("path")).alias("module"), F.col("qualname").alias("class"))
    return m.join(classes, ["module", "class"], "left_semi").groupBy("module", "class", "name").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("n")).where("n = 1").drop("n")


#: Import lines at the left margin: import a.b as c; from ..a import b as c. Fixed values.
IMPORT_LINE, FROM_LINE = r"^import\s+([\w.]+)(?:\s+as\s+(\w+))?\s*$", r"^from\s+([\w.]+)\s+import\s+(\w+)(?:\s+as\s+(\w+))?\s*$"


def _imports(spark, d):
    """Top-level imports of head files by their lines, one name each; see build.resolve_calls."""
    lines = load(spark, d, "source_files").where("version = 'head'").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "said"))
    part = lambda pattern, k: F.regexp_extract("said", pattern, k)
    whole = lines.where(F.col("said").rlike(IMPORT_LINE)).select("path", "line", F.when(part(IMPORT_LINE, 2) != "", part(IMPORT_LINE, 2)).otherwise(F.split_part(part(IMPORT_LINE, 1), F.lit("."), F.lit(1))).alias("bound"), part(IMPORT_LINE, 1).alias("module"), (part(IMPORT_LINE, 2) != "").alias("named"))
    whole = whole.groupBy("path", "bound").agg(F.max_by(F.when(F.col("named"), F.col("module")).otherwise(F.col("bound")), "line").alias("whole"))
    dots = F.length(F.regexp_extract(part(FROM_LINE, 1), r"^(\.*)", 1))
    parents = F.split(edge_module_key(F.col("path")), r"\.")
    kept = F.slice(parents, 1, F.greatest(F.size(parents) - dots, F.lit(0)))
    rest = F.regexp_replace(part(FROM_LINE, 1), r"^\.+", "")
    origin = F.when(dots == 0, part(FROM_LINE, 1)).otherwise(F.concat_ws(".", kept, F.when(rest != "", rest)))
    name = F.struct(origin.alias("module"), part(FROM_LINE, 2).alias("name"))
    some = lines.where(F.col("said").rlike(FROM_LINE)).select("path", "line", F.when(part(FROM_LINE, 3) != "", part(FROM_LINE, 3)).otherwise(part(FROM_LINE, 2)).alias("bound"), name.alias("symbol"))
    some = some.groupBy("path", "bound").agg(F.max_by("symbol", "line").alias("symbol"))
    return whole.join(some, ["path", "bound"], "full_outer")


def jon4(spark, d):
    """Recorded call expressions resolved: a method of the caller's class, a top-level unit
    of its module, an imported name, a member of an imported module or name, a module path.
    A name that only one unit has isn't enough."""
    units = live(spark, d)
    calls = refs(spark, d).where("relation = 'CALLS' and target_kind = 'symbol' and target_ref <> ''").select("rel_id", "source_unit_id", F.col("target_ref").alias("expr"))
    at = calls.join(units.select(F.col("unit_id").alias("source_unit_id"), "path"), "source_unit_id")
    plain = F.col("expr").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$")
    got = build.resolve_calls(at.withColumn("plain", plain), units, _imports(spark, d))
    return got.select("rel_id", "target_kind", "target_ref", "resolution")


def jon10(spark, d):
    """Tests of units: resolved calls from test units to units outside test files, inverted."""
    units = live(spark, d).select("unit_id", is_test_path(F.col("path")).alias("in_test"), "name")
    calls = refs(spark, d).where("relation = 'CALLS' and target_kind = 'unit'").select("source_unit_id", "target_ref", "lines")
    test = units.where("in_test").select(F.col("unit_id").alias("source_unit_id"))
    target = units.where("not in_test").select(F.col("unit_id").alias("target_ref"))
    j = calls.join(test, "source_unit_id", "left_semi").join(target, "target_ref", "left_semi")
    got = j.groupBy(F.col("target_ref").alias("unit_id"), F.col("source_unit_id").alias("test_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("ls"))
    return got.select("unit_id", "test_id", F.array_join("ls", ",").alias("lines"))


def _calls(spark, d):
    return graph.unit_edges(load(spark, d, "hard_relationships"), "CALLS")


def _roots(spark, d):
    return live(spark, d).select(F.col("unit_id").alias("id"))


def agg5(spark, d):
    return _calls(spark, d).groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))


def agg6(spark, d):
    """Degrees and adjacency of every node, both ways."""
    e = _calls(spark, d)
    both = graph.neighbours(e, "out").withColumn("way", F.lit("callees")).unionByName(graph.neighbours(e, "in").withColumn("way", F.lit("callers")))
    return both.groupBy("node", "way").agg(F.count("*").alias("degree"), F.min("other").alias("first_neighbour"), F.max("other").alias("last_neighbour"))


def grf2(spark, d):
    return graph.closure(_roots(spark, d), _calls(spark, d), 2).select("root", "node", "depth")


def grf3(spark, d):
    return graph.neighbours(_calls(spark, d), "both")


def grf4(spark, d):
    return graph.unit_edges(load(spark, d, "hard_relationships"), "TESTED_BY").select(F.col("source").alias("unit_id"), F.col("target").alias("test_id")).distinct()


def _slices(spark, d, down=1, up=1):
    tests = graph.unit_edges(load(spark, d, "hard_relationships"), "TESTED_BY")
    return graph.slices(_roots(spark, d), _calls(spark, d), tests, live(spark, d).select("unit_id"), down, up)


def grf1(spark, d):
    s = _slices(spark, d)
    return s.select("root", "unit_id", "role", "depth", F.coalesce(F.array_join("call_lines", ","), F.lit("")).alias("call_lines"), "truncated")


def grf7(spark, d):
    """Traversal from endpoints: no callers, callees to depth 2."""
    known = live(spark, d).select(F.col("unit_id").alias("node"))
    reached = graph.closure(_roots(spark, d), _calls(spark, d), 2).join(known, "node", "left_semi")
    return reached.select("root", F.col("node").alias("unit_id"), "depth")


def agg7(spark, d):
    return _slices(spark, d).groupBy("root").pivot("role", ["callee", "caller", "test"]).count().na.fill(0)


def agg25(spark, d):
    """Bundle compression: bytes of whole files of a root's members against their lines."""
    u = live(spark, d).select("unit_id", "path", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
    files = load(spark, d, "source_files").where("version = 'head'").select("path", F.size(F.split("text", "\r\n|\r|\n")).alias("file_lines"))
    m = graph.closure(_roots(spark, d), _calls(spark, d), 1).select("root", F.col("node").alias("unit_id")).join(u, "unit_id")
    per = m.groupBy("root").agg(F.sum("n_lines").alias("bundle_lines"))
    whole = m.select("root", "path").distinct().join(files, "path").groupBy("root").agg(F.sum("file_lines").alias("whole_lines"))
    return per.join(whole, "root").select("root", "bundle_lines", "whole_lines", (F.col("whole_lines") / F.col("bundle_lines")).alias("compression"))


def agg29(spark, d):
    """Reachability of matched pairs: are both ends one call step apart, either way?"""
    soft = load(spark, d, "soft_relationships").where("lower(relation) = 'matches' and source_unit_id <> target_unit_id").select(F.col("source_unit_id").alias("node"), F.col("target_unit_id").alias("other")).distinct()
    near = graph.neighbours(_calls(spark, d), "both").withColumn("hit", F.lit(1))
    return soft.join(near, ["node", "other"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("connected"))


def top11(spark, d):
    """Fused rank: a hit keeps its score or takes the root of its score times that of a
    hit one call step away, whichever is more."""
    s = load(spark, d, "soft_relationships").where("lower(relation) = 'similar_to' and score between 0 and 1 and not isnan(score) and source_unit_id <> target_unit_id")
    lex = s.groupBy(F.col("source_unit_id").alias("q"), F.col("target_unit_id").alias("node")).agg(F.max("score").alias("lex"))
    near = graph.neighbours(_calls(spark, d), "both")
    anchor = lex.join(near, "node").select("q", F.col("other").alias("node"), F.col("lex").alias("anchor")).groupBy("q", "node").agg(F.max("anchor").alias("anchor"))
    fused = lex.join(anchor, ["q", "node"], "left").withColumn("fused", F.greatest("lex", F.coalesce(F.sqrt(F.col("lex") * F.col("anchor")), F.lit(0.0))))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("fused"), F.desc("lex"), "node"))
    return fused.withColumn("place", place).where("place <= 8").select("q", "node", "place", F.round("fused", 9).alias("fused"))


QUERIES = {
    "SRC17": src17, "SRC18": src18, "SRC19": src19, "SRC20": src20, "SRC21": src21, "SRC23": src23, "SRC25": src25, "JON4": jon4, "JON5": jon5, "JON6": jon6, "JON7": jon7, "JON8": jon8,
    "JON9": jon9, "JON10": jon10, "AGG1": agg1, "AGG5": agg5, "AGG6": agg6, "AGG7": agg7, "AGG18": agg18, "AGG25": agg25, "AGG29": agg29, "GRF1": grf1, "GRF2": grf2, "GRF3": grf3, "GRF4": grf4, "GRF7": grf7, "TOP11": top11,
}

LIVE = """last AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY run_id DESC, ingested_at DESC) AS rn FROM units WHERE unit_id IS NOT NULL),
  live AS (SELECT * FROM last WHERE rn = 1 AND NOT coalesce(removed, false))"""
REFS = r"""refs AS (SELECT DISTINCT rel_id, source_unit_id, relation, lower(regexp_replace(target_kind, '^\s+|\s+$', '', 'g')) AS target_kind,
    regexp_replace(target_ref, '^\s+|\s+$', '', 'g') AS target_ref, provenance, evidence_json, json_extract_string(evidence_json, '$.path') AS path,
    CAST(json_extract(evidence_json, '$.lines') AS INTEGER[]) AS lines, CAST(json_extract(evidence_json, '$.resolutions') AS VARCHAR[]) AS resolutions, source_hash, target_hash
  FROM hard_relationships WHERE source_unit_id IS NOT NULL)"""
BOTH = f"WITH RECURSIVE {LIVE}, {REFS}"
POINTS = f"{BOTH}, pts AS (SELECT DISTINCT path, unnest(lines) AS line FROM refs WHERE relation = 'CALLS')"
MODULE = "replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\\.py$', ''), '/__init__$', ''), '/', '.')"
TESTPATH = "(regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '_test\\.py$'))"


def _enclosing(kinds, order):
    return f"""{POINTS} SELECT path, line, unit_id FROM (
  SELECT p.path, p.line, l.unit_id, row_number() OVER (PARTITION BY p.path, p.line ORDER BY {order}) AS r
  FROM pts p JOIN live l ON l.path = p.path AND p.line BETWEEN l.start_line AND l.end_line {kinds}) WHERE r = 1"""


TOPLEVEL = f"jon5 AS (SELECT {MODULE} AS module, name, arg_max(unit_id, (path, start_line, unit_id)) AS unit_id FROM live WHERE NOT contains(qualname, '.') GROUP BY ALL)"
METHODS = rf"""m AS (SELECT {MODULE} AS module, regexp_extract(qualname, '^(.*)\.[^.]+$', 1) AS class, name, unit_id FROM live WHERE kind <> 'class' AND qualname LIKE '%.%'),
  c AS (SELECT {MODULE} AS module, qualname AS class FROM live WHERE kind = 'class'),
  jon6 AS (SELECT module, class, name, min(unit_id) AS unit_id FROM m SEMI JOIN c USING (module, class) GROUP BY ALL HAVING count(*) = 1)"""
EDGES = f"""{BOTH}, e AS (SELECT DISTINCT source_unit_id AS source, target_ref AS target, line FROM (
    SELECT source_unit_id, regexp_replace(target_ref, '^ +| +$', '', 'g') AS target_ref, unnest(lines) AS line FROM (SELECT DISTINCT source_unit_id, relation, target_kind, h.target_ref, CAST(json_extract(evidence_json, '$.lines') AS INTEGER[]) AS lines FROM hard_relationships h
      WHERE relation = 'CALLS' AND lower(trim(target_kind)) = 'unit')) WHERE source_unit_id IS NOT NULL AND target_ref IS NOT NULL AND target_ref <> ''),
  step AS (SELECT DISTINCT source AS node, target AS other FROM e), back AS (SELECT DISTINCT target AS node, source AS other FROM e),
  near AS (SELECT * FROM step UNION SELECT * FROM back)"""
TESTS = "SELECT DISTINCT source_unit_id AS unit_id, trim(target_ref) AS test_id FROM hard_relationships WHERE relation = 'TESTED_BY' AND lower(trim(target_kind)) = 'unit' AND source_unit_id IS NOT NULL AND trim(target_ref) <> ''"
CLOSE2 = EDGES + """, one AS (SELECT l.unit_id AS root, s.other AS node, 1 AS depth FROM live l JOIN step s ON s.node = l.unit_id WHERE s.other <> l.unit_id),
  two AS (SELECT DISTINCT o.root, s.other AS node, 2 AS depth FROM one o JOIN step s ON s.node = o.node WHERE s.other <> o.root AND (o.root, s.other) NOT IN (SELECT (root, node) FROM one)),
  reach AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""
SLICE = EDGES + f""", tests AS ({TESTS}),
  down AS (SELECT l.unit_id AS root, s.other AS node, 'callee' AS role, 1 AS depth FROM live l JOIN step s ON s.node = l.unit_id WHERE s.other <> l.unit_id),
  up AS (SELECT l.unit_id AS root, s.other AS node, 'caller' AS role, 1 AS depth FROM live l JOIN back s ON s.node = l.unit_id WHERE s.other <> l.unit_id AND (l.unit_id, s.other) NOT IN (SELECT (root, node) FROM down)),
  mem AS (SELECT * FROM (SELECT * FROM down UNION ALL SELECT * FROM up) SEMI JOIN (SELECT unit_id AS node FROM live) USING (node)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY role, depth, node) AS place, count(*) OVER (PARTITION BY root) > 40 AS truncated FROM mem),
  tested AS (SELECT l.unit_id AS root, t.test_id AS node, 'test' AS role, 1 AS depth, false AS truncated FROM live l JOIN tests t USING (unit_id)
    WHERE l.unit_id NOT IN (SELECT root FROM ranked WHERE truncated) AND t.test_id IN (SELECT unit_id FROM live)),
  sl AS (SELECT root, node AS unit_id, role, depth, truncated FROM ranked WHERE place <= 40 UNION ALL SELECT root, node, role, depth, truncated FROM tested),
  sites AS (SELECT source, target, array_to_string(list_sort(list_distinct(list(line))), ',') AS call_lines FROM e GROUP BY ALL)
"""

SQL = {
    "SRC17": f"WITH {LIVE} SELECT path, start_line, unit_id, kind FROM live",
    "SRC18": f"{BOTH} SELECT unit_id, live.path, start_line, end_line FROM live WHERE unit_id IN (SELECT target_ref FROM refs WHERE target_kind = 'unit' AND target_ref <> '')",
    "SRC19": f"{BOTH} SELECT rel_id, source_unit_id, target_ref FROM refs WHERE provenance = 'python-ast' AND relation = 'CALLS'",
    "SRC20": "SELECT path FROM units UNION SELECT path FROM source_files",
    "SRC21": f"WITH {LIVE} SELECT unit_id, path FROM live WHERE path IN (SELECT path FROM source_files WHERE version = 'base')",
    "SRC23": rf"""WITH {LIVE}, h AS (SELECT path, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM source_files WHERE version = 'head'),
  p AS (SELECT unit_id, array_to_string(ls[start_line:end_line], chr(10)) AS piece FROM live JOIN h USING (path))
SELECT unit_id, sha256(piece) AS code_hash, octet_length(encode(piece)) AS n_bytes FROM p""",
    "SRC25": f"""{BOTH} SELECT CASE relation WHEN 'CALLS' THEN 'callee' WHEN 'TESTED_BY' THEN 'test' ELSE 'caller' END AS role, target_ref AS ref, count(*) AS n
FROM refs WHERE target_ref IS NOT NULL AND target_ref <> '' GROUP BY ALL""",
    "JON4": rf"""{BOTH}, {TOPLEVEL}, {METHODS},
  ls AS (SELECT path, {MODULE} AS home, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS said, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS line FROM source_files WHERE version = 'head'),
  w0 AS (SELECT path, line, regexp_extract(said, '{IMPORT_LINE}', 1) AS m, regexp_extract(said, '{IMPORT_LINE}', 2) AS a FROM ls WHERE regexp_matches(said, '{IMPORT_LINE}')),
  whole AS (SELECT path, CASE WHEN a <> '' THEN a ELSE split_part(m, '.', 1) END AS bound, arg_max(CASE WHEN a <> '' THEN m ELSE split_part(m, '.', 1) END, line) AS module FROM w0 GROUP BY ALL),
  s0 AS (SELECT path, line, string_split(home, '.') AS hp, regexp_extract(said, '{FROM_LINE}', 1) AS m, regexp_extract(said, '{FROM_LINE}', 2) AS n, regexp_extract(said, '{FROM_LINE}', 3) AS a FROM ls WHERE regexp_matches(said, '{FROM_LINE}')),
  s1 AS (SELECT path, line, n, CASE WHEN a <> '' THEN a ELSE n END AS bound, length(regexp_extract(m, '^(\.*)', 1)) AS dots, hp, m FROM s0),
  sym AS (SELECT path, bound, arg_max(CASE WHEN dots = 0 THEN m ELSE array_to_string(list_filter(list_concat(hp[1:greatest(len(hp) - dots, 0)], [ltrim(m, '.')]), lambda x: x <> ''), '.') END, line) AS module, arg_max(n, line) AS name FROM s1 GROUP BY path, bound),
  c0 AS (SELECT rel_id, target_ref AS expr, live.path, {MODULE.replace("path", "live.path")} AS module, CASE WHEN kind <> 'class' AND contains(qualname, '.') THEN regexp_extract(qualname, '^(.*)\.[^.]+$', 1) END AS class,
      CASE WHEN regexp_matches(target_ref, '^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$') THEN string_split(target_ref, '.') ELSE [] END AS p
    FROM refs JOIN live ON unit_id = source_unit_id WHERE relation = 'CALLS' AND target_kind = 'symbol' AND target_ref <> ''),
  c1 AS (SELECT c0.*, whole.module AS wm, sym.module AS sm, sym.name AS sn FROM c0 LEFT JOIN whole ON whole.path = c0.path AND whole.bound = p[1] LEFT JOIN sym ON sym.path = c0.path AND sym.bound = p[1]),
  c2 AS (SELECT *, CASE WHEN len(p) = 1 THEN sm WHEN len(p) > 1 THEN array_to_string(list_concat(CASE WHEN wm IS NOT NULL THEN [wm] WHEN sn IS NOT NULL THEN [sm, sn] ELSE [p[1]] END, p[2:len(p) - 1]), '.') END AS tm,
      CASE WHEN len(p) = 1 THEN sn ELSE p[len(p)] END AS tn FROM c1),
  c3 AS (SELECT c2.*, own.unit_id AS u1, CASE WHEN len(p) = 1 THEN loc.unit_id END AS u2, far.unit_id AS u3 FROM c2
    LEFT JOIN jon6 own ON len(p) = 2 AND p[1] = 'self' AND own.module = c2.module AND own.class = c2.class AND own.name = p[2]
    LEFT JOIN jon5 loc ON len(p) = 1 AND loc.module = c2.module AND loc.name = p[1] LEFT JOIN jon5 far ON far.module = tm AND far.name = tn)
SELECT rel_id, CASE WHEN coalesce(u1, u2, u3) IS NULL THEN 'symbol' ELSE 'unit' END AS target_kind, coalesce(u1, u2, u3, expr) AS target_ref,
  CASE WHEN u1 IS NOT NULL THEN 'same-class-self' WHEN u2 IS NOT NULL THEN 'same-module' WHEN u3 IS NULL THEN 'unresolved' WHEN len(p) = 1 THEN 'from-import' WHEN wm IS NOT NULL THEN 'module-import' WHEN sn IS NOT NULL THEN 'from-import-module' ELSE 'module-path' END AS resolution FROM c3""",
    "JON5": f"{BOTH}, {TOPLEVEL} SELECT * FROM jon5",
    "JON6": f"{BOTH}, {METHODS} SELECT * FROM jon6",
    "JON7": _enclosing("", "l.end_line - l.start_line, l.start_line, l.unit_id"),
    "JON8": _enclosing("", "-l.start_line, l.end_line, l.unit_id"),
    "JON9": _enclosing("AND l.kind <> 'class'", "l.end_line - l.start_line, l.start_line, l.end_line, l.unit_id"),
    "JON10": f"""{BOTH}, c AS (SELECT source_unit_id, target_ref, unnest(lines) AS line FROM refs WHERE relation = 'CALLS' AND target_kind = 'unit')
SELECT target_ref AS unit_id, source_unit_id AS test_id, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM c
WHERE source_unit_id IN (SELECT unit_id FROM live WHERE {TESTPATH}) AND target_ref IN (SELECT unit_id FROM live WHERE NOT {TESTPATH}) GROUP BY ALL""",
    "AGG1": f"""{BOTH}, c AS (SELECT source_unit_id, target_kind, target_ref, flatten(list(lines)) AS ls, flatten(list(resolutions)) AS rs FROM refs WHERE relation = 'CALLS' AND target_ref <> '' GROUP BY ALL)
SELECT source_unit_id, target_kind, target_ref, array_to_string(list_sort(list_distinct(ls)), ',') AS lines, array_to_string(list_sort(list_distinct(rs)), ',') AS resolutions FROM c""",
    "AGG5": f"{EDGES} SELECT source, target, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM e GROUP BY source, target",
    "AGG6": f"""{EDGES}, b AS (SELECT *, 'callees' AS way FROM step UNION ALL SELECT *, 'callers' FROM back)
SELECT node, way, count(*) AS degree, min(other) AS first_neighbour, max(other) AS last_neighbour FROM b GROUP BY node, way""",
    "AGG7": f"""{SLICE} SELECT root, count(*) FILTER (role = 'callee') AS callee, count(*) FILTER (role = 'caller') AS caller, count(*) FILTER (role = 'test') AS test FROM sl GROUP BY root""",
    "AGG18": f"""{BOTH}, g AS (SELECT relation, count(*) FILTER (target_kind = 'unit') AS resolved, count(*) AS n FROM refs GROUP BY relation)
SELECT relation, resolved, n - resolved AS unresolved, round(resolved * 100.0 / n, 2) AS percent FROM g""",
    "AGG25": rf"""{CLOSE2}, f AS (SELECT path, len(regexp_split_to_array(text, '\r\n|\r|\n')) AS file_lines FROM source_files WHERE version = 'head'),
  m AS (SELECT root, l.path, end_line - start_line + 1 AS n_lines FROM one JOIN live l ON l.unit_id = node),
  per AS (SELECT root, CAST(sum(n_lines) AS BIGINT) AS bundle_lines FROM m GROUP BY root),
  whole AS (SELECT root, CAST(sum(file_lines) AS BIGINT) AS whole_lines FROM (SELECT DISTINCT root, path FROM m) JOIN f USING (path) GROUP BY root)
SELECT root, bundle_lines, whole_lines, whole_lines / bundle_lines AS compression FROM per JOIN whole USING (root)""",
    "AGG29": f"""{EDGES}, s AS (SELECT DISTINCT source_unit_id AS node, target_unit_id AS other FROM soft_relationships WHERE lower(relation) = 'matches' AND source_unit_id <> target_unit_id)
SELECT count(*) AS pairs, count(*) FILTER ((node, other) IN (SELECT (node, other) FROM near)) AS connected FROM s""",
    "GRF1": f"""{SLICE} SELECT root, unit_id, role, depth, coalesce(call_lines, '') AS call_lines, truncated FROM sl
LEFT JOIN sites ON source = CASE WHEN role = 'caller' THEN unit_id ELSE root END AND target = CASE WHEN role = 'caller' THEN root ELSE unit_id END""",
    "GRF2": f"{CLOSE2} SELECT * FROM reach",
    "GRF3": f"{EDGES} SELECT * FROM near",
    "GRF4": TESTS,
    "GRF7": f"{CLOSE2} SELECT root, node AS unit_id, depth FROM reach WHERE node IN (SELECT unit_id FROM live)",
    "TOP11": f"""{EDGES}, lex AS (SELECT source_unit_id AS q, target_unit_id AS node, max(score) AS lex FROM soft_relationships
    WHERE lower(relation) = 'similar_to' AND score BETWEEN 0 AND 1 AND NOT isnan(score) AND source_unit_id <> target_unit_id GROUP BY ALL),
  anchor AS (SELECT q, near.other AS node, max(lex) AS anchor FROM lex JOIN near USING (node) GROUP BY q, near.other),
  fused AS (SELECT q, node, lex, greatest(lex, coalesce(sqrt(lex * anchor), 0.0)) AS fused FROM lex LEFT JOIN anchor USING (q, node)),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, lex DESC, node) AS place FROM fused)
SELECT q, node, place, round(fused, 9) AS fused FROM r WHERE place <= 8""",
}
