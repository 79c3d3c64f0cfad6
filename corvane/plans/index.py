"""Filters, scalar functions, set operations and maintenance over units and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dml, intervals
from ..session import load
from ..sources.tree import SKIPPED, own_scripts
from .edges import LIVE, REFS, live, refs

NAMES = "array<string>"


def _n_lines():
    return F.col("end_line") - F.col("start_line") + 1


def src1(spark, d):
    """Python files of the tree, without skipped directories."""
    skipped = F.array(*[F.lit(x) for x in SKIPPED])
    files = load(spark, d, "source_files").where(F.col("path").endswith(".py"))
    return files.where(~F.arrays_overlap(F.split("path", "/"), skipped)).select("path", "version")


def src2(spark, d):
    """Script files that client calls name, without vendored and generated ones."""
    path = F.split_part("target_ref", F.lit(":"), F.lit(1))
    files = refs(spark, d).where("target_kind = 'client_call'").select(path.alias("path")).distinct()
    return files.where(own_scripts(F.col("path")))


def src3(spark, d):
    """Paths that an exclude, a substring, leaves out."""
    return load(spark, d, "units").select("path").distinct().select("path", (F.contains("path", F.lit("tests/")) | F.contains("path", F.lit("core"))).alias("excluded"))


def src14(spark, d):
    """Changed files: head text differs from base, or there is no base."""
    s = load(spark, d, "source_files")
    base = s.where("version = 'base'").select("path", F.sha2("text", 256).alias("old"))
    head = s.where("version = 'head'").select("path", F.sha2("text", 256).alias("new"))
    return head.join(base, "path", "left").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.col("old").isNull().alias("added"))


def src15_lines(spark, d):
    """Lines of base files that read like definitions, by name, the last of each; files that
    can't be parsed included."""
    lines = load(spark, d, "source_files").where("version = 'base'").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line"))
    found = lines.select("path", "pos", F.regexp_extract("line", r"^\s*(?:async\s+)?def\s+(\w+)", 1).alias("name")).where("name <> ''")
    return found.groupBy("path", "name").agg((F.max("pos") + 1).alias("line"))


def src16(spark, d):
    """Last commit per file, '' if there is none."""
    u = load(spark, d, "units").where("path is not null")
    return u.groupBy("path").agg(F.coalesce(F.max(F.struct("run_id", "ingested_at", "git_file_commit"))["git_file_commit"], F.lit("")).alias("commit"))


def src22(spark, d):
    """Cached sets per current body: hits and misses; null payloads are misses."""
    cached = load(spark, d, "shingles_v2").where("payload is not null").select("body_hash").distinct().withColumn("hit", F.lit(True))
    return live(spark, d).select("body_hash").distinct().join(cached, "body_hash", "left").select("body_hash", F.coalesce("hit", F.lit(False)).alias("hit"))


def flt1(spark, d):
    return live(spark, d).where((F.col("kind") != "class") & (_n_lines() >= 5)).select("unit_id", _n_lines().alias("n_lines"))


def flt3(spark, d):
    """Functions without documentation, dunders, accessors and bodies of two lines left out."""
    u = live(spark, d).where((F.col("kind") != "class") & (T.stripped(F.coalesce("doc_text", F.lit(""))) == "") & ~F.col("name").rlike("^__.*__$") & (_n_lines() > 2))
    return u.where(~F.exists(F.from_json("decorators_json", NAMES), lambda x: x.rlike(r"^property$|\.setter$|\.deleter$|\.getter$"))).select("unit_id")


def flt4(spark, d):
    """Targets resolved: exact id, else path:line inside a span, else a name. All matches."""
    u = live(spark, d)
    q = refs(spark, d).where("target_ref <> ''").select(F.col("target_ref").alias("query")).distinct()
    exact = q.join(u.select(F.col("unit_id").alias("query"), "unit_id"), "query").select("query", "unit_id", F.lit("id").alias("how"))
    rest = q.join(exact.select("query").distinct(), "query", "left_anti")
    named = u.select(F.col("name").alias("query"), "unit_id").union(u.select("qualname", "unit_id")).distinct()
    return exact.unionByName(rest.join(named, "query").select("query", "unit_id", F.lit("name").alias("how")))


def flt4_lines(spark, d):
    """path:line queries, made of the evidence of every reference."""
    q = refs(spark, d).where("path is not null").select("path", F.explode("lines").alias("line")).distinct()
    hit = intervals.containing(q, live(spark, d))
    return hit.select(F.concat_ws(":", "path", "line").alias("query"), "unit_id")


def flt5(spark, d):
    """References resolved to one unit each, the first match; misses are returned."""
    q = refs(spark, d).where("target_ref <> ''").select(F.col("target_ref").alias("query")).distinct()
    best = flt4(spark, d).groupBy("query").agg(F.min("unit_id").alias("unit_id"))
    return q.join(best, "query", "left").select("query", "unit_id", F.col("unit_id").isNull().alias("missed"))


def flt6(spark, d):
    u = live(spark, d).where((F.col("kind") != "class") & T.is_test_path(F.col("path")))
    fixture = F.exists(F.from_json("decorators_json", NAMES), lambda x: x.rlike(r"(^|\.)fixture\b"))
    return u.select("unit_id", ((F.col("name") == "test") | F.col("name").startswith("test_")).alias("is_test"), fixture.alias("is_fixture"))


def flt8(spark, d):
    """Why a missed reference isn't indexed, by its file suffix."""
    suffix = F.regexp_extract("target_ref", r"\.([A-Za-z]+)(?::\d+)?$", 1)
    why = F.when(suffix.isin("js", "ts", "jsx", "tsx"), "script").when(suffix.isin("py", "pyi"), "python").when(suffix == "", "no suffix").otherwise("name")
    return flt5(spark, d).where("missed").select(F.col("query").alias("target_ref")).select("target_ref", why.alias("reason"))


def flt10(spark, d):
    """Purposes that aren't just the spaced name."""
    return live(spark, d).select("unit_id", (F.coalesce(F.trim("purpose"), F.lit("")) != F.trim(F.replace("name", F.lit("_"), F.lit(" ")))).alias("documented"))


def flt11(spark, d):
    kept = F.filter(F.from_json("concepts_json", NAMES), lambda x: ~F.contains(x, F.lit("::")) & ~F.contains(x, F.lit(".")))
    return live(spark, d).select("unit_id", F.array_join(kept, ",").alias("concepts"))


def flt12(spark, d):
    return live(spark, d).where("kind <> 'class'").groupBy("name").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def flt13(spark, d):
    return live(spark, d).select("unit_id", F.when(F.coalesce("doc_text", F.lit("")) != "", F.coalesce("purpose", F.lit(""))).otherwise("").alias("summary"))


def fn8(spark, d):
    return load(spark, d, "eval_items").select("item_id", F.array_join(T.query_terms(F.col("question")), " ").alias("terms"))


def fn9(spark, d):
    return load(spark, d, "documents").select("doc_id", T.body_terms(F.col("text")).alias("terms"))


def fn10(spark, d):
    """Coverage of every item's terms by its answer."""
    i = load(spark, d, "eval_items")
    return i.select("item_id", T.term_coverage(T.query_terms(F.col("question")), F.lower("answer")).alias("coverage"))


def fn12(spark, d):
    """Coverage of the words of a unit's documentation by its body terms, name and signature."""
    u = live(spark, d)
    terms = T.query_terms(F.coalesce("doc_text", "purpose", F.lit("")))
    body, name = T.term_coverage(terms, F.lower("body_terms")), T.term_coverage(terms, F.lower(F.concat_ws(" ", "qualname", "signature")))
    return u.select("unit_id", body.alias("body"), name.alias("name"), (0.5 * body + 0.5 * name).alias("score"))


def fn13(spark, d):
    """Type bonus for str inputs and a list return: 6 per matching parameter up to 12, and
    12 for the same return type or 6 for one that contains it."""
    types = F.transform(F.from_json("parameters_json", "array<struct<name:string,type:string>>"), lambda p: F.lower(p["type"]))
    inputs = F.when(F.exists(types, lambda t: (t != "") & F.contains(t, F.lit("str"))), 6).otherwise(0) + F.when(F.exists(types, lambda t: (t != "") & F.contains(t, F.lit("int"))), 6).otherwise(0)
    back = F.lower(F.coalesce("returns", F.lit("")))
    returned = F.when(back == "list[str]", 12).when((back != "") & F.contains(back, F.lit("list")), 6).otherwise(0)
    return live(spark, d).select("unit_id", (F.least(inputs, F.lit(12)) + returned).alias("bonus"))


def fn16(spark, d):
    """Patterns of routes made of unit paths: an id, a query and a trailing slash."""
    url = F.concat(F.lit("/api/"), F.replace("path", F.lit(".py"), F.lit("")), F.lit("/${"), F.col("name"), F.lit("}/"), F.col("kind"), F.lit("/?x=1#y"))
    return live(spark, d).select("unit_id", T.route_pattern(url).alias("pattern"))


def fn17(spark, d):
    return live(spark, d).select("unit_id", T.join_route(F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/")), F.concat(F.lit("//"), F.col("name"))).alias("route"))


def fn18(spark, d):
    return load(spark, d, "source_files").select("path", "version", T.short_hash(F.col("text")).alias("hash"))


def fn19(spark, d):
    return load(spark, d, "units").select("path").distinct().select("path", T.unit_module_key(F.col("path")).alias("unit_module"), T.edge_module_key(F.col("path")).alias("edge_module"))


def fn21(spark, d):
    return live(spark, d).select("unit_id", T.purpose_of(F.col("doc_text"), F.col("name")).alias("purpose"), F.coalesce(T.collapsed(F.col("doc_text")), F.lit("")).alias("doc_text"))


def fn24(spark, d):
    """Lines of head files that hold a term in any letter case."""
    lines = load(spark, d, "source_files").where("version = 'head' and contains(lower(text), 'raise')").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "line"))
    return lines.where("contains(lower(line), 'raise')").select("path", (F.col("pos") + 1).alias("line"))


def fn25(spark, d):
    s = load(spark, d, "soft_relationships")
    key = F.concat_ws("\u0001", F.lit("corpus"), F.least("source_unit_id", "target_unit_id"), F.greatest("source_unit_id", "target_unit_id"))
    return s.select(T.short_hash(key, 16).alias("pair_id")).distinct()


def fn26(spark, d):
    return load(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))


def set3(spark, d):
    """Ids in both, only in the target, only in the source columns of references."""
    a = refs(spark, d).select(F.col("source_unit_id").alias("id"))
    b = refs(spark, d).where("target_kind = 'unit'").select(F.col("target_ref").alias("id")).where("id <> ''")
    named = lambda df, n: df.select("id", F.lit(n).alias("part"))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "source")).unionByName(named(b.subtract(a), "target"))


def set5(spark, d):
    """Symmetric difference of the hashes that units and the cache hold."""
    u = load(spark, d, "units").select("body_hash").distinct().withColumn("in_units", F.lit(True))
    s = load(spark, d, "shingles_v2").select("body_hash").distinct().withColumn("in_cache", F.lit(True))
    return u.join(s, "body_hash", "full_outer").where("in_units is null or in_cache is null").select("body_hash", F.coalesce("in_units", F.lit(False)).alias("in_units"))


def set6(spark, d):
    """The tree as of base, overridden by head."""
    s = load(spark, d, "source_files").select("path", "version", F.sha2("text", 256).alias("hash"))
    return dml.replace_by(s.where("version = 'base'"), s.where("version = 'head'"), "path")


def snk5(spark, d):
    u = load(spark, d, "units")
    first, later = u.where("run_id = 1"), u.where("run_id > 1")
    return dml.conflicts(later.select("unit_id", "path"), first.select("unit_id"))


def _released(spark, d):
    """Units of files with a base version, as if these files were replaced."""
    changed = load(spark, d, "source_files").where("version = 'base'").select("path")
    return live(spark, d).join(changed, "path", "left_semi").select("unit_id")


def snk6(spark, d):
    gone = load(spark, d, "units").select("unit_id").distinct().join(live(spark, d).select("unit_id"), "unit_id", "left_anti")
    return dml.surviving_edges(refs(spark, d), _released(spark, d), gone).select("rel_id", "source_unit_id", "target_ref")


def snk6_scores(spark, d):
    s = load(spark, d, "soft_relationships").where("source_unit_id is not null and target_unit_id is not null")
    return dml.surviving_scores(s, _released(spark, d)).select("source_unit_id", "target_unit_id", "relation").distinct()


def snk7(spark, d):
    return dml.stamped(refs(spark, d), live(spark, d)).select("rel_id", "target_hash")


def snk8(spark, d):
    return dml.invalid_edges(refs(spark, d), live(spark, d))


def snk10(spark, d):
    """One row per cached hash: the payload's size, the largest of repeated rows."""
    return load(spark, d, "shingles_v2").groupBy("body_hash").agg(F.max(F.octet_length("payload")).alias("n_bytes"), F.count("*").alias("n_rows"))


def snk11(spark, d):
    """A Markdown map: one text per path with its units in line order."""
    line = F.concat(F.lit("- `"), F.col("qualname"), F.lit("` ("), F.col("kind"), F.lit(", "), F.col("start_line").cast("string"), F.lit(")"))
    per = live(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "unit_id", line.alias("line")))).alias("ls"))
    return per.select("path", F.concat(F.lit("## "), F.col("path"), F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def snk14(spark, d):
    """Files changed after the last index run that saw them."""
    seen = load(spark, d, "units").groupBy("path").agg(F.max("indexed_at").alias("indexed_at"))
    return load(spark, d, "source_files").where("version = 'head' and mtime is not null").join(seen, "path").where("mtime > indexed_at").select("path")


def snk15(spark, d):
    """Review packets: nested JSON with arrays cut to their first elements."""
    c = F.slice(F.from_json("concepts_json", NAMES), 1, 8)
    return live(spark, d).select("unit_id", F.to_json(F.struct(F.col("name"), F.col("kind"), c.alias("concepts"))).alias("packet"))


def snk16(spark, d):
    """A blind sheet: pairs in digest order without provenance."""
    s = load(spark, d, "soft_relationships").where("lower(relation) = 'matches'")
    key = F.sha2(F.concat_ws("|", "source_unit_id", "target_unit_id"), 256)
    return s.select("source_unit_id", "target_unit_id", key.alias("digest")).distinct().withColumn("sheet_id", F.left("digest", F.lit(10))).drop("digest")


QUERIES = {
    "SRC1": src1, "SRC2": src2, "SRC3": src3, "SRC14": src14, "SRC15_lines": src15_lines, "SRC16": src16, "SRC22": src22, "FLT1": flt1, "FLT3": flt3, "FLT4": flt4, "FLT4_lines": flt4_lines, "FLT5": flt5, "FLT6": flt6,
    "FLT8": flt8, "FLT10": flt10, "FLT11": flt11, "FLT12": flt12, "FLT13": flt13, "FN8": fn8, "FN9": fn9, "FN10": fn10, "FN12_coverage": fn12, "FN13": fn13, "FN16": fn16, "FN17": fn17, "FN18": fn18, "FN19": fn19, "FN21": fn21,
    "FN24": fn24, "FN25": fn25, "FN26": fn26, "SET3": set3, "SET5": set5, "SET6": set6, "SNK5": snk5, "SNK6": snk6, "SNK6_scores": snk6_scores, "SNK7": snk7, "SNK8": snk8, "SNK10": snk10, "SNK11": snk11, "SNK14": snk14,
    "SNK15": snk15, "SNK16": snk16,
}

W = f"WITH {LIVE}, {REFS}"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TERMS = "list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda t: lower(t))"
DISTINCT = "list_filter({0}, lambda t, i: list_position({0}, t) = i)"


def terms(col):
    return f"list_filter({DISTINCT.format(TERMS.format(col))}, lambda t: NOT list_contains({STOP}, t))"


def coverage(q, hay):
    return f"CASE WHEN len({q}) > 0 THEN 100.0::DOUBLE * len(list_filter({q}, lambda t: contains({hay}, t))) / len({q}) ELSE 0.0::DOUBLE END"


RESOLVED = W + """, q AS (SELECT DISTINCT target_ref AS query FROM refs WHERE target_ref <> ''),
  exact AS (SELECT query, unit_id, 'id' AS how FROM q JOIN live ON unit_id = query),
  named AS (SELECT name AS query, unit_id FROM live UNION SELECT qualname, unit_id FROM live),
  res AS (SELECT * FROM exact UNION ALL SELECT query, unit_id, 'name' FROM q JOIN named USING (query) WHERE query NOT IN (SELECT query FROM exact)),
  flt5 AS (SELECT query, min(unit_id) AS unit_id, min(unit_id) IS NULL AS missed FROM q LEFT JOIN res USING (query) GROUP BY query)
"""
RELEASED = W + ", rel AS (SELECT unit_id FROM live WHERE path IN (SELECT path FROM source_files WHERE version = 'base'))"
NAMESJ = "CAST(json({0}) AS VARCHAR[])"

SQL = {
    "SRC1": "SELECT path, version FROM source_files WHERE path LIKE '%.py' AND NOT list_has_any(string_split(path, '/'), [" + ", ".join(f"'{s}'" for s in SKIPPED) + "])",
    "SRC2": W + r" SELECT DISTINCT split_part(target_ref, ':', 1) AS path FROM refs WHERE target_kind = 'client_call' AND split_part(target_ref, ':', 1) LIKE '%.js' AND NOT regexp_matches(split_part(target_ref, ':', 1), '(^|/)(node_modules|vendor|dist|build)/|\.(min|bundle)\.js$')",
    "SRC3": "SELECT DISTINCT path, (contains(path, 'tests/') OR contains(path, 'core')) AS excluded FROM units",
    "SRC14": """WITH b AS (SELECT path, text FROM source_files WHERE version = 'base') SELECT h.path, b.text IS NULL AS added FROM source_files h LEFT JOIN b USING (path)
WHERE h.version = 'head' AND b.text IS DISTINCT FROM h.text""",
    "SRC15_lines": r"""WITH l AS (SELECT path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS n FROM source_files WHERE version = 'base'),
  f AS (SELECT path, n, regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)', 1) AS name FROM l) SELECT path, name, CAST(max(n) AS INTEGER) AS line FROM f WHERE name <> '' GROUP BY path, name""",
    "SRC16": "SELECT path, coalesce(git_file_commit, '') AS commit FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_id DESC, ingested_at DESC, git_file_commit DESC NULLS LAST) AS r FROM units) WHERE r = 1",
    "SRC22": f"WITH {LIVE} SELECT DISTINCT body_hash, body_hash IN (SELECT body_hash FROM shingles_v2 WHERE payload IS NOT NULL) AS hit FROM live",
    "FLT1": f"WITH {LIVE} SELECT unit_id, end_line - start_line + 1 AS n_lines FROM live WHERE kind <> 'class' AND end_line - start_line + 1 >= 5",
    "FLT3": rf"""WITH {LIVE} SELECT unit_id FROM live WHERE kind <> 'class' AND trim(coalesce(doc_text, '')) = '' AND NOT regexp_matches(name, '^__.*__$') AND end_line - start_line + 1 > 2
AND len(list_filter({NAMESJ.format('decorators_json')}, lambda x: regexp_matches(x, '^property$|\.setter$|\.deleter$|\.getter$'))) = 0""",
    "FLT4": RESOLVED + "SELECT * FROM res",
    "FLT4_lines": W + ", q AS (SELECT DISTINCT path, unnest(lines) AS line FROM refs) SELECT concat(q.path, ':', line) AS query, unit_id FROM q JOIN live ON live.path = q.path AND line BETWEEN start_line AND end_line",
    "FLT5": RESOLVED + "SELECT * FROM flt5",
    "FLT6": rf"""WITH {LIVE} SELECT unit_id, (name = 'test' OR name LIKE 'test\_%' ESCAPE '\') AS is_test, len(list_filter({NAMESJ.format('decorators_json')}, lambda x: regexp_matches(x, '(^|\.)fixture\b'))) > 0 AS is_fixture
FROM live WHERE kind <> 'class' AND (regexp_matches(path, '(^|/)test_[^/]*\.py$') OR regexp_matches(path, '_test\.py$'))""",
    "FLT8": RESOLVED + r"""SELECT query AS target_ref, CASE WHEN s IN ('js', 'ts', 'jsx', 'tsx') THEN 'script' WHEN s IN ('py', 'pyi') THEN 'python' WHEN s = '' THEN 'no suffix' ELSE 'name' END AS reason
FROM (SELECT query, regexp_extract(query, '\.([A-Za-z]+)(?::\d+)?$', 1) AS s FROM flt5 WHERE missed)""",
    "FLT10": f"WITH {LIVE} SELECT unit_id, coalesce(trim(purpose), '') <> trim(replace(name, '_', ' ')) AS documented FROM live",
    "FLT11": f"WITH {LIVE} SELECT unit_id, array_to_string(list_filter({NAMESJ.format('concepts_json')}, lambda x: NOT contains(x, '::') AND NOT contains(x, '.')), ',') AS concepts FROM live",
    "FLT12": f"WITH {LIVE} SELECT name, min(unit_id) AS unit_id FROM live WHERE kind <> 'class' GROUP BY name HAVING count(*) = 1",
    "FLT13": f"WITH {LIVE} SELECT unit_id, CASE WHEN coalesce(doc_text, '') <> '' THEN coalesce(purpose, '') ELSE '' END AS summary FROM live",
    "FN8": f"SELECT item_id, array_to_string({terms('question')}, ' ') AS terms FROM eval_items",
    "FN9": f"SELECT doc_id, array_to_string({DISTINCT.format(TERMS.format('text'))}, ' ') AS terms FROM documents",
    "FN10": f"WITH q AS (SELECT item_id, {terms('question')} AS t, lower(answer) AS a FROM eval_items) SELECT item_id, {coverage('t', 'a')} AS coverage FROM q",
    "FN12_coverage": f"""WITH {LIVE}, q AS (SELECT unit_id, {terms("coalesce(doc_text, purpose, '')")} AS t, lower(body_terms) AS b, lower(concat_ws(' ', qualname, signature)) AS n FROM live),
  c AS (SELECT unit_id, {coverage('t', 'b')} AS body, {coverage('t', 'n')} AS name FROM q) SELECT unit_id, body, name, 0.5::DOUBLE * body + 0.5::DOUBLE * name AS score FROM c""",
    "FN13": f"""WITH {LIVE}, t AS (SELECT unit_id, list_transform(CAST(json_extract_string(parameters_json, '$[*].type') AS VARCHAR[]), lambda x: lower(x)) AS ts, lower(coalesce(returns, '')) AS r FROM live)
SELECT unit_id, least(CASE WHEN len(list_filter(ts, lambda x: contains(x, 'str'))) > 0 THEN 6 ELSE 0 END + CASE WHEN len(list_filter(ts, lambda x: contains(x, 'int'))) > 0 THEN 6 ELSE 0 END, 12)
  + CASE WHEN r = 'list[str]' THEN 12 WHEN contains(r, 'list') THEN 6 ELSE 0 END AS bonus FROM t""",
    "FN16": f"WITH {LIVE} SELECT unit_id, '/api/' || replace(path, '.py', '') || '/{{}}/' || kind AS pattern FROM live",
    "FN17": f"WITH {LIVE} SELECT unit_id, '/' || split_part(path, '/', 1) || '/' || name AS route FROM live",
    "FN18": "SELECT path, version, left(sha256(text), 12) AS hash FROM source_files",
    "FN19": r"SELECT DISTINCT path, replace(regexp_replace(path, '\.py$', ''), '/', '.') AS unit_module, replace(regexp_replace(regexp_replace(regexp_replace(path, '^src/', ''), '\.py$', ''), '/__init__$', ''), '/', '.') AS edge_module FROM units",
    "FN21": rf"""WITH {LIVE}, p AS (SELECT unit_id, name, left(trim(split_part(trim(doc_text), chr(10), 1)), 240) AS f, doc_text FROM live)
SELECT unit_id, CASE WHEN coalesce(f, '') <> '' THEN f ELSE replace(name, '_', ' ') END AS purpose, coalesce(left(trim(regexp_replace(doc_text, '\s+', ' ', 'g')), 4000), '') AS doc_text FROM p""",
    "FN24": r"""WITH l AS (SELECT path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS line FROM source_files WHERE version = 'head')
SELECT path, CAST(line AS INTEGER) AS line FROM l WHERE contains(lower(t), 'raise')""",
    "FN25": "SELECT DISTINCT left(sha256(concat_ws(chr(1), 'corpus', least(source_unit_id, target_unit_id), greatest(source_unit_id, target_unit_id))), 16) AS pair_id FROM soft_relationships",
    "FN26": "SELECT doc_id, octet_length(encode(text)) AS n_bytes FROM documents",
    "SET3": W + """, a AS (SELECT DISTINCT source_unit_id AS id FROM refs), b AS (SELECT DISTINCT target_ref AS id FROM refs WHERE target_kind = 'unit' AND target_ref <> '')
SELECT id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT id, 'source' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'target' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "SET5": """WITH u AS (SELECT DISTINCT body_hash FROM units), s AS (SELECT DISTINCT body_hash FROM shingles_v2)
SELECT coalesce(u.body_hash, s.body_hash) AS body_hash, u.body_hash IS NOT NULL AS in_units FROM u FULL JOIN s ON u.body_hash = s.body_hash WHERE u.body_hash IS NULL OR s.body_hash IS NULL""",
    "SET6": "SELECT path, version, sha256(text) AS hash FROM source_files WHERE version = 'head' OR path NOT IN (SELECT path FROM source_files WHERE version = 'head')",
    "SNK5": """WITH n AS (SELECT unit_id, path FROM units WHERE run_id > 1), k AS (SELECT unit_id FROM units WHERE run_id = 1)
SELECT unit_id, 'repeated in a file' AS problem FROM n GROUP BY unit_id, path HAVING count(*) > 1
UNION ALL SELECT unit_id, 'in several files' FROM n GROUP BY unit_id HAVING count(DISTINCT path) > 1
UNION ALL SELECT DISTINCT unit_id, 'owned by another file' FROM n WHERE unit_id IN (SELECT unit_id FROM k)""",
    "SNK6": RELEASED + """ SELECT rel_id, source_unit_id, target_ref FROM refs WHERE source_unit_id NOT IN (SELECT unit_id FROM rel)
AND coalesce(target_ref, '') NOT IN (SELECT unit_id FROM units WHERE unit_id IS NOT NULL AND unit_id NOT IN (SELECT unit_id FROM live))""",
    "SNK6_scores": RELEASED + """ SELECT DISTINCT source_unit_id, target_unit_id, relation FROM soft_relationships WHERE source_unit_id NOT IN (SELECT unit_id FROM rel) AND target_unit_id NOT IN (SELECT unit_id FROM rel)""",
    "SNK7": W + " SELECT rel_id, coalesce(live.body_hash, '') AS target_hash FROM refs LEFT JOIN live ON live.unit_id = refs.target_ref",
    "SNK8": W + """ SELECT rel_id, 'unknown source' AS problem FROM refs WHERE source_unit_id NOT IN (SELECT unit_id FROM live)
UNION ALL SELECT rel_id, 'empty target' FROM refs WHERE coalesce(target_ref, '') = ''
UNION ALL SELECT rel_id, 'unknown target' FROM refs WHERE target_kind = 'unit' AND target_ref <> '' AND target_ref NOT IN (SELECT unit_id FROM live)""",
    "SNK10": "SELECT body_hash, CAST(max(octet_length(payload)) AS INTEGER) AS n_bytes, count(*) AS n_rows FROM shingles_v2 GROUP BY body_hash",
    "SNK11": f"""WITH {LIVE} SELECT path, '## ' || path || chr(10) || string_agg('- `' || qualname || '` (' || kind || ', ' || start_line || ')', chr(10) ORDER BY start_line, unit_id) AS text FROM live GROUP BY path""",
    "SNK14": "WITH s AS (SELECT path, max(indexed_at) AS seen_at FROM units GROUP BY path) SELECT path FROM source_files JOIN s USING (path) WHERE version = 'head' AND mtime > seen_at",
    "SNK15": f"""WITH {LIVE} SELECT unit_id, CAST(to_json({{'name': name, 'kind': kind, 'concepts': {NAMESJ.format('concepts_json')}[1:8]}}) AS VARCHAR) AS packet FROM live""",
    "SNK16": "SELECT DISTINCT source_unit_id, target_unit_id, left(sha256(concat_ws('|', source_unit_id, target_unit_id)), 10) AS sheet_id FROM soft_relationships WHERE lower(relation) = 'matches'",
}
