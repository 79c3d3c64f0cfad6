"""Tags, loaders, set operations, drafts, candidate generators and report drivers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..functions.fuzzy import token_set_udf
from ..operators import build, graph, intervals, search, setsim, unitsim
from ..operators.scale import cut, shared_dir
from ..session import load
from ..sources import loaders
from ..sources.parse import TAG, parse_files
from ..sources.scripts import script_wrappers
from ..sources.tree import parse_excludes
from .edges import BOTH, EDGES, LIVE, MODULE, live, refs
from .evaluation import AGG8, _best, _judged, agg8, agg9
from .index import terms
from .parsing import SCRIPTS, SEARCHES, _heads
from .similarity import DOCS

TREE = "source_files WHERE version = 'head' AND text IS NOT NULL"
N_LINES = r"len(regexp_split_to_array(text, '\r\n|\r|\n'))"


def _tagged(spark, d, before: str, after: str):
    """Head files between two lines of their own; both hold the file's module."""
    h = _heads(spark, d).where("text is not null")
    module = T.edge_module_key(F.col("path"))
    one = lambda line: F.concat(F.lit(f"# {TAG}: {line} area."), module)
    return h.select("path", F.concat_ws("\n", *([one(before)] if before else []), "text", one(after)).alias("text"))


def src6(spark, d):
    """Reject rows: a unit tag at the end of a file stands before no declaration."""
    rows = parse_files(_tagged(spark, d, "", "unit")).where("tag = 'error'")
    return rows.select("path", F.col("text").alias("reason"))


def src8(spark, d):
    """Tagged regions as units: here one around the whole of every head file."""
    rows = parse_files(_tagged(spark, d, "begin", "end")).where("tag = 'region'")
    return rows.select("unit_id", "path", "name", "start_line", "end_line", "purpose")


def src24(spark, d):
    """Excludes of a configuration and those given, once each, in order."""
    found = parse_excludes('excludes = ["build", "vendor", "build"]\n', ["vendor", "dist"])
    return spark.createDataFrame(list(enumerate(found)), "place int, exclude string")


def src26(spark, d):
    """Evaluation items written as JSON and loaded with validation: how many were kept, and
    left out for which reason."""
    place = f"{shared_dir(spark)}/corvane/cases-{uuid.uuid4().hex}"
    load(spark, d, "eval_items").write.json(place)
    kept, left = loaders.load_cases(spark, place)
    return kept.groupBy(F.lit("kept").alias("reason")).agg(F.count("*").alias("n")).unionByName(left)


def set1(spark, d):
    """Union of the ids that units and references name."""
    return live(spark, d).select("unit_id").union(refs(spark, d).select(F.col("source_unit_id").alias("unit_id"))).distinct()


def set2(spark, d):
    """Sizes of union and intersection of the terms of an item's question and answer."""
    q, a = T.query_terms(F.coalesce("question", F.lit(""))), T.query_terms(F.coalesce("answer", F.lit("")))
    return load(spark, d, "eval_items").select("item_id", F.size(F.array_union(q, a)).alias("either"), F.size(F.array_intersect(q, a)).alias("both"))


def set4(spark, d):
    """Changed files: the union of three lists (head differs from base, only in head, touched
    after the last run), once each, Python only."""
    s = load(spark, d, "source_files")
    base, head = s.where("version = 'base'"), s.where("version = 'head'")
    differs = head.join(base.select("path", F.col("text").alias("old")), "path").where(~F.col("text").eqNullSafe(F.col("old"))).select("path")
    added = head.join(base, "path", "left_anti").select("path")
    last = load(spark, d, "index_runs").agg(F.max("finished_at").alias("last"))
    touched = head.join(F.broadcast(last)).where("mtime > last").select("path")  # one row
    return differs.union(added).union(touched).where("path like '%.py'").distinct()


def fn3(spark, d):
    """Documents' windows under the hash that is the same in every process: how many."""
    def run(batches):
        for pdf in batches:
            sets = [C.window_set(t) if len(t := C.code_tokens(x or "")) >= C.LEAST_TOKENS else [] for x in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "n_windows": [len(s) for s in sets]})
            yield out[out["n_windows"] > 0]

    return load(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_windows bigint")


def fn15(spark, d):
    """Metadata similarity of judged pairs of live units, each pair once."""
    u = live(spark, d).select("unit_id", *search.metadata_fields())
    j = _judged(spark, d).select(F.least("q", "item").alias("a"), F.greatest("q", "item").alias("b")).distinct()
    pairs = j.join(u.toDF("a", "text_a", "sig_a"), "a").join(u.toDF("b", "text_b", "sig_b"), "b")
    score = (0.85 * token_set_udf("text_a", "text_b") + 0.15 * token_set_udf("sig_a", "sig_b")) / 100
    return pairs.select("a", "b", score.alias("score"))


def fn20(spark, d):
    """Parameters of the parsed functions, one row each, in order."""
    rows = parse_files(_heads(spark, d)).where("tag = 'unit' and kind <> 'class'")
    p = F.from_json("parameters_json", "array<struct<name:string,type:string,default:string>>")
    return rows.select("unit_id", F.posexplode(p).alias("place", "p")).select("unit_id", "place", "p.name", "p.type", "p.default")


def top7(spark, d):
    """Ranked with expansion and reduced: search, then suppression of near repeats."""
    return search.retrieve(live(spark, d), SEARCHES)


def grf6(spark, d):
    """Call edges of the head files, resolved and grouped."""
    e = build.resolved_calls(parse_files(_heads(spark, d)))
    return e.select("source_unit_id", "target_kind", "target_ref", F.array_join("lines", ",").alias("lines"), F.array_join("resolutions", ",").alias("resolutions"))


def aux5(spark, d):
    """Reject rows: every head file with a line that can't be parsed, its path beside the error."""
    broken = _heads(spark, d).where("text is not null").select("path", F.concat("text", F.lit("\ndef (\n")).alias("text"))
    return parse_files(broken).where("tag = 'error'").select("path", F.split_part("text", F.lit(":"), F.lit(1)).alias("kind"))


def aux6(spark, d):
    """Cached sets read, written and read again: their sizes, and whether they are the same."""
    one = cut(unitsim.read_cache(load(spark, d, "shingles_v2")), "cache")
    again = unitsim.read_cache(unitsim.write_cache(one))
    first = one.groupBy("body_hash").agg(F.max("ws").alias("ws"))
    return first.join(again.withColumnRenamed("ws", "again"), "body_hash").select("body_hash", F.size("ws").alias("n"), (F.col("ws") == F.col("again")).alias("same"))


def aux8(spark, d):
    """Expressions of calls that stay symbols, by how many units hold them."""
    e = build.resolved_calls(parse_files(_heads(spark, d))).where("target_kind = 'symbol'")
    return e.groupBy(F.col("target_ref").alias("expression")).agg(F.countDistinct("source_unit_id").alias("n"))


def aux9(spark, d):
    """Candidate pairs of a clone finder: clones, here recorded call lines and the first lines
    of what they call, mapped to the smallest functions around them; the longest per pair."""
    u = live(spark, d).where("kind <> 'class'")
    c = refs(spark, d).where("relation = 'CALLS' and target_kind = 'unit'").select("path", F.explode("lines").alias("line"), F.col("target_ref").alias("unit_id"))
    clones = c.join(u.select("unit_id", F.col("path").alias("path_b"), F.col("start_line").alias("line_b"), (F.col("end_line") - F.col("start_line") + 1).alias("n_lines")), "unit_id").drop("unit_id").distinct()
    a = intervals.enclosing(clones.select("path", "line"), u, "smallest").withColumnRenamed("unit_id", "a")
    b = intervals.enclosing(clones.select(F.col("path_b").alias("path"), F.col("line_b").alias("line")), u, "smallest").toDF("path_b", "line_b", "b")
    pairs = clones.join(a, ["path", "line"]).join(b, ["path_b", "line_b"]).where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).agg(F.max("n_lines").alias("n_lines"))


def aux11(spark, d):
    """Per case besides the metrics: size of the pool, place of the first relevant item without
    a limit, and relevant items one call step from an item of the first eight."""
    best = cut(_best(spark, d), "best")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "item")))
    rel = _judged(spark, d).where("score >= 0.6").select("q", "item")
    pool = best.groupBy("q").agg(F.count("*").alias("pool"))
    first = rel.join(ranked, ["q", "item"]).groupBy("q").agg(F.min("place").alias("first_place"))
    near = graph.neighbours(graph.unit_edges(load(spark, d, "hard_relationships"), "CALLS"), "both")
    reach = ranked.where("place <= 8").select("q", F.col("item").alias("node")).join(near, "node").select("q", F.col("other").alias("item")).distinct()
    reached = rel.join(reach, ["q", "item"], "left_semi").groupBy("q").agg(F.count("*").alias("reached"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return agg8(spark, d).select("q", "hit_k", "recall").join(pool, "q", "left").join(first, "q", "left").join(reached, "q", "left").select("q", "hit_k", "recall", zero("pool"), "first_place", zero("reached"))


def aux12(spark, d):
    """One JSON report of the retrieval figures."""
    a = agg9(spark, d)
    return a.select(F.to_json(F.struct("cases", F.struct("hit_1", "hit_k", "recall", "mrr").alias("rates"))).alias("report"))


def aux15(spark, d):
    """Bytes that a case costs: of its answer if there is one, else of its question."""
    return load(spark, d, "eval_items").select("item_id", F.coalesce(F.octet_length("answer"), F.octet_length("question"), F.lit(0)).alias("n_bytes"))


def aux18(spark, d):
    """Names that each function of the head files calls, itself or in functions within."""
    parsed = cut(parse_files(_heads(spark, d)), "parsed")
    u = parsed.where("tag = 'unit' and kind <> 'class'").select("unit_id", "path", "start_line", "end_line")
    calls = parsed.where("tag = 'call'").select("path", "line", "name").distinct()
    inside = intervals.containing(calls, u)
    return inside.join(calls, ["path", "line"]).groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


DOMAINS, TEMPLATES = ["order", "user", "report", "cache"], ["load", "save", "drop", "merge", "count"]


def aux20(spark, d):
    """A synthetic corpus: every template for every domain, as source that is parsed."""
    domains = spark.createDataFrame([(x,) for x in DOMAINS], "domain string")
    each = domains.select("domain", F.explode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("verb"))
    text = F.format_string('def %s_%s(store, key):\n    """Look a %s up and %s it."""\n    return store.%s(key)\n', "verb", "domain", "domain", "verb", "verb")
    files = each.select(F.format_string("gen/%s_%s.py", "domain", "verb").alias("path"), text.alias("text"))
    return parse_files(files).where("tag = 'unit'").select("unit_id", "signature", "purpose")


def snk2(spark, d):
    """Units of an index of the tree as of base, with only its changed files updated."""
    s = load(spark, d, "source_files")
    head, base = s.where("version = 'head'").select("path", "text"), s.where("version = 'base'").select("path", "text")
    index = build.Index(spark, f"{shared_dir(spark)}/corvane/index-{uuid.uuid4().hex}")
    index.rebuild(head.join(base, "path", "left_anti").unionByName(base))
    index.update(head.join(base.select("path"), "path", "left_semi"), tree=head)
    return index.units().select("unit_id", "path", "start_line", "end_line")


def snk3(spark, d):
    """Units of the first file with a base version, after an update of that one path."""
    s = load(spark, d, "source_files")
    head, base = s.where("version = 'head'").select("path", "text"), s.where("version = 'base'").select("path", "text")
    index = build.Index(spark, f"{shared_dir(spark)}/corvane/index-{uuid.uuid4().hex}")
    index.rebuild(head.join(base, "path", "left_anti").unionByName(base))
    path = base.agg(F.min("path")).first()[0]
    index.update_file(path, head)
    return index.units().where(F.col("path") == path).select("unit_id", "path", "start_line", "end_line")


def src12(spark, d):
    """Names of functions that hand their first parameter to fetch."""
    return script_wrappers(spark.createDataFrame(SCRIPTS, "path string, text string"))


def jon1_exact(spark, d):
    """Pairs of classes of documents with equal windows at the floor, however many documents
    share a window."""
    return setsim.exact_pairs(load(spark, d, "documents"), "doc_id", "text", members=False)[0]


def jon1_members(spark, d):
    """The class of every document of enough tokens."""
    return setsim.exact_pairs(load(spark, d, "documents"), "doc_id", "text")[1]


QUERIES = {
    "SRC6": src6, "SRC8": src8, "SRC24": src24, "SRC26": src26, "SET1": set1, "SET2": set2, "SET4": set4, "FN3": fn3, "FN15": fn15, "FN20": fn20, "TOP7": top7, "GRF6": grf6, "AUX5": aux5, "AUX6": aux6, "AUX8": aux8,
    "AUX9": aux9, "AUX11": aux11, "AUX12": aux12, "AUX15": aux15, "AUX18": aux18, "AUX20": aux20, "SNK2": snk2, "SNK3": snk3, "SRC12": src12, "JON1_exact": jon1_exact, "JON1_members": jon1_members,
}

#: White space of any script splits tokens here.
SPACED = DOCS.replace(r"[^\s\p{L}\p{N}_]", r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}\p{L}\p{N}_]")
SMALLEST = "row_number() OVER (PARTITION BY {0} ORDER BY l.end_line - l.start_line, l.start_line, l.end_line, l.unit_id)"
CLASSES = f"""WITH {DOCS}, sets AS (SELECT id, list_sort(list(w)) AS ws FROM p GROUP BY id), cls AS (SELECT ws, min(id) AS rep, count(*) AS class_size FROM sets GROUP BY ws)"""

SQL = {
    "SRC6": f"SELECT path, 'ValueError: line ' || ({N_LINES} + 1) || ': tag area.' || {MODULE} || ' stands before no declaration' AS reason FROM {TREE}",
    "SRC8": f"""SELECT 'area.' || m AS unit_id, path, regexp_extract(m, '([^.:/-]+)$', 1) AS name, 2::INTEGER AS start_line, CAST({N_LINES} + 1 AS INTEGER) AS end_line,
  array_to_string(list_sort(list_distinct(list_concat(['area.' || m], list_transform(list_filter(regexp_split_to_array('area.' || m, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))))), ' ') AS purpose
FROM (SELECT *, {MODULE} AS m FROM {TREE})""",
    "SRC24": "SELECT * FROM (VALUES (0, 'build'), (1, 'vendor'), (2, 'dist')) t(place, exclude)",
    "SRC26": """WITH r AS (SELECT CASE WHEN item_id IS NULL THEN 'no id' WHEN trim(coalesce(question, '')) = '' THEN 'no question' WHEN count(*) OVER (PARTITION BY item_id) > 1 THEN 'repeated id' ELSE 'kept' END AS reason FROM eval_items)
SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    "SET1": f"{BOTH} SELECT unit_id FROM live UNION SELECT source_unit_id FROM refs",
    "SET2": f"""SELECT item_id, len(list_distinct(list_concat(q, a))) AS either, len(list_intersect(q, a)) AS "both" FROM (SELECT item_id, {terms("coalesce(question, '')")} AS q, {terms("coalesce(answer, '')")} AS a FROM eval_items)""",
    "SET4": """WITH b AS (SELECT path, text FROM source_files WHERE version = 'base'), h AS (SELECT path, text, mtime FROM source_files WHERE version = 'head')
SELECT path FROM (SELECT h.path FROM h JOIN b USING (path) WHERE h.text IS DISTINCT FROM b.text UNION SELECT path FROM h WHERE path NOT IN (SELECT path FROM b) UNION SELECT path FROM h WHERE mtime > (SELECT max(finished_at) FROM index_runs)) WHERE path LIKE '%.py'""",
    "FN3": f"WITH {SPACED} SELECT id AS doc_id, count(*) AS n_windows FROM p GROUP BY id",
    "FN20": f"""WITH {LIVE}, p AS (SELECT unit_id, json_extract(parameters_json, '$[*]') AS ps FROM live WHERE kind <> 'class'), e AS (SELECT unit_id, unnest(ps) AS p, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS place FROM p)
SELECT unit_id, place, json_extract_string(p, '$.name') AS name, json_extract_string(p, '$.type') AS type, json_extract_string(p, '$.default') AS "default" FROM e""",
    "AUX5": f"SELECT path, 'SyntaxError' AS kind FROM {TREE}",
    "AUX9": f"""{BOTH}, f AS (SELECT * FROM live WHERE kind <> 'class'), c AS (SELECT DISTINCT refs.path, unnest(lines) AS line, target_ref FROM refs WHERE relation = 'CALLS' AND target_kind = 'unit'),
  clones AS (SELECT DISTINCT c.path, c.line, f.path AS path_b, f.start_line AS line_b, f.end_line - f.start_line + 1 AS n_lines FROM c JOIN f ON f.unit_id = c.target_ref),
  a AS (SELECT * FROM (SELECT x.path, x.line, l.unit_id AS a, {SMALLEST.format('x.path, x.line')} AS r FROM (SELECT DISTINCT path, line FROM clones) x JOIN f l ON l.path = x.path AND x.line BETWEEN l.start_line AND l.end_line) WHERE r = 1),
  b AS (SELECT * FROM (SELECT x.path_b, x.line_b, l.unit_id AS b, {SMALLEST.format('x.path_b, x.line_b')} AS r FROM (SELECT DISTINCT path_b, line_b FROM clones) x JOIN f l ON l.path = x.path_b AND x.line_b BETWEEN l.start_line AND l.end_line) WHERE r = 1)
SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, max(n_lines) AS n_lines FROM clones JOIN a USING (path, line) JOIN b USING (path_b, line_b) WHERE a <> b GROUP BY 1, 2""",
    "AUX11": AGG8.replace(f"WITH RECURSIVE {LIVE}", EDGES, 1) + """, pool AS (SELECT q, count(*) AS pool FROM best GROUP BY q), fst AS (SELECT rel.q, CAST(min(place) AS INTEGER) AS first_place FROM rel JOIN ranked r ON r.q = rel.q AND r.item = rel.item GROUP BY rel.q),
  reach AS (SELECT DISTINCT q, other AS item FROM ranked JOIN near ON near.node = ranked.item WHERE place <= 8), got AS (SELECT rel.q, count(*) AS reached FROM rel JOIN reach ON reach.q = rel.q AND reach.item = rel.item GROUP BY rel.q)
SELECT q, hit_k, recall, coalesce(pool, 0) AS pool, first_place, coalesce(reached, 0) AS reached FROM agg8 LEFT JOIN pool USING (q) LEFT JOIN fst USING (q) LEFT JOIN got USING (q)""",
    "AUX15": "SELECT item_id, coalesce(octet_length(encode(answer)), octet_length(encode(question)), 0) AS n_bytes FROM eval_items",
    "AUX20": f"""SELECT 'gen.' || d || '_' || v || '::' || v || '_' || d AS unit_id, v || '_' || d || '(store, key)' AS signature, 'Look a ' || d || ' up and ' || v || ' it.' AS purpose
FROM (SELECT unnest({DOMAINS}) AS d) x, (SELECT unnest({TEMPLATES}) AS v) y""",
    "SNK2": f"WITH {LIVE} SELECT unit_id, path, start_line, end_line FROM live",
    "SNK3": f"WITH {LIVE} SELECT unit_id, path, start_line, end_line FROM live WHERE path = (SELECT min(path) FROM source_files WHERE version = 'base')",
    "SRC12": "SELECT 'call' AS name",
    "JON1_exact": CLASSES + """, reps AS (SELECT rep FROM cls), q AS (SELECT p.* FROM p JOIN reps ON rep = id), n AS (SELECT id, count(*) AS n FROM q GROUP BY id),
  s AS (SELECT a.id AS rep_a, b.id AS rep_b, count(*) AS shared FROM q a JOIN q b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT rep_a, rep_b, shared, shared / (x.n + y.n - shared) AS score FROM s JOIN n x ON x.id = rep_a JOIN n y ON y.id = rep_b WHERE shared >= 3 AND shared / (x.n + y.n - shared) >= 0.27""",
    "JON1_members": CLASSES + " SELECT id, rep, class_size FROM sets JOIN cls USING (ws)",
}
