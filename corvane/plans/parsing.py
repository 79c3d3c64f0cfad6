"""Parsing, search and route queries."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import text as T
from ..functions.fuzzy import token_set_udf, weighted_udf
from ..operators import routes as R
from ..operators import search as S
from ..operators import unitsim
from ..operators.scale import cut
from ..session import load
from ..sources.parse import parse_files, router_prefixes
from ..sources.scripts import scan_scripts
from .edges import LIVE, MODULE, REFS, live, refs

SEARCHES = ["save the tracked report", "read cfg of the repo", "merge sorted buckets by score", "drop late tokens after the run"]

#: Our own small script files: a literal, a template, a computed and an external url, a
#: comment, a quoted call, verbs and a wrapper used from another file.
SCRIPTS = [
    ("web/api.js", "export function call(url, opts) {\n  return fetch(url, opts)\n}\nfetch('/items/' )\n// fetch('/no')\nconst s = \"fetch('/no')\"\n"),
    ("web/page.js", "call('/users/1', { method: 'POST' })\naxios.delete(`/users/${id}`)\nfetch('https://other/x')\nfetch(makeUrl())\nwindow.fetch('/late')\n"),
]


def _heads(spark, d):
    return load(spark, d, "source_files").where("version = 'head'").select("path", "text")


def normalised(text):
    """Normalised code, None where it isn't valid."""
    try:
        return C.strip_documentation(text)
    except (SyntaxError, ValueError, TypeError):
        return None


def src4(spark, d):
    """Units parsed from the head files."""
    return parse_files(_heads(spark, d)).where("tag = 'unit'").select("unit_id", "path", "kind", "name", "qualname", "start_line", "end_line")


def src5(spark, d):
    """Signatures and parameters of the parsed functions."""
    return parse_files(_heads(spark, d)).where("tag = 'unit' and kind <> 'class'").select("unit_id", "signature", "parameters_json", "decorators_json")


def fn18_units(spark, d):
    """Hashes of the units' own lines, as the parser takes them."""
    return parse_files(_heads(spark, d)).where("tag = 'unit'").select("unit_id", "body_hash")


def fn21_concepts(spark, d):
    """Concepts of the parsed units: name, id and their words."""
    found = parse_files(_heads(spark, d)).where("tag = 'unit'")
    return found.select("unit_id", F.array_join(F.from_json("concepts_json", "array<string>"), " ").alias("concepts"))


def src4_errors(spark, d):
    """Files of any version that can't be parsed, with the reason."""
    return parse_files(load(spark, d, "source_files").select("path", "text")).where("tag = 'error'").select("path", F.col("text").alias("reason"))


def _with(spark, d, *lines):
    """The head files with lines of their own at the end, which every file can be read with."""
    h = _heads(spark, d).where("text is not null")
    return h.select("path", F.concat_ws("\n", "text", *lines).alias("text"))


def src9(spark, d):
    """Router prefixes, here of a router that every head file defines at its end."""
    return router_prefixes(_with(spark, d, F.lit("router = APIRouter(prefix='/area')"), F.lit("other = APIRouter()")))


def src10(spark, d):
    """Prefixes of mounted routers, recorded for the module that defines the router: every
    head file mounts the router of a module of its own name."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.py$", 1), r"\W", "_")
    mounted = F.concat(F.lit("from area."), name, F.lit(" import router as r\napp.include_router(r, prefix='/"), name, F.lit("')"))
    return router_prefixes(_with(spark, d, mounted))


def fn22(spark, d):
    """Call expressions by how often they occur."""
    return parse_files(_heads(spark, d)).where("tag = 'call'").groupBy("name").agg(F.count("*").alias("n"))


def src11(spark, d):
    return scan_scripts(spark.createDataFrame(SCRIPTS, "path string, text string"))


def fn2(spark, d):
    """Functions of the head files in canonical form, as digests."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    rows += [(path, line, C.normal_code(node)) for line, of_def, node in C.declarations(text or "") if of_def]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "line", "text"])

    found = _heads(spark, d).mapInPandas(run, "path string, line int, text string")
    return found.select("path", "line", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def fn23(spark, d):
    """Head files without documentation and layout, as digests."""
    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[normalised(t) for t in pdf["text"]])

    return _heads(spark, d).mapInPandas(run, "path string, text string").select("path", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def normalised_units(code):
    """(unit_id, text) of units' code (unit_id, code), normalised; code that isn't valid
    has no row. A method's lines are indented and stand in a block of their own here."""
    def body(text):
        tree = normalised("if 1:\n" + text if text[:1].isspace() else text)
        return textwrap.dedent(tree.removeprefix("if 1:")).strip("\n") if tree and text[:1].isspace() else tree

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"unit_id": pdf["unit_id"], "text": [body(t) for t in pdf["code"]]}).dropna()

    return code.select("unit_id", "code").mapInPandas(run, "unit_id string, text string")


def _unit_sets(spark, d):
    return cut(unitsim.unit_windows(live(spark, d), _heads(spark, d)), "unit-sets")


def fn5(spark, d):
    """Window sets of the comparable units: tokens and windows; none if too small."""
    return _unit_sets(spark, d).select("unit_id", "n_tokens", F.size("ws").alias("n_windows"))


def fn7(spark, d):
    """Lines at which a function of the head files may be looked up."""
    return unitsim.declared_windows(_heads(spark, d)).groupBy("path", "line").agg(F.max_by("name", "of_def").alias("name"), F.max("of_def").alias("of_def"))


def fn11(spark, d):
    """Similarity of each unit's name with its purpose."""
    spaced = F.replace("name", F.lit("_"), F.lit(" "))
    return live(spark, d).select("unit_id", weighted_udf(spaced, F.lower("purpose")).alias("weighted"), token_set_udf(spaced, F.lower("purpose")).alias("token_set"))


def fn14(spark, d):
    """Variants of the searches and their weights."""
    return S.expand(S.query_table(spark, SEARCHES)).where("weight is not null").select("query", F.col("asked").alias("variant"), "weight")


def fn12(spark, d):
    """Scores of the six fields of every unit for the first search."""
    return S.scores(live(spark, d), S.query_table(spark, SEARCHES[:1])).select("unit_id", *S.WEIGHTS, "score")


def top4(spark, d):
    return S.search(live(spark, d), SEARCHES)


def top5(spark, d):
    return S.search(live(spark, d), SEARCHES, expansion=True)


def top6(spark, d):
    return S.without_repeats(top5(spark, d), live(spark, d))


def top4_types(spark, d):
    return S.search(live(spark, d), SEARCHES, inputs=["str", "int"], returns="list[str]")


def _endpoints(spark, d):
    """Endpoints: units under a hook decorator, read as a GET route of the hook's argument."""
    hook = F.regexp_extract("decorators_json", r"hook\('([^']+)'\)", 1)
    as_get = F.replace("decorators_json", F.lit(".hook("), F.lit(".get("))
    return live(spark, d).where(hook != "").select("unit_id", "path", F.lit("GET").alias("method"), hook.alias("route"), as_get.alias("decorators_json"))


def _prefixes(spark, d):
    """The area of the tree is the prefix of a module's registry."""
    area = F.concat(F.lit("/"), F.split_part("path", F.lit("/"), F.lit(3)), F.lit("/"))
    return live(spark, d).select(T.edge_module_key(F.col("path")).alias("module"), F.lit("registry").alias("router"), area.alias("prefix")).distinct()


def jon11(spark, d):
    return R.full_routes(_endpoints(spark, d), _prefixes(spark, d)).select("unit_id", "method", F.col("full_route").alias("route"))


def _calls(spark, d):
    """Client calls: script file and line, with a url made of the script's name."""
    ref = F.col("target_ref")
    c = refs(spark, d).where("target_kind = 'client_call' and target_ref <> ''").select("target_ref").distinct()
    stem = F.regexp_extract(ref, r"([^/]+)\.js:\d+$", 1)
    return c.select("target_ref", F.regexp_extract(ref, r"^(.*):\d+$", 1).alias("path"), F.regexp_extract(ref, r":(\d+)$", 1).cast("int").alias("line"), F.concat(F.lit("/"), stem, F.lit("/?q=1")).alias("url"), F.lit("GET").alias("method"))


def _bound(spark, d):
    routes = R.full_routes(_endpoints(spark, d), _prefixes(spark, d).limit(0))
    return R.bound_calls(_calls(spark, d), routes)


def jon12(spark, d):
    """Client calls bound to the one owner of their method and pattern."""
    return _bound(spark, d).where("unit_id is not null").select("target_ref", "pattern", "unit_id")


def jon14(spark, d):
    """Coverage: calls bound and not."""
    return _bound(spark, d).agg(F.count("*").alias("calls"), F.count("unit_id").alias("bound"))


def flt9(spark, d):
    """Why a call isn't bound."""
    return _bound(spark, d).where("unit_id is null").select("target_ref", R.unbound_reason(F.col("url")).alias("reason"))


def flt7(spark, d):
    return jon11(spark, d).where(F.contains(F.lower("route"), F.lit("st")) | F.contains(F.lower("unit_id"), F.lit("st"))).select("unit_id", "route")


def jon2_units(spark, d):
    """Each comparable unit's best matches among the others, at the floor."""
    sets = _unit_sets(spark, d)
    needles = sets.where("size(ws) > 0").select(F.col("unit_id").alias("needle_id"), F.col("unit_id").alias("self_id"), "ws")
    return unitsim.similar_units(needles, sets)


def fn6(spark, d):
    """Answers that are drafts: windows of their top-level functions, or why there are none."""
    def run(batches):
        for pdf in batches:
            sizes, errors = [], []
            for text in pdf["answer"]:
                try:
                    sizes.append(len(C.draft_windows(text or "")))
                    errors.append(None)
                except (SyntaxError, ValueError) as e:
                    sizes.append(0)
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"item_id": pdf["item_id"], "n_windows": sizes, "error": errors})

    return load(spark, d, "eval_items").select("item_id", "answer").mapInPandas(run, "item_id bigint, n_windows int, error string")


def _changed(spark, d):
    """Head files whose text isn't that of base, or that base lacks."""
    s = load(spark, d, "source_files")
    base = s.where("version = 'base'").select("path", F.sha2("text", 256).alias("old"))
    head = s.where("version = 'head'").select("path", "text")
    return head.join(base, "path", "left").where(~F.col("old").eqNullSafe(F.sha2("text", 256))).select("path", "text")


def jon3(spark, d):
    """Overlaps that changed functions brought, per function, at the floor."""
    s = load(spark, d, "source_files")
    sets = _unit_sets(spark, d)
    changed = sets.join(_changed(spark, d).select("path"), "path", "left_semi")  # sets of head files are there already
    return unitsim.check_changes(changed, unitsim.base_functions(s.where("version = 'base'")), sets)


def top8(spark, d):
    """Findings of a change check: changed functions by their best match."""
    f = jon3(spark, d)
    return f.groupBy("unit_id").agg(F.max("score").alias("best"), F.count("*").alias("n")).orderBy(F.desc("best"), "unit_id")


def src15(spark, d):
    """Baseline functions by bare name per changed file; the last definition wins."""
    return unitsim.base_functions(load(spark, d, "source_files").where("version = 'base'")).select("path", "name", "line")


def jon13(spark, d):
    """Handlers with the client lines that call them: "file:line — METHOD url" of each edge."""
    h = load(spark, d, "hard_relationships").where("relation = 'FETCHED_BY' and source_unit_id is not null")
    e = F.from_json("evidence_json", "method string, url string")
    ref = F.regexp_replace("target_ref", r"^\s+|\s+$", "")
    line = F.concat_ws("", ref, F.lit(" — "), F.coalesce(e["method"], F.lit("")), F.lit(" "), F.coalesce(e["url"], F.lit("")))
    rows = h.where(ref != "").select(F.col("source_unit_id").alias("unit_id"), line.alias("line"))
    return rows.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("callers"))


QUERIES = {
    "SRC4": src4, "SRC5": src5, "SRC4_errors": src4_errors, "SRC9": src9, "SRC10": src10, "SRC11": src11, "SRC15": src15, "FN2": fn2, "FN5": fn5, "FN6": fn6, "FN7": fn7, "FN11": fn11, "FN12": fn12, "FN14": fn14, "FN18_units": fn18_units, "FN21_concepts": fn21_concepts, "FN22": fn22, "FN23": fn23, "TOP4": top4, "TOP5": top5, "TOP6": top6, "TOP4_types": top4_types,
    "JON2_units": jon2_units, "JON3": jon3, "TOP8": top8, "JON11": jon11, "JON12": jon12, "JON13": jon13, "JON14": jon14, "FLT7": flt7, "FLT9": flt9,
}

ROUTES = rf"""WITH {LIVE}, {REFS}, e AS (SELECT unit_id, 'GET' AS method, regexp_extract(decorators_json, 'hook\(''([^'']+)''\)', 1) AS route, split_part(path, '/', 3) AS area FROM live WHERE regexp_matches(decorators_json, 'hook\(''[^'']+''\)')),
  j11 AS (SELECT unit_id, method, '/' || area || '/' || route AS route FROM e),
  calls AS (SELECT DISTINCT target_ref, '/' || regexp_extract(target_ref, '([^/]+)\.js:\d+$', 1) AS pattern FROM refs WHERE target_kind = 'client_call' AND target_ref <> ''),
  sole AS (SELECT '/' || route AS pattern, min(unit_id) AS unit_id FROM e GROUP BY route HAVING count(DISTINCT unit_id) = 1),
  j12 AS (SELECT target_ref, pattern, unit_id FROM calls JOIN sole USING (pattern))
"""
SQL = {
    "SRC4": f"WITH {LIVE} SELECT unit_id, path, kind, name, qualname, start_line, end_line FROM live",
    "SRC5": f"WITH {LIVE} SELECT unit_id, signature, parameters_json, decorators_json FROM live WHERE kind <> 'class'",
    "FN18_units": rf"""WITH {LIVE}, h AS (SELECT path, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM source_files WHERE version = 'head')
SELECT unit_id, left(sha256(array_to_string(ls[start_line:end_line], chr(10))), 12) AS body_hash FROM live JOIN h USING (path)""",
    "FN21_concepts": rf"""WITH {LIVE} SELECT unit_id, array_to_string(list_sort(list_distinct(list_concat([name, unit_id], list_transform(list_filter(regexp_split_to_array(name || ' ' || unit_id, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x))))), ' ') AS concepts FROM live""",
    "SRC9": f"SELECT DISTINCT {MODULE} AS module, 'router' AS router, '/area' AS prefix FROM source_files WHERE version = 'head' AND text IS NOT NULL",
    "SRC10": r"""SELECT DISTINCT 'area.' || n AS module, 'router' AS router, '/' || n AS prefix FROM (
  SELECT regexp_replace(regexp_extract(path, '([^/]+)\.py$', 1), '\W', '_', 'g') AS n FROM source_files WHERE version = 'head' AND text IS NOT NULL)""",
    "JON13": r"""SELECT source_unit_id AS unit_id, string_agg(DISTINCT ref || ' — ' || m || ' ' || u, chr(10) ORDER BY ref || ' — ' || m || ' ' || u) AS callers FROM (
  SELECT source_unit_id, regexp_replace(target_ref, '^\s+|\s+$', '', 'g') AS ref, coalesce(json_extract_string(evidence_json, '$.method'), '') AS m, coalesce(json_extract_string(evidence_json, '$.url'), '') AS u
  FROM hard_relationships WHERE relation = 'FETCHED_BY' AND source_unit_id IS NOT NULL) WHERE ref <> '' GROUP BY source_unit_id""",
    "JON11": ROUTES + "SELECT * FROM j11",
    "JON12": ROUTES + "SELECT * FROM j12",
    "JON14": ROUTES + "SELECT count(*) AS calls, count(unit_id) AS bound FROM calls LEFT JOIN j12 USING (target_ref)",
    "FLT7": ROUTES + "SELECT unit_id, route FROM j11 WHERE contains(lower(route), 'st') OR contains(lower(unit_id), 'st')",
    "FLT9": ROUTES + "SELECT target_ref, CASE WHEN pattern = '' THEN 'computed' WHEN contains(pattern, '{}') THEN 'interpolated' ELSE 'no route' END AS reason FROM calls WHERE target_ref NOT IN (SELECT target_ref FROM j12)",
}
