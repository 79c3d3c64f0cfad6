"""Compositions: change checks, slice duplication, pairwise metadata, packets, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..operators import fuzzyjoin, graph, intervals
from ..operators.scale import cut, salted_join
from ..session import load
from ..sources.parse import comment_lines
from .edges import EDGES, LIVE, REFS, live, refs
from .index import NAMES
from .parsing import normalised_units
from .similarity import jon3, posts


def top8_files(spark, d):
    """Changed files by the best overlap of whole files that they brought."""
    f = jon3(spark, d)
    return f.groupBy("path").agg(F.max("score").alias("best"), F.count("*").alias("n")).orderBy(F.desc("best"), "path")


def top9(spark, d):
    """Duplication along paths: members of each root's slice with their best judged or
    scored match outside the slice. A slice of n members shuts out n matches at most, so a
    member's n + 3 best are enough for that root, and no hub meets all of its matches."""
    calls = graph.unit_edges(load(spark, d, "hard_relationships"), "CALLS")
    near = cut(graph.neighbours(calls, "out").select(F.col("node").alias("root"), F.col("other").alias("member")), "slices")
    sized = cut(near.join(near.groupBy("root").agg((F.count("*") + 3).alias("enough")), "root"), "slices")
    needed = cut(sized.groupBy("member").agg(F.max("enough").alias("needed")), "needed")
    s = load(spark, d, "soft_relationships").where("score between 0 and 1 and not isnan(score) and source_unit_id <> target_unit_id")
    best = cut(s.groupBy(F.col("source_unit_id").alias("member"), F.col("target_unit_id").alias("match")).agg(F.max("score").alias("score")), "matches")
    order = [F.desc("score"), "match"]
    # In parts first, so that no task sorts all matches of a hub.
    parts = F.row_number().over(Window.partitionBy("member", F.pmod(F.xxhash64("match"), F.lit(64))).orderBy(*order))
    some = salted_join(best, needed, "member", spread=F.xxhash64("match")).withColumn("at", parts).where("at <= needed").drop("at")
    first = cut(some.withColumn("at", F.row_number().over(Window.partitionBy("member").orderBy(*order))).where("at <= needed").drop("needed"), "matches")
    j = salted_join(sized, first, "member", spread=F.xxhash64("root")).where("at <= enough").drop("at", "enough")
    j = j.join(near.select("root", F.col("member").alias("match")), ["root", "match"], "left_anti")
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "member", "match"))
    return j.withColumn("place", place).where("place <= 3").select("root", "place", "member", "match", "score")


def jon15(spark, d):
    """Labels looked up by an order-independent pair key."""
    s = load(spark, d, "soft_relationships").where("source_unit_id <> target_unit_id")
    key = F.concat_ws("|", F.least("source_unit_id", "target_unit_id"), F.greatest("source_unit_id", "target_unit_id"))
    keyed = s.select(key.alias("pair"), F.lower("relation").alias("relation"))
    return keyed.groupBy("pair").agg(F.count_if(F.col("relation") == "similar_to").alias("scored"), F.count_if(F.col("relation") == "matches").alias("judged")).where("scored > 0 and judged > 0")


def jon16(spark, d):
    """Distinct lines that the spans of a file's live units cover; overlaps count once."""
    lines = live(spark, d).select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    return lines.groupBy("path").agg(F.count("*").alias("covered"), F.max("line").alias("last"))


def jon17(spark, d):
    """Recorded calls that an independent, name-based look at the caller's text confirms: on
    any of their lines the name stands before a bracket. Lines meet lines by equality."""
    heads = load(spark, d, "source_files").where("version = 'head'").select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("pos", "said"))
    lines = heads.select("path", (F.col("pos") + 1).alias("line"), "said")
    c = refs(spark, d).where("relation = 'CALLS' and target_kind = 'symbol' and target_ref <> ''").select("rel_id", "path", "lines", F.regexp_extract("target_ref", r"([^.]+)$", 1).alias("name"))
    hit = F.contains("said", F.concat("name", F.lit("(")))
    j = c.select("rel_id", "path", "name", F.explode_outer("lines").alias("line")).join(lines, ["path", "line"], "left")
    return j.groupBy("rel_id").agg(F.coalesce(F.max(hit), F.lit(False)).alias("confirmed"))


def jon18(spark, d):
    """Functions of one metadata: a class for every set of name words and parameter names,
    the two field sets whose token-set score is then 100; one row per function."""
    words = F.array_join(F.array_sort(F.array_distinct(F.split("name", "_"))), " ")
    names = F.array_join(F.transform(F.from_json("parameters_json", "array<struct<name:string>>"), lambda p: p["name"]), ",")
    u = live(spark, d).where("kind <> 'class'").select("unit_id", words.alias("words"), names.alias("parameters"))
    sizes = u.groupBy("words", "parameters").agg(F.min("unit_id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    return u.join(sizes, ["words", "parameters"]).select("unit_id", "class_id", "n")


def jon18_pairs(spark, d):
    """All pairs of functions whose metadata is alike at 0.7 or above: 0.85 of the token-set
    similarity of name, qualified name, purpose and concepts, 0.15 of the signatures'.
    Short functions are in it too. Functions of equal fields are members of one class."""
    text = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("name", "qualname", "purpose")], F.array_join(F.from_json("concepts_json", NAMES), " "))
    u = live(spark, d).where("kind <> 'class'").select(F.col("unit_id").alias("id"), text.alias("text"), "signature")
    return fuzzyjoin.fuzzy_pairs(u, {"text": 0.85, "signature": 0.15}, 0.7)


def jon18_bodies(spark, d):
    """All pairs of functions whose normalised bodies are alike at 0.85 or above. Code that
    can't be parsed or isn't in the head files has no body."""
    u = live(spark, d).where("kind <> 'class'")
    code = intervals.unit_code(u, load(spark, d, "source_files"))
    return fuzzyjoin.fuzzy_pairs(normalised_units(code).select(F.col("unit_id").alias("id"), "text"), {"text": 1.0}, 0.85)


def jon19(spark, d):
    """Attribute-style call targets whose last name only one callable has."""
    one = live(spark, d).where("kind <> 'class'").groupBy("name").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    c = refs(spark, d).where("relation = 'CALLS' and target_kind = 'symbol' and target_ref like '%.%'").select("rel_id", F.regexp_extract("target_ref", r"([^.]+)$", 1).alias("name"))
    return c.join(one, "name").select("rel_id", "name", "unit_id")


def src7(spark, d):
    """Own-line comments of head files, as the tokenizer sees them: a line inside a string
    is none."""
    def run(batches):
        for pdf in batches:
            rows = [(p, n) for p, t in zip(pdf["path"], pdf["text"]) if t for n, line in comment_lines(t) if line.lstrip()[:1] == "#"]
            yield pd.DataFrame(rows, columns=["path", "line"])

    return load(spark, d, "source_files").where("version = 'head'").select("path", "text").mapInPandas(run, "path string, line int")


def aux1(spark, d):
    """JSON columns decoded: how many parameters, concepts and decorators a unit has."""
    n = lambda c: F.size(F.from_json(c, NAMES))
    return live(spark, d).select("unit_id", F.size(F.from_json("parameters_json", "array<struct<name:string>>")).alias("n_parameters"), n("concepts_json").alias("n_concepts"), n("decorators_json").alias("n_decorators"))


def aux2(spark, d):
    """Edges with the hashes of both ends as of now and whether either changed."""
    h = live(spark, d).select("unit_id", "body_hash")
    j = refs(spark, d).join(h.toDF("source_unit_id", "sh"), "source_unit_id").join(h.toDF("target_ref", "th"), "target_ref", "left")
    return j.select("rel_id", (F.coalesce("source_hash", F.lit("")) != F.col("sh")).alias("source_changed"), (F.coalesce("target_hash", F.lit("")) != F.coalesce("th", F.lit(""))).alias("target_changed"))


def aux3(spark, d):
    """Ordinals of repeated declarations: units of one qualified name in line order."""
    w = Window.partitionBy("path", "qualname").orderBy("start_line")
    return live(spark, d).withColumn("ordinal", F.row_number().over(w)).where("ordinal > 1").select("unit_id", "ordinal")


def aux10(spark, d):
    """Items that break a rule: repeated ids, no question, an answer that holds the target."""
    i = load(spark, d, "eval_items")
    again = i.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("repeated id").alias("problem"))
    blank = i.where(stripped(F.coalesce("question", F.lit(""))) == "").select("item_id", F.lit("no question").alias("problem"))
    told = i.where("contains(question, target)").select("item_id", F.lit("names its target").alias("problem"))
    return again.unionByName(blank).unionByName(told)


def aux14(spark, d):
    """Comparable units: kept and left out, with the reason."""
    n = F.col("end_line") - F.col("start_line") + 1
    why = F.when(F.col("kind") == "class", "class").when(n < 5, "short").otherwise("kept")
    return live(spark, d).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


def aux16(spark, d):
    """Directories with at least three files that aren't tests."""
    u = load(spark, d, "units").select("path").distinct().where(~F.col("path").startswith("tests/"))
    return u.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).agg(F.count("*").alias("n")).where("n >= 3")


def aux17(spark, d):
    """Letters for the items of a suite, in digest order, by turns."""
    i = load(spark, d, "eval_items").select("suite", "item_id", F.sha2(F.col("item_id").cast("string"), 256).alias("h"))
    place = F.row_number().over(Window.partitionBy("suite").orderBy("h"))
    return i.select("suite", "item_id", F.char(F.lit(65) + (place - 1) % 26).alias("letter"))


def aux19(spark, d):
    """Commits newest first, with the files they touched."""
    u = load(spark, d, "units").where("git_file_commit is not null")
    return u.groupBy("git_file_commit").agg(F.countDistinct("path").alias("files"), F.max("run_id").alias("run_id"))


QUERIES = {
    "TOP8_files": top8_files, "TOP9": top9, "JON15": jon15, "JON16": jon16, "JON17": jon17, "JON18": jon18, "JON18_pairs": jon18_pairs, "JON18_bodies": jon18_bodies, "JON19": jon19, "SRC7": src7, "AUX1": aux1, "AUX2": aux2, "AUX3": aux3, "AUX10": aux10, "AUX14": aux14, "AUX16": aux16, "AUX17": aux17, "AUX19": aux19,
}

W = f"WITH {LIVE}, {REFS}"
JON3 = f"""WITH {posts("h", "(SELECT * FROM source_files WHERE version = 'head')", "path", "text")}, {posts("b", "(SELECT * FROM source_files WHERE version = 'base')", "path", "text")},
  nh AS (SELECT id, count(*) AS n FROM h GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id), changed AS (SELECT path AS id FROM source_files WHERE version = 'base'),
  n1 AS (SELECT a.id AS path, c.id AS match, count(*) AS shared FROM h a SEMI JOIN changed USING (id) JOIN h c USING (w) WHERE a.id <> c.id GROUP BY ALL HAVING count(*) >= 3),
  t1 AS (SELECT a.id AS path, c.id AS match, count(*) AS shared FROM b a JOIN h c USING (w) WHERE a.id <> c.id GROUP BY ALL HAVING count(*) >= 3),
  now_s AS (SELECT path, match, shared / (x.n + y.n - shared) AS score FROM n1 JOIN nh x ON x.id = path JOIN nh y ON y.id = match),
  then_s AS (SELECT path, match FROM t1 JOIN nb x ON x.id = path JOIN nh y ON y.id = match WHERE shared / (x.n + y.n - shared) >= 0.01)"""

SQL = {
    "TOP8_files": JON3 + " SELECT path, max(score) AS best, count(*) AS n FROM now_s WHERE score >= 0.01 AND (path, match) NOT IN (SELECT (path, match) FROM then_s) GROUP BY path",
    "TOP9": EDGES + """, b AS (SELECT source_unit_id AS member, target_unit_id AS match, max(score) AS score FROM soft_relationships WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND source_unit_id <> target_unit_id GROUP BY ALL),
  j AS (SELECT s.node AS root, b.* FROM step s JOIN b ON b.member = s.other WHERE (s.node, b.match) NOT IN (SELECT (node, other) FROM step)),
  r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, member, match) AS place FROM j) SELECT root, place, member, match, score FROM r WHERE place <= 3""",
    "JON15": """WITH k AS (SELECT concat_ws('|', least(source_unit_id, target_unit_id), greatest(source_unit_id, target_unit_id)) AS pair, lower(relation) AS r FROM soft_relationships WHERE source_unit_id <> target_unit_id),
  g AS (SELECT pair, count(*) FILTER (r = 'similar_to') AS scored, count(*) FILTER (r = 'matches') AS judged FROM k GROUP BY pair) SELECT * FROM g WHERE scored > 0 AND judged > 0""",
    "JON16": f"WITH {LIVE}, l AS (SELECT DISTINCT path, unnest(range(start_line, end_line + 1)) AS line FROM live) SELECT path, count(*) AS covered, CAST(max(line) AS INTEGER) AS last FROM l GROUP BY path",
    "JON17": W + r""", h AS (SELECT path, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM source_files WHERE version = 'head')
SELECT rel_id, bool_or(len(list_filter(coalesce(lines, []), lambda k: coalesce(contains(ls[k], regexp_extract(target_ref, '([^.]+)$', 1) || '('), false))) > 0) AS confirmed
FROM refs LEFT JOIN h USING (path) WHERE relation = 'CALLS' AND target_kind = 'symbol' AND target_ref <> '' GROUP BY rel_id""",
    "JON18": f"""WITH {LIVE}, u AS (SELECT unit_id, array_to_string(list_sort(list_distinct(string_split(name, '_'))), ' ') AS words, array_to_string(CAST(json_extract_string(parameters_json, '$[*].name') AS VARCHAR[]), ',') AS parameters FROM live WHERE kind <> 'class'),
  g AS (SELECT words, parameters, min(unit_id) AS class_id, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 1) SELECT unit_id, class_id, n FROM u JOIN g USING (words, parameters)""",
    "JON19": W + r""", o AS (SELECT name, min(unit_id) AS unit_id FROM live WHERE kind <> 'class' GROUP BY name HAVING count(*) = 1), c AS (SELECT rel_id, regexp_extract(target_ref, '([^.]+)$', 1) AS name FROM refs WHERE relation = 'CALLS' AND target_kind = 'symbol' AND target_ref LIKE '%.%')
SELECT rel_id, name, unit_id FROM c JOIN o USING (name)""",
    "SRC7": r"""WITH l AS (SELECT path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS t, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS line FROM source_files WHERE version = 'head')
SELECT path, CAST(line AS INTEGER) AS line FROM l WHERE regexp_matches(t, '^[ \t]*#')""",
    "AUX1": f"WITH {LIVE} SELECT unit_id, CAST(json_array_length(parameters_json) AS INTEGER) AS n_parameters, CAST(json_array_length(concepts_json) AS INTEGER) AS n_concepts, CAST(json_array_length(decorators_json) AS INTEGER) AS n_decorators FROM live",
    "AUX2": W + """ SELECT rel_id, coalesce(source_hash, '') <> s.body_hash AS source_changed, coalesce(target_hash, '') <> coalesce(t.body_hash, '') AS target_changed
FROM refs JOIN live s ON s.unit_id = source_unit_id LEFT JOIN live t ON t.unit_id = target_ref""",
    "AUX3": f"WITH {LIVE} SELECT unit_id, ordinal FROM (SELECT unit_id, row_number() OVER (PARTITION BY path, qualname ORDER BY start_line) AS ordinal FROM live) WHERE ordinal > 1",
    "AUX10": """SELECT item_id, 'repeated id' AS problem FROM eval_items GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT item_id, 'no question' FROM eval_items WHERE trim(coalesce(question, '')) = ''
UNION ALL SELECT item_id, 'names its target' FROM eval_items WHERE contains(question, target)""",
    "AUX14": f"WITH {LIVE} SELECT CASE WHEN kind = 'class' THEN 'class' WHEN end_line - start_line + 1 < 5 THEN 'short' ELSE 'kept' END AS reason, count(*) AS n FROM live GROUP BY 1",
    "AUX16": "SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n FROM (SELECT DISTINCT path FROM units WHERE NOT starts_with(path, 'tests/')) GROUP BY 1 HAVING count(*) >= 3",
    "AUX17": "SELECT suite, item_id, chr(CAST(65 + (row_number() OVER (PARTITION BY suite ORDER BY sha256(CAST(item_id AS VARCHAR))) - 1) % 26 AS INTEGER)) AS letter FROM eval_items",
    "AUX19": "SELECT git_file_commit, count(DISTINCT path) AS files, max(run_id) AS run_id FROM units WHERE git_file_commit IS NOT NULL GROUP BY git_file_commit",
}
