"""Evaluation queries: scored links as rankings, judged links as labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, TERM, TOKEN, query_terms, stripped
from ..operators import evaluation as E
from ..operators import graph
from ..session import load
from .edges import EDGES, LIVE, live

OK = "score is not null and not isnan(score) and score between 0 and 1 and source_unit_id <> target_unit_id"


def _scored(spark, d):
    s = load(spark, d, "soft_relationships").where("lower(relation) = 'similar_to' and " + OK)
    return s.groupBy(F.col("source_unit_id").alias("q"), F.col("target_unit_id").alias("item"), "provenance").agg(F.max("score").alias("score"))


def _best(spark, d):
    return _scored(spark, d).groupBy("q", "item").agg(F.max("score").alias("score"))


def _judged(spark, d):
    s = load(spark, d, "soft_relationships").where("lower(relation) = 'matches' and " + OK)
    return s.groupBy(F.col("source_unit_id").alias("q"), F.col("target_unit_id").alias("item")).agg(F.max("score").alias("score"))


def agg8(spark, d):
    return E.case_metrics(E.ranking(_best(spark, d)), _judged(spark, d).where("score >= 0.6").select("q", "item"))


def agg9(spark, d):
    mean = lambda c: F.round(F.avg(c), 9)
    return agg8(spark, d).agg(F.count("*").alias("cases"), mean("hit_1").alias("hit_1"), mean("hit_k").alias("hit_k"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"))


def agg10(spark, d):
    """Units by kind, documentation and test file, with all subtotals."""
    u = live(spark, d).select("kind", (stripped(F.coalesce("doc_text", F.lit(""))) != "").alias("documented"), F.col("path").startswith("tests/").alias("in_tests"))
    return u.cube("kind", "documented", "in_tests").agg(F.count("*").alias("n"))


def _returned(spark, d):
    r = _scored(spark, d)
    place = F.row_number().over(Window.partitionBy("provenance", "q").orderBy(F.desc("score"), "item"))
    return r.withColumn("place", place).where("place <= 3").select(F.col("provenance").alias("arm"), F.concat_ws("|", "q", "item").alias("pair"))


def _labels(spark, d):
    return _judged(spark, d).select(F.concat_ws("|", "q", "item").alias("pair"), (F.col("score") >= 0.6).alias("positive"))


def agg11(spark, d):
    return E.pair_scores(_returned(spark, d), _labels(spark, d))


def agg12(spark, d):
    """Strict and lenient precision of labelled items, over all rows and as a mean over cases."""
    label = F.when(F.col("grade") >= 0.8, "relevant").when(F.col("grade") >= 0.6, "plausible").otherwise("irrelevant")
    j = E.ranking(_best(spark, d)).where("place <= 8").join(_judged(spark, d).withColumnRenamed("score", "grade"), ["q", "item"]).withColumn("label", label)
    per = j.groupBy("q").agg(F.count_if(F.col("label") == "relevant").alias("r"), F.count_if(F.col("label") != "irrelevant").alias("l"), F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("labelled"), (F.sum("r") / F.sum("n")).alias("strict"), (F.sum("l") / F.sum("n")).alias("lenient"), F.round(F.avg(F.col("r") / F.col("n")), 9).alias("strict_macro"))


def agg15(spark, d):
    """Gold recall per floor: judged matches whose score reaches it."""
    s = _judged(spark, d).where("score >= 0.6").join(_best(spark, d).withColumnRenamed("score", "found"), ["q", "item"], "left")
    g = s.select(F.coalesce("found", F.lit(0.0)).alias("found"), F.explode(F.sequence(F.lit(20), F.lit(60), F.lit(5))).alias("c"))
    return g.groupBy((F.col("c") / 100).alias("floor")).agg((F.count_if(F.col("found") >= F.col("c") / 100) / F.count("*")).alias("recall"))


def agg19(spark, d):
    """Precision, recall and F1 of each source's items at 0.5 against its judged matches."""
    answer = _best(spark, d).where("score >= 0.5").groupBy("q").agg(F.collect_set("item").alias("a"))
    gold = _judged(spark, d).where("score >= 0.6").groupBy("q").agg(F.collect_set("item").alias("g"))
    j = gold.join(answer, "q", "left").select("q", F.size(F.coalesce(F.array_intersect("a", "g"), F.array())).alias("both"), F.size(F.coalesce("a", F.array())).alias("na"), F.size("g").alias("ng"))
    p, r = F.when(F.col("na") > 0, F.col("both") / F.col("na")).otherwise(0.0), F.col("both") / F.col("ng")
    return j.select("q", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def _diffs(spark, d):
    """Differences of the two arms' scores of a pair, per relation of the source's kind."""
    arms = _scored(spark, d).groupBy("q", "item").pivot("provenance", ["metadata", "shingle-overlap"]).agg(F.max("score")).dropna()
    u = live(spark, d).select(F.col("unit_id").alias("q"), F.col("kind").alias("arm"))
    return arms.join(u, "q").select("arm", F.concat_ws("|", "q", "item").alias("pair"), (F.col("metadata") - F.col("shingle-overlap")).alias("diff"))


def agg20(spark, d):
    return E.sign_flip(_diffs(spark, d))


def agg20_bootstrap(spark, d):
    return E.bootstrap_lower(_diffs(spark, d))


def agg21(spark, d):
    """Power of the sign-flip test over n, tie rate and the share of pairs in favour."""
    grid = [(n, t, p) for n in (30, 40, 60) for t in (0.3, 0.5, 0.7) for p in (0.5, 0.7, 0.85, 1.0)]
    cells = spark.createDataFrame(grid, "n int, tie_rate double, p_up double").repartition(len(grid))
    run = lambda it: (p.assign(power=[E.power(*row) for row in zip(p["n"], p["tie_rate"], p["p_up"])]) for p in it)
    return cells.mapInPandas(run, "n int, tie_rate double, p_up double, power double")


def aux13(spark, d):
    """Paired differences of the arms: pairs that both scored, and how many favour which."""
    return _diffs(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"), F.count_if(F.col("diff") == 0).alias("ties"))


def mcnemar(spark, d):
    """Discordant pairs of the two arms at 0.5 and the exact two-sided binomial tail."""
    p = _scored(spark, d).groupBy("q", "item").pivot("provenance", ["metadata", "shingle-overlap"]).agg(F.max("score")).dropna()
    c = p.agg(F.count_if((F.col("metadata") >= 0.5) & (F.col("shingle-overlap") < 0.5)).alias("b"), F.count_if((F.col("metadata") < 0.5) & (F.col("shingle-overlap") >= 0.5)).alias("c"))
    k, n = F.least("b", "c"), F.col("b") + F.col("c")
    return c.select("b", "c", k.alias("k"), n.alias("n"), F.round(E.binomial_p(k, n), 9).alias("p"))


def rrf(spark, d):
    arms = _scored(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("provenance", "q").orderBy(F.desc("score"), "item")))
    fused = E.fused_ranks(arms.select(F.col("provenance").alias("arm"), "q", "item", "place"))
    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("fused", 12)), "item"))
    return fused.withColumn("place", top).where("place <= 8").select("q", "item", "place", F.round("fused", 9).alias("fused"))


def agg22(spark, d):
    """Mean, median and total bytes of documents per kind."""
    b = load(spark, d, "documents").select("doc_kind", F.octet_length("text").alias("b")).where("b is not null")
    return b.groupBy("doc_kind").agg(F.round(F.avg("b"), 6).alias("mean"), F.median("b").alias("median"), F.sum("b").alias("total"), F.count("*").alias("n"))


def agg23(spark, d):
    """Verdict tally per provenance: judged, accepted and rejected links."""
    s = load(spark, d, "soft_relationships").where("lower(relation) = 'matches' and " + OK)
    return s.groupBy("provenance").agg(F.count("*").alias("judged"), F.count_if(F.col("score") >= 0.6).alias("accepted"), F.count_if(F.col("score") < 0.6).alias("rejected"))


def agg24(spark, d):
    """Commit replay: units and distinct bodies that each commit brought."""
    u = load(spark, d, "units").where("git_file_commit is not null")
    return u.groupBy("git_file_commit").agg(F.countDistinct("unit_id").alias("units"), F.countDistinct("body_hash").alias("bodies"), F.min("run_id").alias("first_run"))


def agg26(spark, d):
    """Bytes per token of documents, pooled and per kind."""
    t = load(spark, d, "documents").where("text is not null").select("doc_kind", F.octet_length("text").alias("b"), F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("t"))
    return t.rollup("doc_kind").agg((F.sum("b") / F.sum("t")).alias("bytes_per_token"), F.grouping("doc_kind").cast("int").alias("pooled"))


def agg27(spark, d):
    """Exclusions per reason with up to five examples."""
    s = load(spark, d, "soft_relationships")
    why = F.when(F.col("score").isNull(), "null score").when(F.isnan("score"), "NaN score").when(~F.col("score").between(0, 1), "score out of range").when(F.col("source_unit_id") == F.col("target_unit_id"), "self-reference")
    x = s.withColumn("reason", why).where("reason is not null").groupBy("reason", "source_unit_id").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("reason").orderBy("source_unit_id"))
    few = x.withColumn("place", place).where("place <= 5").groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("source_unit_id")), ",").alias("examples"))
    return x.groupBy("reason").agg(F.sum("c").alias("n")).join(few, "reason", "left").select("reason", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def agg28(spark, d):
    """Documentation coverage per file."""
    u = live(spark, d).where("kind <> 'class'")
    doc = stripped(F.coalesce("doc_text", "purpose", F.lit(""))) != ""
    return u.groupBy("path").agg(F.count("*").alias("n"), F.count_if(doc).alias("documented"), (F.count_if(doc) / F.count("*")).alias("coverage"))


def top10(spark, d):
    """Documents per item by distinct terms found, then hits. Terms meet words by equality."""
    q = load(spark, d, "eval_items").select("item_id", F.explode(query_terms(F.col("question"))).alias("w"))
    words = load(spark, d, "documents").select("doc_id", F.explode(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower)).alias("w"))
    counts = words.groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    hits = q.join(counts, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("terms"), F.sum("c").alias("hits"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("terms"), F.desc("hits"), "doc_id"))
    return hits.withColumn("place", place).where("place <= 10")


def top12(spark, d):
    return E.spread_sample(live(spark, d).select("unit_id", "path", "start_line"), ["path", "start_line", "unit_id"], 50).select("unit_id")


def top13(spark, d):
    """The first 50 documents in digest order."""
    return load(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("digest")).orderBy("digest").limit(50)


def top14(spark, d):
    """Pseudo-random pairs: each unit with its successor in digest order of its file."""
    u = live(spark, d).select("path", "unit_id", F.sha2("unit_id", 256).alias("h"))
    return u.select("path", F.col("unit_id").alias("left_id"), F.lead("unit_id").over(Window.partitionBy("path").orderBy("h")).alias("right_id")).where("right_id is not null").drop("path")


def top15(spark, d):
    """The pool: the 30 best pairs of each generator with the generators that gave them."""
    r = _scored(spark, d)
    place = F.row_number().over(Window.partitionBy("provenance").orderBy(F.desc("score"), "q", "item"))
    best = r.withColumn("place", place).where("place <= 30")
    return best.groupBy("q", "item").agg(F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("arms"))


def top16(spark, d):
    """Questions: roots whose two-step closure of callees has 2 to 12 units."""
    calls = graph.unit_edges(load(spark, d, "hard_relationships"), "CALLS")
    c = graph.closure(live(spark, d).select(F.col("unit_id").alias("id")), calls, 2)
    return c.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n between 2 and 12")


def top17(spark, d):
    """Cases: both directions of accepted pairs, and units that only rejected ones name."""
    j = _judged(spark, d)
    pos = j.where("score >= 0.6")
    both = pos.select(F.col("q").alias("target"), F.col("item").alias("expected")).union(pos.select("item", "q")).distinct().withColumn("kind", F.lit("reuse"))
    low = j.where("score < 0.6")
    neg = low.select(F.col("q").alias("target")).union(low.select("item")).distinct().join(both.select("target").distinct(), "target", "left_anti")
    return both.unionByName(neg.select("target", F.lit("").alias("expected"), F.lit("none").alias("kind")))


QUERIES = {
    "AGG8": agg8, "AGG9": agg9, "AGG10": agg10, "AGG11": agg11, "AGG12": agg12, "AGG15": agg15, "AGG19": agg19, "AGG20": agg20, "AGG20_bootstrap": agg20_bootstrap, "AGG21": agg21, "AGG22": agg22, "AGG23": agg23, "AGG24": agg24,
    "AGG26": agg26, "AGG27": agg27, "AGG28": agg28, "AUX13": aux13, "MCNEMAR": mcnemar, "RRF": rrf, "TOP10": top10, "TOP12": top12, "TOP13": top13, "TOP14": top14, "TOP15": top15, "TOP16": top16, "TOP17": top17,
}

D = f"""WITH RECURSIVE {LIVE}, good AS (SELECT * FROM soft_relationships WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1 AND source_unit_id <> target_unit_id),
  sc AS (SELECT source_unit_id AS q, target_unit_id AS item, provenance, max(score) AS score FROM good WHERE lower(relation) = 'similar_to' GROUP BY ALL),
  best AS (SELECT q, item, max(score) AS score FROM sc GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS place FROM best),
  judged AS (SELECT source_unit_id AS q, target_unit_id AS item, max(score) AS score FROM good WHERE lower(relation) = 'matches' GROUP BY ALL),
  rel AS (SELECT q, item FROM judged WHERE score >= 0.6)"""
AGG8 = D + """, agg8 AS (SELECT q, max((place <= 1)::INT) AS hit_1, max((place <= 3)::INT) AS hit_3, max((place <= 5)::INT) AS hit_5, (count(place) > 0)::INT AS hit_k, count(place) / count(*) AS recall, coalesce(1.0::DOUBLE / min(place), 0.0) AS reciprocal_rank
  FROM (SELECT rel.q, rel.item, place FROM rel LEFT JOIN (SELECT * FROM ranked WHERE place <= 8) r ON r.q = rel.q AND r.item = rel.item) GROUP BY q)"""
PAIRED = D + """, arms AS (SELECT q, item, max(score) FILTER (provenance = 'metadata') AS m, max(score) FILTER (provenance = 'shingle-overlap') AS s FROM sc GROUP BY q, item HAVING count(DISTINCT provenance) FILTER (provenance IN ('metadata', 'shingle-overlap')) = 2)"""
BLANK = r"regexp_replace(coalesce({0}, ''), '[\s\x{{A0}}]+', '', 'g')"

SQL = {
    "AGG8": AGG8 + " SELECT q, coalesce(hit_1, 0) AS hit_1, coalesce(hit_3, 0) AS hit_3, coalesce(hit_5, 0) AS hit_5, hit_k, recall, reciprocal_rank FROM agg8",
    "AGG9": AGG8 + " SELECT count(*) AS cases, round(avg(coalesce(hit_1, 0)), 9) AS hit_1, round(avg(hit_k), 9) AS hit_k, round(avg(recall), 9) AS recall, round(avg(reciprocal_rank), 9) AS mrr FROM agg8",
    "AGG10": f"WITH {LIVE}, u AS (SELECT kind, {BLANK.format('doc_text')} <> '' AS documented, starts_with(path, 'tests/') AS in_tests FROM live) SELECT kind, documented, in_tests, count(*) AS n FROM u GROUP BY CUBE (kind, documented, in_tests)",
    "AGG11": D + """, r AS (SELECT provenance AS arm, concat_ws('|', q, item) AS pair FROM (SELECT *, row_number() OVER (PARTITION BY provenance, q ORDER BY score DESC, item) AS p FROM sc) WHERE p <= 3),
  l AS (SELECT concat_ws('|', q, item) AS pair, score >= 0.6 AS positive FROM judged), pool AS (SELECT count(*) FILTER (positive) AS pp FROM l),
  g AS (SELECT arm, count(*) AS returned, count(positive) AS labelled, count(*) FILTER (positive) AS positives FROM r LEFT JOIN l USING (pair) GROUP BY arm),
  f AS (SELECT *, positives / nullif(labelled, 0) AS precision, positives / nullif(pp, 0) AS recall_in_pool FROM g, pool)
SELECT arm, returned, labelled, positives, precision, positives / returned AS pessimistic, (positives + returned - labelled) / returned AS optimistic, recall_in_pool, 2 * precision * recall_in_pool / nullif(precision + recall_in_pool, 0) AS f1 FROM f""",
    "AGG12": D + """, j AS (SELECT r.q, j.score AS g FROM ranked r JOIN judged j ON j.q = r.q AND j.item = r.item WHERE place <= 8),
  per AS (SELECT q, count(*) FILTER (g >= 0.8) AS r, count(*) FILTER (g >= 0.6) AS l, count(*) AS n FROM j GROUP BY q)
SELECT CAST(sum(n) AS BIGINT) AS labelled, sum(r)::DOUBLE / sum(n)::DOUBLE AS strict, sum(l)::DOUBLE / sum(n)::DOUBLE AS lenient, round(avg(r / n), 9) AS strict_macro FROM per""",
    "AGG15": D + """, f AS (SELECT coalesce(best.score, 0.0) AS s FROM rel LEFT JOIN best ON best.q = rel.q AND best.item = rel.item)
SELECT c / 100 AS floor, count(*) FILTER (s >= c / 100) / count(*) AS recall FROM f, range(20, 61, 5) t(c) GROUP BY c""",
    "AGG19": D + """, a AS (SELECT q, item FROM best WHERE score >= 0.5), na AS (SELECT q, count(*) AS na FROM a GROUP BY q),
  g AS (SELECT rel.q, count(*) AS ng, count(a.item) AS b FROM rel LEFT JOIN a ON a.q = rel.q AND a.item = rel.item GROUP BY rel.q),
  f AS (SELECT g.q, CASE WHEN coalesce(na, 0) > 0 THEN b / na ELSE 0.0::DOUBLE END AS precision, b / ng AS recall FROM g LEFT JOIN na USING (q))
SELECT q, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM f""",
    "AGG22": "SELECT doc_kind, round(avg(b), 6) AS mean, median(b) AS median, CAST(sum(b) AS BIGINT) AS total, count(*) AS n FROM (SELECT doc_kind, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL) GROUP BY doc_kind",
    "AGG23": D + " SELECT provenance, count(*) AS judged, count(*) FILTER (score >= 0.6) AS accepted, count(*) FILTER (score < 0.6) AS rejected FROM good WHERE lower(relation) = 'matches' GROUP BY provenance",
    "AGG24": "SELECT git_file_commit, count(DISTINCT unit_id) AS units, count(DISTINCT body_hash) AS bodies, min(run_id) AS first_run FROM units WHERE git_file_commit IS NOT NULL GROUP BY git_file_commit",
    "AGG26": r"""WITH t AS (SELECT doc_kind, octet_length(encode(text)) AS b, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_kind, sum(b)::DOUBLE / sum(t)::DOUBLE AS bytes_per_token, CAST(grouping(doc_kind) AS INTEGER) AS pooled FROM t GROUP BY ROLLUP (doc_kind)""",
    "AGG27": """WITH x AS (SELECT source_unit_id, CASE WHEN score IS NULL THEN 'null score' WHEN isnan(score) THEN 'NaN score' WHEN score NOT BETWEEN 0 AND 1 THEN 'score out of range' WHEN source_unit_id = target_unit_id THEN 'self-reference' END AS reason FROM soft_relationships),
  h AS (SELECT reason, source_unit_id, count(*) AS c FROM x WHERE reason IS NOT NULL GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY source_unit_id) AS p FROM h)
SELECT reason, CAST(sum(c) AS BIGINT) AS n, string_agg(source_unit_id, ',' ORDER BY source_unit_id) FILTER (p <= 5) AS examples FROM g GROUP BY reason""",
    "AGG28": f"""WITH {LIVE}, u AS (SELECT path, {BLANK.format('coalesce(doc_text, purpose)')} <> '' AS doc FROM live WHERE kind <> 'class')
SELECT path, count(*) AS n, count(*) FILTER (doc) AS documented, count(*) FILTER (doc) / count(*) AS coverage FROM u GROUP BY path""",
    "AUX13": PAIRED + """ SELECT kind AS arm, count(*) AS n, count(*) FILTER (m - s > 0) AS up, count(*) FILTER (m - s < 0) AS down, count(*) FILTER (m - s = 0) AS ties FROM arms JOIN live ON live.unit_id = q GROUP BY kind""",
    "MCNEMAR": PAIRED + """, c AS (SELECT count(*) FILTER (m >= 0.5 AND s < 0.5) AS b, count(*) FILTER (m < 0.5 AND s >= 0.5) AS c FROM arms) SELECT b, c, least(b, c) AS k, b + c AS n, round(least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(0, 1000000) r(i) WHERE i <= least(b, c))), 9) AS p FROM c""",
    "RRF": D + """, a AS (SELECT *, row_number() OVER (PARTITION BY provenance, q ORDER BY score DESC, item) AS p FROM sc), f AS (SELECT q, item, sum(1.0::DOUBLE / (60 + p)) AS fused FROM a GROUP BY q, item),
  t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(fused, 12) DESC, item) AS place FROM f) SELECT q, item, place, round(fused, 9) AS fused FROM t WHERE place <= 8""",
    "TOP10": f"""WITH q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(list_transform(regexp_extract_all(question, '{TERM}'), lambda t: lower(t))) AS w FROM eval_items) WHERE w NOT IN ({", ".join(f"'{w}'" for w in STOPWORDS)})),
  c AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{TERM}'), lambda t: lower(t))) AS w FROM documents) GROUP BY ALL),
  h AS (SELECT item_id, doc_id, count(*) AS terms, CAST(sum(c) AS BIGINT) AS hits FROM q JOIN c USING (w) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY terms DESC, hits DESC, doc_id) AS place FROM h) WHERE place <= 10""",
    "TOP12": f"""WITH {LIVE}, p AS (SELECT unit_id, row_number() OVER (ORDER BY path, start_line, unit_id) - 1 AS place, count(*) OVER () - 1 AS last FROM live)
SELECT unit_id FROM p WHERE place IN (SELECT CAST(round_even(i * (SELECT max(last) FROM p) / 49, 0) AS BIGINT) FROM range(0, 50) t(i))""",
    "TOP13": "SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS digest FROM documents ORDER BY digest LIMIT 50",
    "TOP14": f"WITH {LIVE} SELECT * FROM (SELECT unit_id AS left_id, lead(unit_id) OVER (PARTITION BY path ORDER BY sha256(unit_id)) AS right_id FROM live) WHERE right_id IS NOT NULL",
    "TOP15": D + """, b AS (SELECT *, row_number() OVER (PARTITION BY provenance ORDER BY score DESC, q, item) AS p FROM sc) SELECT q, item, string_agg(provenance, ',' ORDER BY provenance) AS arms FROM b WHERE p <= 30 GROUP BY q, item""",
    "TOP16": EDGES + """, one AS (SELECT l.unit_id AS root, s.other AS node FROM live l JOIN step s ON s.node = l.unit_id WHERE s.other <> l.unit_id),
  reach AS (SELECT * FROM one UNION SELECT o.root, s.other FROM one o JOIN step s ON s.node = o.node WHERE s.other <> o.root)
SELECT root, count(*) AS n, min(node) AS first FROM reach GROUP BY root HAVING count(*) BETWEEN 2 AND 12""",
    "TOP17": D + """, pos AS (SELECT * FROM judged WHERE score >= 0.6), low AS (SELECT * FROM judged WHERE score < 0.6), b AS (SELECT q AS target, item AS expected FROM pos UNION SELECT item, q FROM pos)
SELECT target, expected, 'reuse' AS kind FROM b UNION ALL SELECT target, '', 'none' FROM (SELECT q AS target FROM low UNION SELECT item FROM low) WHERE target NOT IN (SELECT target FROM b)""",
}
