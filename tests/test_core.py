import json

import pandas as pd
from pyspark.sql import functions as F

from corvane.functions import fuzzy
from corvane.operators import dml, graph, intervals, search, setsim
from corvane.operators import evaluation as E
from corvane.operators.build import Index
from corvane.functions.code import strip_documentation as normalise
from corvane.sources.parse import parse_text, regions
from corvane.sources.scripts import scan_scripts
from corvane.sources.tree import config_excludes, read_tree, resolve_member_lines

A = "the quick brown fox jumps over the lazy dog and then it walks home through the green field near the old mill by night"


def test_similarity_is_symmetric_and_skips_short_texts(spark):
    docs = spark.createDataFrame([(1, A), (2, A.replace("fox", "cat")), (3, "too short"), (4, None), (5, "")], "id int, text string")
    got = [tuple(r) for r in setsim.all_pairs(docs, "id", "text").collect()]
    assert len(got) == 1 and got[0][:2] == (1, 2) and 0.5 < got[0][3] < 1


def test_needles_and_floor(spark):
    docs = setsim.postings(spark.createDataFrame([(1, A), (2, A + " " + A.upper())], "id int, text string"), "id", "text")
    scores = setsim.needle_scores(docs, docs)
    assert {(r["needle_id"], r["id"]) for r in setsim.ranked(scores, floor=0.27).collect()} >= {(1, 1), (2, 2)}
    assert sum(r["below_floor"] for r in setsim.floor_report(scores).collect()) == 0


def test_enclosing_rules(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("f", 10, 20, "inner2"), ("f", 5, 200, "wide")], "path string, start_line int, end_line int, unit_id string")
    points = spark.createDataFrame([("f", 15), ("f", 15), ("f", 150), ("f", 300), ("g", 1)], "path string, line int")
    got = {r["line"]: r["unit_id"] for r in intervals.enclosing(points, spans).collect()}
    assert got == {15: "inner", 150: "wide"}


def test_closure_and_slices(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("a", "a", 4), ("x", "a", 5), ("b", "a", 6)], "source string, target string, line int")
    roots = spark.createDataFrame([("a",)], "id string")
    got = {(r["node"], r["depth"]) for r in graph.closure(roots, edges, 3).collect()}
    assert got == {("b", 1), ("c", 2)}
    known = spark.createDataFrame([("a",), ("b",), ("x",), ("t",)], "unit_id string")
    tests = spark.createDataFrame([("a", "t", 1)], "source string, target string, line int")
    s = {(r["unit_id"], r["role"]): (r["call_lines"], r["truncated"]) for r in graph.slices(roots, edges, tests, known).collect()}
    assert s == {("b", "callee"): ([1], False), ("x", "caller"): ([5], False), ("t", "test"): (None, False)}
    assert {r["truncated"] for r in graph.slices(roots, edges, tests, known, limit=1).collect()} == {True}


def test_dml(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    new = spark.createDataFrame([("b", 2)], "path string, v int")
    assert sorted(map(tuple, dml.replace_by(old, new, "path").collect())) == [("a", 1), ("b", 2)]
    units = spark.createDataFrame([("u", "f"), ("u", "f"), ("v", "f"), ("v", "g"), ("w", "g")], "unit_id string, path string")
    kept = spark.createDataFrame([("w",)], "unit_id string")
    assert sorted(map(tuple, dml.conflicts(units, kept).collect())) == [("u", "repeated in a file"), ("v", "in several files"), ("w", "owned by another file")]


SOURCE = '''import os.path as p
from . import util

class Box:
    """A box."""

    @property
    def size(self) -> int:
        return util.measure(self)

    @size.setter
    def size(self, value: int = 3): ...

@traced
async def fill(box: Box, *rest, deep=True) -> None:
    """Fill it.

    More."""
    box.put(1)
'''


def test_parse_units_calls_imports():
    rows = parse_text("src/pkg/mod.py", SOURCE)
    units = {r["unit_id"]: r for r in rows if r["tag"] == "unit"}
    assert list(units) == ["src.pkg.mod::Box", "src.pkg.mod::Box.size", "src.pkg.mod::Box.size@setter", "src.pkg.mod::fill"]
    fill = units["src.pkg.mod::fill"]
    assert (fill["kind"], fill["start_line"], fill["purpose"], fill["doc_text"]) == ("async_function", 14, "Fill it.", "Fill it. More.")
    assert fill["signature"] == "async fill(box: Box, *rest, deep = True) -> None"
    assert {r["text"] for r in rows if r["tag"] == "call"} == {"util.measure", "box.put"}
    assert [p["name"] for p in json.loads(fill["parameters_json"])] == ["box", "*rest", "deep"]
    assert ("util", "pkg", "util") in {(r["name"], r["qualname"], r["text"]) for r in rows if r["tag"] == "import"}
    assert parse_text("x.py", "def (")[0]["tag"] == "error"


def test_regions_and_normalise():
    text = "# corvane: begin a\nx = 1\n# corvane: end a\ns = '''\n# corvane: begin b\n'''\n"
    assert [(r["unit_id"], r["start_line"], r["end_line"]) for r in regions(text)] == [("a", 2, 2)]
    for bad in ("# corvane: end a\n", "# corvane: begin a\nx\n", "# corvane: begin a\n# corvane: end a\n", "# corvane: begin a\ny\n# corvane: end b\n"):
        try:
            regions(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert normalise('def f(a):\n    """doc"""\n    # note\n    return  a') == normalise("def f(a):\n    return a")
    assert normalise("def f(a):\n    return a") != normalise("def f(b):\n    return b")


def test_scripts(spark):
    from corvane.plans.parsing import SCRIPTS

    got = sorted((r["path"], r["url"], r["method"]) for r in scan_scripts(spark.createDataFrame(SCRIPTS, "path string, text string")).collect())
    assert ("web/page.js", "/users/1", "POST") in got and ("web/page.js", "/users/${id}", "DELETE") in got and ("web/page.js", "", "GET") in got
    assert not any("/no" in u or "other" in u for _, u, _ in got)


def test_tree_and_config(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "venv").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\n")
    (tmp_path / "venv" / "b.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "skip_c.py").write_text("x = 1\n")
    assert [r["path"] for r in read_tree(spark, str(tmp_path), excludes=["skip_"]).collect()] == ["pkg/a.py"]
    (tmp_path / "corvane.toml").write_text('excludes = ["b", "a"]\n')
    assert config_excludes(str(tmp_path), ["a", "c"]) == ["b", "a", "c"]
    assert resolve_member_lines("caller: a\n# x\nb::c  # y\ntest:d") == [("caller", "a"), ("caller", "b::c"), ("test", "d")]


def test_index_versions(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    index.rebuild(files(("src/a.py", "def f():\n    return g()\n\ndef g():\n    return 1\n"), ("tests/test_a.py", "from a import f\n\ndef test_f():\n    f()\n"), ("bad.py", "def (")))
    edges = {(r["source_unit_id"], r["relation"], r["target_ref"]) for r in index.read("edges").collect()}
    assert ("src.a::f", "CALLS", "src.a::g") in edges and ("src.a::f", "TESTED_BY", "tests.test_a::test_f") in edges
    index.update(files(("src/a.py", "def h():\n    return 2\n")), spark.createDataFrame([("bad.py",)], "path string"))
    assert {r["unit_id"] for r in index.units().collect()} == {"src.a::h", "tests.test_a::test_f"} and index.version() == 2


def test_fuzzy_and_search(spark):
    assert fuzzy.lcs("kitten", "sitting") == 4 and fuzzy.token_set_ratio("a b", "b a c") == 100.0 and fuzzy.weighted_ratio("", "x") == 0.0
    asked = search.expand(search.query_table(spark, ["save the App", "log out now", "appear"])).orderBy("query", F.desc("weight"), "asked")
    assert [r["asked"] for r in asked.collect() if r["query"] == "save the App" and r["weight"]] == ["save the application", "persist the App", "write the App", "store the App"]
    assert [(r["asked"], r["weight"]) for r in asked.collect() if r["query"] == "log out now"][:2] == [("revoke session now", 0.9), ("invalidate session now", 0.85)]
    assert [r["asked"] for r in asked.collect() if r["query"] == "appear"] == ["appear"]
    u = pd.DataFrame([{"unit_id": i, "path": "p", "start_line": 1, "name": n, "qualname": n, "purpose": n, "doc_text": None, "signature": f"{n}()", "concepts_json": "[]", "owns_json": "[]", "body_terms": n, "parameters_json": "[]", "returns": ""} for i, n in (("1", "save_report"), ("2", "drop_token"))])
    got = search.search(spark.createDataFrame(u, ", ".join(f"{c} {'int' if c == 'start_line' else 'string'}" for c in u.columns)), ["save report"], expansion=True).collect()
    assert [r["unit_id"] for r in got] == ["1", "2"]


def test_evaluation(spark):
    r = E.ranking(spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.9), ("q", "c", 0.1)], "q string, item string, score double"))
    m = E.case_metrics(r, spark.createDataFrame([("q", "b"), ("q", "z")], "q string, item string")).first()
    assert (m["hit_1"], m["hit_3"], m["recall"], m["reciprocal_rank"]) == (0, 1, 0.5, 0.5)
    d = spark.createDataFrame([("x", str(i), 1.0) for i in range(12)], "arm string, pair string, diff double")
    assert E.sign_flip(d, 2000).first()["p"] < 0.01 and E.bootstrap_lower(d, 200).first()["lower"] > 0.3
    down = spark.createDataFrame([("x", str(i), -1.0) for i in range(12)], "arm string, pair string, diff double")
    assert E.sign_flip(down, 200).first()["p"] == 1.0
    assert E.power(30, 0.3, 0.5, 200, 2000) < 0.12 and E.power(60, 0.3, 1.0, 50, 2000) == 1.0
    nine = spark.range(9).withColumnRenamed("id", "v")
    assert sorted(x["v"] for x in E.spread_sample(nine, ["v"], 3).collect()) == [0, 4, 8]
