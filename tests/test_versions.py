"""Publishing on the version that was read: overlapping runs, crashes, replays."""

import pytest
from pyspark.sql import functions as F

from corvane.operators.build import Index
from corvane.operators.incremental import Target
from corvane.operators.manifest import Manifest, PublishConflict

STATE = "source_key string, source_version string"


def keys(target):
    return sorted((r["source_key"], r["source_version"], r["target_version"]) for r in target.read().collect())


def test_a_run_that_was_overtaken_repeats_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = Target(spark, path), Target(spark, path)
    source = spark.createDataFrame([("a", "1"), ("b", "1")], STATE)

    def overtaken(todo):
        assert two.run(source, lambda rows: rows) == 1  # publishes while the first run works
        return todo

    with pytest.raises(PublishConflict):
        one.run(source, overtaken)
    assert keys(one) == [("a", "1", 1), ("b", "1", 1)]
    assert one.run(source, lambda rows: rows) is None
    more = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], STATE)
    first = []

    def overtaken_once(todo):
        if not first:
            first.append(two.run(more.where("source_key = 'c'"), lambda rows: rows))
        return todo

    assert one.run(more, overtaken_once, tries=2) == 3
    assert keys(one) == [("a", "1", 1), ("b", "1", 1), ("b", "2", 3), ("c", "1", 2)]


def test_crashes_before_and_after_the_claim(spark, tmp_path, monkeypatch):
    target = Target(spark, str(tmp_path / "t"))
    source = spark.createDataFrame([("a", "1")], STATE)
    claim = Manifest.publish

    def dies_before(self, content, base):
        raise OSError("lost")

    def dies_after(self, content, base):
        claim(self, content, base)
        raise OSError("lost")

    monkeypatch.setattr(Manifest, "publish", dies_before)
    with pytest.raises(OSError):
        target.run(source, lambda rows: rows)
    assert target.version() == 0 and target.read() is None
    monkeypatch.setattr(Manifest, "publish", dies_after)
    with pytest.raises(OSError):
        target.run(source, lambda rows: rows)
    monkeypatch.setattr(Manifest, "publish", claim)
    assert target.run(source, lambda rows: rows) is None
    assert keys(target) == [("a", "1", 1)]


def test_state_stays_small(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"))
    for n in range(1, 13):
        target.publish(spark.createDataFrame([("a", str(n)), (f"k{n}", "1")], STATE))
    found = target.manifest.read(12)
    assert len(found["folders"]) == 12 and len(found["state"]) <= Target.COMPACT + 1
    state = {r["source_key"]: r["source_version"] for r in target.state().collect()}
    assert state == {"a": "12"} | {f"k{n}": "1" for n in range(1, 13)}


FILES = "path string, text string"


def test_ids_move_between_files(spark, tmp_path):
    tag = "# corvane: unit shared.task\n"
    index = Index(spark, str(tmp_path / "i"))
    index.rebuild(spark.createDataFrame([("a.py", tag + "def f():\n    return 1\n"), ("b.py", "def g():\n    return 2\n"), ("gone.py", "x = 1\ndef h():\n    pass\n")], FILES))
    assert {(r["unit_id"], r["path"]) for r in index.units().collect()} == {("shared.task", "a.py"), ("b::g", "b.py"), ("gone::h", "gone.py")}
    now = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", tag + "def g():\n    return 2\n")], FILES)
    changed = now.where("path = 'b.py'")
    with pytest.raises(ValueError, match="several files"):
        index.update(changed)
    index.update(changed, tree=now)
    assert {(r["unit_id"], r["path"]) for r in index.units().collect()} == {("a::f", "a.py"), ("shared.task", "b.py")}
    index.update_file("a.py", now.where("path <> 'a.py'"))
    assert [r["unit_id"] for r in index.units().collect()] == ["shared.task"]


def test_overlapping_builds(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    one = spark.createDataFrame([("a.py", "def f():\n    return 1\n")], FILES)
    index.rebuild(one)
    stale = index.read("parsed")
    index.update(one.withColumn("path", F.lit("b.py")))
    with pytest.raises(PublishConflict):
        index.publish(stale, 1)
    assert index.units().count() == 2


def test_call_resolution_in_order(spark, tmp_path):
    files = [
        ("src/pkg/__init__.py", ""),
        ("src/pkg/tools.py", "def load():\n    return 1\n\n\nclass Box:\n    def open(self):\n        self.close()\n        self.shut()\n        Box.close()\n\n    def close(self):\n        load()\n"),
        ("src/pkg/sub/more.py", "from ..tools import load as fetch\nfrom .. import tools\nfrom pkg import tools as kit\nimport pkg.tools\nimport pkg.tools as t\n\n\ndef run(x):\n    from pkg.tools import Box\n    fetch()\n    tools.load()\n    kit.load()\n    pkg.tools.load()\n    t.load()\n    Box()\n    x.load()\n    x[0].load()\n    load()\n"),
        ("src/pkg/plain.py", "def go():\n    pkg.tools.load()\n"),
        ("tests/test_tools.py", "from pkg.tools import load\n\n\ndef test_load():\n    assert load()\n"),
    ]
    index = Index(spark, str(tmp_path / "i"))
    index.rebuild(spark.createDataFrame(files, FILES))
    edges = index.read("edges").collect()
    calls = {(r["source_unit_id"].split("::")[1], r["target_ref"], tuple(r["lines"])) for r in edges if r["relation"] == "CALLS"}
    tools, more = "src.pkg.tools::", "run"
    assert calls == {
        ("Box.open", tools + "Box.close", (7,)), ("Box.open", "self.shut", (8,)), ("Box.open", "Box.close", (9,)), ("Box.close", tools + "load", (12,)),
        (more, tools + "load", (10, 11, 12, 13, 14)), (more, "Box", (15,)), (more, "x.load", (16,)), (more, "x[0].load", (17,)), (more, "load", (18,)),
        ("go", tools + "load", (2,)), ("test_load", tools + "load", (5,)),
    }
    how = {r["source_unit_id"].split("::")[1]: r["resolutions"] for r in edges if r["target_ref"] == tools + "load"}
    assert how == {"Box.close": ["same-module"], "run": ["from-import", "from-import-module", "module-import"], "go": ["module-path"], "test_load": ["from-import"]}
    assert [(r["source_unit_id"], r["target_ref"]) for r in edges if r["relation"] == "TESTED_BY"] == [(tools + "load", "tests.test_tools::test_load")]
