from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.operators.incremental import Target, pending, pending_work

T = datetime(2025, 1, 1)
UNITS = "unit_id string, run_id int, body_hash string, git_file_commit string, removed boolean, ingested_at timestamp, extra string"
MARKS = "unit_id string, run_id int, attempt int, body_hash string, processed_at timestamp"
RUNS = "run_id int, attempt int, status string"
REFS = "rel_id long, source_unit_id string, source_hash string, removed string"


def work(spark, units, marks, runs, refs):
    df = pending_work(spark.createDataFrame(units, UNITS), spark.createDataFrame(marks, MARKS), spark.createDataFrame(runs, RUNS), spark.createDataFrame(refs, REFS))
    return sorted(map(tuple, df.collect()))


def test_states_against_last_ok_checkpoint(spark):
    units = [
        ("done", 1, "h1", "c", False, T, ""), ("done", 2, "h1", "c2", False, T, ""),  # only the commit changed
        ("new", 1, "h", None, False, T, ""), ("new", 1, "h", None, False, T, "late"),
        ("gone", 1, "h", None, False, T, ""), ("gone", 2, "h", None, True, T, ""),
        ("gone_done", 2, "h", None, True, T, ""),
        ("failed", 1, "h", None, False, T, ""), (None, 1, "h", None, False, T, ""),
    ]
    marks = [("done", 1, 1, "h1", T), ("gone", 1, 1, "h", T), ("gone_done", 2, 1, "", T), ("failed", 2, 1, "h", T), ("failed", 1, 1, "old", T), ("failed", 1, 1, "old", T)]
    runs = [(1, 1, "ok"), (2, 1, "failed"), (2, 2, "ok")]
    refs = [(1, "done", "h1", ""), (2, "done", "h0", ""), (2, "done", "h0", ""), (3, "gone", "x", ""), (4, "new", None, ""), (5, None, "x", ""), (6, "nowhere", "x", ""), (None, "new", "x", "")]
    assert work(spark, units, marks, runs, refs) == [("hard_relationships", "2"), ("hard_relationships", "4"), ("units", "failed"), ("units", "gone"), ("units", "new")]


def test_empty_tables(spark):
    assert work(spark, [], [], [], []) == []


def test_pending_pairs(spark):
    source = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), ("c", ""), ("d", "2"), (None, "1")], "source_key string, source_version string")
    source = source.union(spark.createDataFrame([("e", ""), ("f", None)], source.schema))
    done = spark.createDataFrame([("a", "1"), ("c", "9"), ("d", "1"), ("e", ""), (None, "1")], "source_key string, source_version string")
    assert sorted(map(tuple, pending(source, done).collect())) == [("c", ""), ("d", "2")]


def test_target_processes_each_change_once_and_survives_failure(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"))
    state = lambda rows: spark.createDataFrame(rows, "source_key string, source_version string")
    seen = []

    def process(todo):
        seen.append(sorted(map(tuple, todo.collect())))
        return todo.withColumn("payload", F.lit(len(seen)))

    assert target.read() is None
    assert target.run(state([("a", "1"), ("b", "1")]), process) == 1
    with pytest.raises(ZeroDivisionError):
        target.run(state([("a", "2"), ("b", "1")]), lambda todo: 1 / 0)
    assert target.version() == 1
    assert target.run(state([("a", "2"), ("b", "1"), ("c", "1")]), process) == 2
    assert target.run(state([("a", "2"), ("b", "1"), ("c", "1")]), process) is None
    assert target.run(state([("a", ""), ("b", "1"), ("c", "1")]), process) == 3
    assert seen == [[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")], [("a", "")]]
    assert sorted((r["source_key"], r["source_version"]) for r in target.current().collect()) == [("a", ""), ("b", "1"), ("c", "1")]


def test_leftover_folders_are_not_read(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"))
    target.publish(spark.createDataFrame([("a", "1")], "source_key string, source_version string"))
    spark.createDataFrame([("x", "1", 2)], "source_key string, source_version string, target_version long").write.parquet(str(tmp_path / "t" / "v2-dead"))
    assert [r["source_key"] for r in target.read().collect()] == ["a"]
