"""Slices as Markdown: the target, long members and roots without members are there."""

from corvane.plans import registry, streams


def test_snk12_renders_targets_long_members_and_lone_roots(spark, tmp_path, monkeypatch):
    text = "def a():\n    b()\n\ndef b():\n" + "    x = 1\n" * 500 + "\ndef c():\n    pass\n"
    units = spark.createDataFrame([("a", "m.py", 1, 2), ("b", "m.py", 4, 504), ("c", "m.py", 506, 507)], "unit_id string, path string, start_line int, end_line int")
    spark.createDataFrame([("m.py", "head", text, 1)], "path string, version string, text string, mtime int").write.parquet(f"{tmp_path}/source_files.parquet")
    members = spark.createDataFrame([("a", "b", "callee", 1), ("b", "a", "caller", 1)], "root string, unit_id string, role string, depth int")
    monkeypatch.setattr(streams, "live", lambda s, d: units)
    monkeypatch.setattr(streams, "_slices", lambda s, d: members)
    got = {r["root"]: r["n_chars"] for r in registry.queries()["SNK12"](spark, str(tmp_path)).collect()}
    part = lambda role, u, first, last: len(f"## {role}: {u}\nm.py:{first}-{last}\n```python\n" + "\n".join(text.split("\n")[first - 1 : last]) + "\n```")
    assert got == {
        "a": part("target", "a", 1, 2) + 2 + part("callee", "b", 4, 504),
        "b": part("target", "b", 4, 504) + 2 + part("caller", "a", 1, 2),
        "c": part("target", "c", 506, 507),
    }
