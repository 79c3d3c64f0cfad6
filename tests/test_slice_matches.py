"""Best matches outside a slice, where a slice holds a member's best ones."""

from corvane.plans import more


def test_matches_inside_the_slice_are_passed_over(spark, tmp_path, monkeypatch):
    rows = [("r", "CALLS", "unit", t, '{"lines": [1]}') for t in ["hub", "a", "b", "c", "d", "e"]] + [("q", "CALLS", "unit", "hub", '{"lines": [1]}')]
    rows += [(f"caller{k}", "CALLS", "unit", "hub", '{"lines": [1]}') for k in range(50)]
    spark.createDataFrame(rows, "source_unit_id string, relation string, target_kind string, target_ref string, evidence_json string").write.parquet(f"{tmp_path}/hard_relationships.parquet")
    links = [("hub", t, 0.9) for t in "abcde"] + [("hub", f"z{k:04}", 0.5 + (k % 7) / 100) for k in range(2000)]
    spark.createDataFrame(links, "source_unit_id string, target_unit_id string, score double").write.parquet(f"{tmp_path}/soft_relationships.parquet")
    held = []
    joined = more.salted_join
    monkeypatch.setattr(more, "salted_join", lambda many, one, *a, **k: held.append(one) or joined(many, one, *a, **k))
    got = {}
    for r in more.top9(spark, str(tmp_path)).orderBy("root", "place").collect():
        got.setdefault(r["root"], []).append((r["match"], r["score"]))
    assert got["r"] == [("z0006", 0.56), ("z0013", 0.56), ("z0020", 0.56)]
    assert got["q"] == [("a", 0.9), ("b", 0.9), ("c", 0.9)]
    assert held[1].count() <= 9  # of 2,005 matches of the hub
