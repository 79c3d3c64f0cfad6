from datetime import datetime

from corvane.operators.orphans import orphan_references, orphan_report

EARLY, LATE = datetime(2025, 1, 5), datetime(2025, 3, 1)
UNITS = "unit_id string, run_id int, indexed_at timestamp, ingested_at timestamp, removed boolean, rel_id string"
REFS = "rel_id long, target_kind string, target_ref string, recorded_at timestamp, key string"


def found(spark, refs, units):
    df = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(units, UNITS))
    return sorted((r["rel_id"], r["orphan_kind"], r["period"]) for r in df.collect())


def test_kinds_dirt_and_repeats(spark):
    units = [("a", 1, EARLY, EARLY, False, ""), ("b", 1, EARLY, EARLY, False, ""), ("b", 2, LATE, LATE, True, ""), ("c", 1, LATE, LATE, False, ""), ("d", 1, EARLY, EARLY, True, ""), ("d", 2, LATE, LATE, False, ""), (None, 1, EARLY, EARLY, False, ""), ("e", 1, None, EARLY, None, "")]
    refs = [
        (1, " Unit\t", "a\r\n", EARLY, ""), (2, "unit", "zz", EARLY, ""), (2, "unit", "zz", EARLY, ""), (3, "UNIT", "\tb ", LATE, ""), (4, "unit", "c", EARLY, ""), (5, "unit", "c", LATE, ""),
        (6, "unit", "d", LATE, ""), (7, "symbol", "zz", LATE, ""), (8, "unit", " ", LATE, ""), (9, "unit", None, LATE, ""), (10, None, "zz", LATE, ""), (11, "unit", "c", None, ""), (12, "unit", "A", LATE, ""), (None, "unit", "zz", LATE, ""), (13, "unit", "e", EARLY, ""),
    ]
    want = [(2, "missing", "2025-01"), (3, "removed", "2025-03"), (4, "late", "2025-01"), (12, "missing", "2025-03")]
    assert found(spark, refs, units) == want


def test_runs_agree_with_brute_force(spark):
    ids = [f"u{i:03d}" for i in range(200)]
    units = [(u, 1, EARLY, EARLY, i % 7 == 0, "") for i, u in enumerate(ids) if i % 5]
    refs = [(i, "unit", ids[i % 200] if i % 3 else "u001", LATE, "") for i in range(600)]
    known = {u[0]: u[4] for u in units}
    want = sorted((r[0], "missing" if r[2] not in known else "removed", "2025-03") for r in refs if known.get(r[2], True))
    assert found(spark, refs, units) == want


def test_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "unit", "x", LATE, "")], []) == [(1, "missing", "2025-03")]
    assert orphan_report(spark.createDataFrame([], REFS), spark.createDataFrame([], LINKS), spark.createDataFrame([], UNITS)).count() == 0


LINKS = "source_unit_id string, relation string, target_unit_id string, provenance string, recorded_at timestamp, key string"


def test_report_per_table(spark):
    units = spark.createDataFrame([("a", 1, EARLY, EARLY, False, ""), ("b", 1, LATE, LATE, False, "")], UNITS)
    refs = spark.createDataFrame([(1, "unit", "zz", EARLY, ""), (1, "unit", " zz", EARLY, ""), (2, "unit", "zz", EARLY, "")], REFS)
    links = spark.createDataFrame([("a", "MATCHES", "zz", "p", LATE, ""), ("a", "MATCHES", "zz", "p", LATE, "x"), ("b", "MATCHES", None, "p", EARLY, ""), (None, None, " ", None, None, "")], LINKS)
    got = sorted(map(tuple, orphan_report(refs, links, units).collect()))
    assert got == [("hard_relationships", "missing", "2025-01", 2, 1), ("soft_relationships", "late", "2025-01", 1, 1), ("soft_relationships", "missing", "2025-03", 1, 1)]
