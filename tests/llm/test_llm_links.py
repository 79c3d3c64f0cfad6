import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.links import valid_links
from corvane.llm.topn import top_n

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)
LINKS = "source_unit_id string, relation string, target_unit_id string, score double, provenance string, recorded_at timestamp, g string, i string, s string"


def test_valid_links(spark):
    nan = float("nan")
    rows = [
        ("a", "SIMILAR_TO", "b", 0.9, "p", T1, "", "", ""), ("a", "similar_to", "b", 0.4, "p", T2, "", "", ""), ("a", "Similar_To", "b", 0.3, "q", T1, "", "", ""),
        ("a", "SIMILAR_TO", "c", 0.5, "p", T2, "", "", ""), ("a", "SIMILAR_TO", "c", nan, "p", T2, "", "", ""), ("a", "SIMILAR_TO", "d", 1.2, "p", T1, "", "", ""), ("a", "SIMILAR_TO", "e", None, "p", T1, "", "", ""),
        ("a", "SIMILAR_TO", "a", 0.5, "p", T1, "", "", ""), (None, "SIMILAR_TO", "a", 0.5, "p", T1, "", "", ""), ("a", "MATCHES", "z", 0.5, "p", T1, "", "", ""), ("b", "SIMILAR_TO", "a", 0.0, None, None, "", "", ""),
    ]
    got = sorted(map(tuple, valid_links(spark.createDataFrame(rows, LINKS), "SIMILAR_TO").collect()))
    assert got == [("a", "b", 0.4), ("a", "c", 0.5), ("b", "a", 0.0)]
    assert valid_links(spark.createDataFrame([], LINKS), "MATCHES").count() == 0


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_top_n_against_brute_force(spark, hot_rows):
    rng = random.Random(3)
    rows = [("hot", f"item{i % 997:04d}{'x' * (i % 3)}", rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()])) for i in range(600)]
    rows += [(f"g{i % 40}", f"n{i}", rng.choice([0.2, 0.7])) for i in range(200)]
    rows += [("tie", "p" * 30 + c + d, 0.5) for c in "abcd" for d in ["", "\0", "\0a", "é", "z"]]
    rows = list({(g, i): (g, i, s) for g, i, s in rows}.values())
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:5]
        want |= set(best)
    got = top_n(spark.createDataFrame(rows + rows[:3], "k string, v string, score double"), "k", "v", "score", 5, hot_rows=hot_rows)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_top_n_of_extreme_scores(spark):
    rng = random.Random(9)
    extreme = [float("inf"), float("-inf"), 1e308, -1e308, 1.7e308, -1.7e308, 5e-324, -5e-324, 1e-310, 0.0, 1.0, 1.0000000000000002, -1.0]
    rows = [("all", f"i{k}", s) for k, s in enumerate(extreme)] + [("inf", f"j{k}", float("inf")) for k in range(9)]
    rows += [("low", f"k{k}", 1.0 + k * 2.0**-52) for k in range(40)] + [("down", f"k{k}", -float("inf") if k % 2 else 5e-324) for k in range(12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i string, s double")
    for n in (1, 3, 6):
        want = {r for g in ("all", "inf", "low", "down") for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:n]}
        assert {tuple(r) for r in top_n(df, "g", "i", "s", n).collect()} == want


def test_top_n_edges(spark):
    schema = "g string, i string, s double"
    df = spark.createDataFrame([("a", "x", None), (None, "x", 0.5), ("a", None, 0.5), ("a", "y", float("nan")), ("b", "", 0.0), ("b", "", -0.0)], schema)
    assert [tuple(r) for r in top_n(df, "g", "i", "s", 2).collect()] == [("b", "", 0.0)]
    assert top_n(df, "g", "i", "s", 0).count() == 0
    assert top_n(spark.createDataFrame([], schema), "g", "i", "s", 3).count() == 0


def components(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)), key=lambda s: s.encode())
            parent[y] = x
    return {n: root(n) for n in parent}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(60)]  # a long path
    pairs += [("hub", f"leaf{i}") for i in range(50)] + [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(70)]
    pairs += [("ä", "z"), ("z", "ä"), ("self", "self"), (None, "x"), ("x", None), ("hub", "leaf1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == components(pairs)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([("a", "a")], "a string, b string")
    assert connected_components(df, "a", "b").count() == 0


def test_components_do_not_depend_on_order(spark):
    pairs = [("a", "b"), ("c", "b"), ("c", "d"), ("e", "f")]
    one = spark.createDataFrame(pairs, "a string, b string")
    two = spark.createDataFrame([(b, a) for a, b in reversed(pairs)], "a string, b string").withColumn("node", F.lit("clash"))
    rows = lambda df: sorted(map(tuple, connected_components(df, "a", "b").collect()))
    assert rows(one) == rows(two) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e")]
