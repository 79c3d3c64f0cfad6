"""Fuzzy pairs against brute force: nothing at the threshold is lost."""

import itertools
import random

from corvane.functions.fuzzy import lcs, token_set_ratio
from corvane.operators import fuzzyjoin, intervals
from corvane.plans import registry


def test_lcs_lengths_and_ratios_equal_the_plain_ones():
    rng = random.Random(3)
    texts = lambda n: ["".join(rng.choices("abcde f\u00e9\U0001f600", k=rng.randint(0, n))) for _ in range(150)]
    pairs = list(zip(texts(200), texts(70)))
    assert fuzzyjoin.lcs_lengths(pairs).tolist() == [lcs(a, b) for a, b in pairs]
    sets = [(frozenset(a.split()), frozenset(b.split())) for a, b in pairs]
    assert fuzzyjoin.token_set_ratios(sets).tolist() == [token_set_ratio(a, b) for a, b in pairs]


def test_fuzzy_pairs_keep_every_pair_of_the_quadratic_join(spark, monkeypatch):
    monkeypatch.setattr(fuzzyjoin, "TILE", 16)
    rng = random.Random(5)
    words = ["get", "gets", "user", "users", "name", "names", "a", "of", "row", "rows", "merge", "sorted_buckets"]
    rows = [(f"u{k:03d}", " ".join(rng.choices(words, k=rng.randint(0, 7))), rng.choice(["", "f(a)", "f(a, b) -> int", "run() -> str"])) for k in range(120)]
    rows += [(f"v{k}", "get names of a row", "f(a)") for k in range(5)]
    got = fuzzyjoin.fuzzy_pairs(spark.createDataFrame(rows, "id string, text string, signature string"), {"text": 0.85, "signature": 0.15}, 0.7, group=40).collect()
    assert len({(r["left_id"], r["right_id"]) for r in got}) == len(got)
    least = {}
    for i, t, s in sorted(rows):
        least.setdefault((t, s), i)
    rep = {i: least[t, s] for i, t, s in rows}
    score = {(r["left_id"], r["right_id"]): r["score"] for r in got if r["relation"] == "pair"}
    member = {r["right_id"]: r for r in got if r["relation"] == "member"}
    want, found = {}, {}
    for (i, t, s), (j, u, v) in itertools.combinations(sorted(rows), 2):
        x = token_set_ratio(t, u) / 100 * 0.85 + token_set_ratio(s, v) / 100 * 0.15
        if x >= 0.7:
            want[i, j] = round(x, 9)
        a, b = sorted((rep[i], rep[j]))
        y = member[j]["score"] if a == b and j in member else score.get((a, b))
        if y is not None:
            found[i, j] = round(y, 9)
    assert found == want and any(x < 1 for x in want.values()) and any(not set(t.split()) & set(u.split()) for (i, t, _), (j, u, _) in itertools.combinations(sorted(rows), 2) if (i, j) in want)


def test_jon18_pairs_link_different_texts(spark, tables):
    pairs = registry.queries()["JON18_pairs"](spark, tables)
    assert pairs.where("relation = 'pair' and score < 1").count() > 0


def test_unit_bodies_of_methods_and_long_units(spark):
    from corvane.plans.parsing import normalised_units

    text = "class A:\n    def f(self):\n        'doc'\n        return 1\n\ndef g():\n" + "    x = 1\n" * 500
    src = spark.createDataFrame([("a.py", "head", text, 1)], "path string, version string, text string, mtime int")
    spans = spark.createDataFrame([("f", "a.py", 2, 4), ("g", "a.py", 6, 506)], "unit_id string, path string, start_line int, end_line int")
    got = {r["unit_id"]: r["text"] for r in normalised_units(intervals.unit_code(spans, src)).collect()}
    assert got["f"] == "def f(self):\n    return 1" and got["g"].count("x = 1") == 500
