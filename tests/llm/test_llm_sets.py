import random
import zlib

import numpy as np
import pytest

from corvane.llm import neardup as nd

SETS = "body_hash string, payload binary, n string, sig string"


def payload(values):
    return bytearray(nd.write_set(sorted(values)))


def brute(sets, t):
    names = sorted(sets)
    out = set()
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= t * (len(sets[a]) + len(sets[b]) - both):
                out.add((a, b))
    return out


@pytest.mark.parametrize("t,rows", [(0.5, 4000), (0.8, 4000), (0.5, 5)])
def test_pairs_against_brute_force(spark, t, rows, monkeypatch):
    monkeypatch.setattr(nd, "PAIR_ROWS", rows)  # 5: every window of several sets and every class is split
    rng = random.Random(7)
    common = [rng.getrandbits(62) for _ in range(30)]
    sets = {}
    for i in range(60):
        base = {rng.getrandbits(63) - 2**62 for _ in range(rng.randrange(8, 60))} | set(rng.sample(common, rng.randrange(0, 20)))
        sets[f"b{i:03d}"] = base
        for j in range(rng.randrange(0, 4)):
            kept = set(rng.sample(sorted(base), max(1, int(len(base) * rng.uniform(0.4, 1)))))
            sets[f"b{i:03d}_{j}"] = kept | {rng.getrandbits(62) for _ in range(rng.randrange(0, 6))}
        sets[f"c{i % 5}"] = sets["b000"]  # copies
    rows = [(k, payload(v), "", "") for k, v in sets.items()]
    rows += [("b000", bytearray(zlib.compress(np.unique(np.array(sorted(sets["b000"]), "<i8")).tobytes(), 9)), "", "")]
    cut = bytes(payload(range(50)))[:-3]
    rows += [("bad", bytearray(cut), "", ""), ("junk", bytearray(b"not zlib"), "", ""), ("odd", bytearray(zlib.compress(b"123")), "", ""), ("null", None, "", ""), ("empty", payload([]), "", ""), ("empty2", payload([]), "", ""), (None, payload([1, 2]), "", "")]
    got = nd.similar_pairs(spark.createDataFrame(rows, SETS), t)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(sets, t)


def test_groups(spark):
    base = list(range(100))
    sets = {"a": base, "b": base[:80] + [900 + k for k in range(20)], "c": base[:60] + [900 + k for k in range(40)], "c2": base[:60] + [900 + k for k in range(40)], "d": [5000 + k for k in range(50)], "e": [1]}
    rows = [(k, payload(v), "", "") for k, v in sets.items()] + [("null", None, "", "")]
    got = sorted(map(tuple, nd.similar_groups(spark.createDataFrame(rows, SETS), 0.6).collect()))
    assert got == [("a", "a", "a", 1), ("b", "b", "a", 2), ("c", "c", "a", 1), ("c2", "c", "a", 1), ("d", "d", "d", 0), ("e", "e", "e", 0)]
    assert nd.similar_groups(spark.createDataFrame([], SETS)).count() == 0


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(-(2**62), 2**62, 80))
        b = np.unique(np.concatenate([rng.choice(a, 50, replace=False), rng.integers(-(2**62), 2**62, 30)]))
        vectors = [np.frombuffer(nd.embed(x), np.uint8)[None] for x in (a, b)]
        apart = len(np.setxor1d(a, b))
        assert nd.manhattan(*vectors)[0] <= apart <= len(a) + len(b)
        assert nd.popcounts(a).sum() == len(a)


def test_payloads():
    assert nd.read_set(None) is None and nd.read_set(b"") is None
    assert nd.read_set(nd.write_set([3, 1, 3])).tolist() == [1, 3]
    assert len(nd.read_set(nd.write_set([]))) == 0


def test_no_sets(spark):
    assert nd.similar_pairs(spark.createDataFrame([], SETS)).count() == 0
    assert nd.similar_pairs(spark.createDataFrame([("a", None, "", "")], SETS)).count() == 0
    with pytest.raises(ValueError):
        nd.similar_pairs(spark.createDataFrame([], SETS), 0)
