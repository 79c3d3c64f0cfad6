import os
from datetime import datetime

import numpy as np
import pytest

from corvane.llm import docpairs, leakage, packing, reading

T = datetime(2025, 1, 1)
TOKENS = packing.TOKENIZER
needs_tokens = pytest.mark.skipif(not os.path.exists(TOKENS), reason="no vocabulary here")


@pytest.mark.parametrize(
    "doc,name,want",
    [
        (None, "f", False), ("  ", "f", False), (" ", "f", False), ("bind empty cursor", "bind_empty_cursor", False), ("This function binds the empty cursor.", "bind_empty_cursor", False),
        ("Seals fallback policys. Takes clean_adapter.", "seal_fallback_policy", False), ("TODO: describe what this does, when it is called.", "f", False), ("noqa: D103", "f", False), ("See above.", "f", False),
        ("Copyright the project authors.", "f", False), ("~~~~", "f", False), (":param x: :return: :rtype: dict[str, int]", "f", False), ("Args: x (object) Returns: Path", "f", False), ("...", "f", False), ("Noch offen.", "f", False),
        ("TODO: split this up. Blocks for up to 10 seconds if the lock is held.", "f", True), ("Newest beacon wins.", "f", True), ("Milliseconds, not stacks.", "f", True), ("Bind the cursor. Raises when it is closed.", "bind_cursor", True),
        ("See the patch notes: an index without a parent is treated as global.", "f", True), ("Liefert das Fenster, das zuletzt geändert wurde.", "f", True),
    ],
)
def test_documentation_that_tells_more(doc, name, want):
    assert docpairs.tells_more(doc, name, name, f"{name}(clean_adapter: str, x)", '[{"name":"x","type":"object"}]', "") is want


UNITS = "unit_id string, run_id int, indexed_at timestamp, ingested_at timestamp, removed boolean, path string, kind string, name string, qualname string, signature string, parameters_json string, returns string, purpose string, doc_text string, start_line int, end_line int, code string, block int"


def unit(uid, path, name, start, end, doc, run=1, removed=False, kind="function", sig=None, ingested=T):
    return (uid, run, T, ingested, removed, path, kind, name, name, sig or f"{name}(x: int)", None, "", None, doc, start, end, "", 0)


def test_doc_pairs(spark):
    long = "\n".join(f"line{i}" for i in range(1, 201))
    units = [
        unit("a", "src/m.py", "f", 2, 3, "Raises when closed."), unit("a", "src/m.py", "f", 2, 3, "Raises when closed.", ingested=datetime(2025, 2, 1)),
        unit("stub", "stubs/m.pyi", "g", 1, 1, "Newest wins.", sig="g(x: int) -> int"), unit("def", "src/m.py", "g", 5, 6, None, sig="g(x)"), unit("other", "src/m.py", "g", 7, 8, None, sig="g(x, y)"),
        unit("gone", "src/m.py", "f", 1, 1, "Raises often.", run=2, removed=True), unit("cls", "src/m.py", "C", 1, 1, "Newest wins.", kind="class"), unit("nofile", "src/none.py", "f", 1, 2, "Newest wins."),
        unit("wide", "src/long.py", "f", 60, 200, "Newest wins."), unit("beyond", "src/long.py", "f2", 500, 600, "Newest wins."), unit("trivial", "src/m.py", "f", 1, 1, "f"),
    ]
    files = [("src/m.py", "head", "import x\r\ndef f(x):\r\n    return 1\r\n\r\ndef g(x):\r\n    return 2\r\ndef g(x, y):\r\n    return 3", T), ("stubs/m.pyi", "head", "def g(x: int) -> int: ...", T), ("src/m.py", "base", "old", T), ("src/long.py", "head", long, None), (None, "head", "x", T), ("n", "head", None, T)]
    df = docpairs.doc_pairs(spark.createDataFrame(units, UNITS), spark.createDataFrame(files, "path string, version string, text string, mtime timestamp"))
    got = {r["unit_id"]: (r["code"], r["code_unit_id"]) for r in df.collect()}
    assert set(got) == {"a", "stub", "wide"} and df.count() == 3  # no lines, no pair: nofile, beyond
    assert got["a"] == ("def f(x):\n    return 1", "a") and got["stub"] == ("def g(x):\n    return 2", "def")
    assert got["wide"][0].split("\n") == [f"line{i}" for i in range(60, 201)]
    none = docpairs.doc_pairs(spark.createDataFrame([], UNITS), spark.createDataFrame([], "path string, version string, text string, mtime timestamp"))
    assert none.count() == 0


@pytest.mark.parametrize(
    "signature,want",
    [
        ("f(x: A[B[C[D[int, str], int], int], int] = (1, 2), y=3)", "x,y"), ("f(a, sep=',', z='(')", "a,sep,z"), ("f()", ""), ("async f(self, *args: int, **kw) -> dict[str, int]", "self,*args,**kw"),
        ("f(a, /, b, *, c: 'x, y' = \"q)\")", "a,b,c"), (None, ""), ("f", ""), ("f(cb: Callable[[int], str] = lambda a, b: a, z = {1: (2, 3)})", "cb,z"), ("f(a='\\'', b=1)", "a,b"), ("f(" + "x: " + "L[" * 500 + "]" * 500 + ", y)", "x,y"),
    ],
)
def test_signatures(signature, want):
    assert docpairs.parameter_names(signature) == want


FILES = "path string, version string, text string, mtime timestamp"


def test_declarations_meet_separate_definitions(spark):
    """Overloads go by signature; rows follow the sources and the definitions."""
    deep = "g(x: A[B[C[D[int]]]] = (1, 2), sep: str = ',')"
    units = [
        unit("decl1", "stubs/m.pyi", "g", 1, 1, "Newest wins.", sig="g(x: int) -> int"), unit("decl2", "stubs/m.pyi", "g", 2, 2, "Oldest wins.", sig=deep), unit("decl3", "stubs/m.pyi", "h", 3, 3, "Fails when closed.", sig="h(x)"),
        unit("def1", "src/m.py", "g", 1, 2, None, sig="g(x)"), unit("def2", "src/m.py", "g", 3, 4, " ", sig="g(x, sep)"), unit("def2b", "src/m.py", "g#2", 5, 6, None, sig="g(x, sep)"), unit("lost", "stubs/n.pyi", "k", 1, 1, "Blocks until done.", sig="k(x)"), unit("defk", "src/n.py", "k", 1, 2, None, sig="k(x)"),
    ]
    files = [("src/m.py", "head", "def g(x):\n    return 1\ndef g(x, sep):\n    return 2\ndef g(x, sep):\n    return 3", T), ("stubs/m.pyi", "head", "def g(x): ...\ndef g(x, sep): ...\ndef h(x): ...", T), ("src/n.py", "head", "def k(x):\n    return 4", T)]

    def pairs(units, files):
        df = docpairs.doc_pairs(spark.createDataFrame(units, UNITS), spark.createDataFrame(files, FILES))
        rows = df.collect()
        assert all(r["code"] for r in rows)
        return {r["unit_id"]: (r["code_unit_id"], r["code"].split("\n")[-1].strip()) for r in rows}

    assert pairs(units, files) == {"decl1": ("def1", "return 1"), "decl2": ("def2", "return 2"), "decl3": ("decl3", "def h(x): ..."), "lost": ("defk", "return 4")}
    assert pairs([u for u in units if u[0] != "def2"], files)["decl2"][0] == "def2b"
    assert pairs([u for u in units if not u[0].startswith("def2")], files)["decl2"] == ("decl2", "def g(x, sep): ...")
    assert set(pairs([u for u in units if u[0] != "defk"], files)) == {"decl1", "decl2", "decl3"}
    assert set(pairs(units, files[1:])) == {"decl1", "decl2", "decl3", "lost"} and pairs(units, files[1:])["decl1"][0] == "decl1"
    assert pairs(units, []) == {}


WORDS = [f"word{i}" for i in range(60)]
ITEM = " ".join(WORDS) + ". List the callers now, one per line please."


def leak(spark, docs):
    items = [(1, ITEM, None, "x"), (2, "Other question text " + " ".join(f"other{i}" for i in range(40)) + ". List the callers now, one per line please.", "", "x"), (3, None, " ".join(f"third{i}" for i in range(30)) + ". List the callers now, one per line please.", "x"), (4, "Short. List the callers now, one per line please.", None, "x"), (None, ITEM, None, "x")]
    df = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, question string, answer string, text string"))
    return sorted(map(tuple, df.collect()))


def test_leaks(spark):
    part = WORDS[10:40]
    edited = [w for i, w in enumerate(part) if i != 7]  # one dropped
    edited[12:12] = ["new"]
    edited[20] = "changed"
    docs = [
        (1, "intro " + " ".join(part) + " outro", 0), (2, "> " + "\n> ".join(w.upper() for w in edited), 0), (3, " ".join(WORDS[:15]), 0), (4, " ".join(reversed(WORDS)), 0), (5, "List the callers now, one per line please. " * 9, 0),
        (6, " ".join(w[:3] + "-\n" + w[3:] for w in part), 0), (7, " ".join(part).replace("o", "о"), 0), (8, None, 0), (9, "", 0), (10, " ".join(w if i % 3 else "no" for i, w in enumerate(WORDS)), 0),
        (11, " ".join(f"third{i}" for i in range(5, 27)) + " and " + " ".join(part), 0), (None, ITEM, 0), (12, "filler " * 30000 + " ".join(part), 0), (1, "intro " + " ".join(part) + " outro", 0),
    ]
    assert leak(spark, docs) == [(1, 1), (2, 1), (6, 1), (7, 1), (11, 1), (11, 3), (12, 1)]
    assert leak(spark, []) == []


def test_stretch_against_edit_distance():
    rng = np.random.default_rng(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def brute(item, doc):
        for i in range(len(item)):
            for k in range(i + 20, len(item) + 1):
                most = (k - i) // 5
                for s in range(len(doc)):
                    if doc[s] == item[i]:
                        for e in range(max(s + 1, s + k - i - most), min(len(doc), s + k - i + most) + 1):
                            if doc[e - 1] == item[k - 1] and distance(item[i:k], doc[s:e]) <= most:
                                return True
        return False

    for _ in range(25):
        item = rng.integers(0, 300, 22)
        doc = item.copy()
        for _ in range(rng.integers(2, 7)):
            at, kind = rng.integers(0, len(doc)), rng.integers(0, 3)
            doc = np.delete(doc, at) if kind == 0 else np.insert(doc, at, -1) if kind == 1 else np.where(np.arange(len(doc)) == at, -1, doc)
        got = leakage.holds_stretch(item, doc)
        assert got == brute(item, doc)
        assert not got or leakage.dense_enough([item], [doc])[0]
        assert got or not leakage.holds_straight(item, doc)
        replaced = np.where(rng.random(22) < 0.15, -1, item)
        padded = np.concatenate([rng.integers(500, 600, 9), replaced, rng.integers(500, 600, 4)])
        assert leakage.holds_straight(item, padded) == brute(item, padded)


def test_plan_holds_every_item():
    rng = np.random.default_rng(0)
    for lengths in (np.clip(rng.lognormal(5, 1.1, 5000).astype(int), 1, 2048), rng.integers(300, 2049, 900), np.full(300, 700), np.full(3, 2048), np.array([], int)):
        u, c = np.unique(lengths, return_counts=True)
        histogram = dict(zip(u.tolist(), c.tolist()))
        classes, back = packing.container_classes(dict(histogram)), {}
        for parts, n in classes:
            assert n > 0 and sum(k * v for k, v in parts.items()) <= 2048
            for k, v in parts.items():
                back[k] = back.get(k, 0) + v * n
        assert back == histogram
        used, least = sum(n for _, n in classes), -(-int(lengths.sum()) // 2048)
        assert used <= max(least + 2, 1.1 * least) or (lengths == 700).all() and used == 150


def test_plan_size_does_not_follow_the_counts():
    histogram = {n: 3 for n in range(1, 2000, 7)}
    small = len(packing.container_classes(histogram))
    assert len(packing.container_classes({k: v * 100_000 for k, v in histogram.items()})) < 4 * small


@needs_tokens
def test_pack_documents(spark):
    docs = [(i, "some words here " * (i % 90), "c") for i in range(300)] + [(1000, "long text " * 4000, "c"), (1001, None, "c"), (1002, "", "c"), (None, "x", "c"), (7, "some words here " * 7, "c")]
    df = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string, container_id string"), bucket_rows=50)
    rows = df.collect()
    encode = packing.encoding(TOKENS).encode_ordinary
    total = sum(len(encode(t)) for d, t, _ in docs if d is not None and t)
    assert sum(r["n_tokens"] for r in rows) == total
    room = {}
    for r in rows:
        if r["container_id"] is None:
            assert r["n_tokens"] == 0
        else:
            room.setdefault(r["container_id"], [0, set()])
            room[r["container_id"]][0] += r["n_tokens"]
            room[r["container_id"]][1].add(r["space_left"])
    assert all(n <= 2048 and left == {2048 - n} for n, left in room.values())
    assert [(r["piece"], r["token_start"]) for r in sorted(rows, key=lambda r: r["piece"]) if r["doc_id"] == 1000][:2] == [(0, 0), (1, 2048)]
    assert sum(r["doc_id"] == 7 for r in rows) == 2 and len(room) <= -(-total // 2048) + 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


EASY = ["the dog sees a ball", "we go to the house", "the sun is warm today", "I like my red book", "you can see the tree"]
HARD = ["notwithstanding epistemological heterogeneity the falsifiability of provenance necessitates amortisation", "inasmuch as dimensionality precludes stratification the idempotence circumscribes reconciliation"]


def levels(spark, docs, labels):
    df = reading.reading_levels(spark.createDataFrame(docs, "doc_id long, text string, lang string, level int"), spark.createDataFrame(labels, "doc_id long, rater_id int, grade int"))
    return {r["doc_id"]: (r["level"], r["too_demanding"]) for r in df.collect()}


def test_reading_levels(spark):
    docs = [(i, ". ".join(HARD if i % 4 == 0 else EASY[i % 5 :] + EASY[: i % 5]) + ".", "en", 0) for i in range(80)]
    docs += [
        (100, "```\nnotwithstanding = epistemological\n```\n> " + HARD[0] + ".\n\n" + ". ".join(EASY) + ".", "EN", 0), (101, "- " + "\n- ".join(HARD), None, 0), (102, "der Hund und die Katze sind nicht in dem Haus und es ist warm.", None, 0),
        (103, None, "en", 0), (104, " ", "en", 0), (105, "| a_b | 1 |\n| c_d | 2 |", "en", 0), (106, "2025-01-01 run a_b exit=0 ms=1", "en", 0), (107, HARD[0].replace(" ", "\n") + ".", "en-US", 0), (None, EASY[0], "en", 0), (108, "> " + ". ".join(EASY), "en", 0),
    ]
    labels = [(i, 1, 5 if i % 4 == 0 else 1) for i in range(60)] + [(1, 1, 1), (2, 2, None), (3, 2, 9), (None, 1, 5), (500, 1, 4)]
    got = levels(spark, docs, labels)
    assert {i for i, (_, hard) in got.items() if hard} == {i for i in range(0, 80, 4)} | {101, 107}
    assert set(got) == set(range(80)) | {100, 101, 107, 108} and got[100][0] < 4
    assert levels(spark, [], labels) == {}
    assert levels(spark, docs[:3], []) == {0: (1, False), 1: (1, False), 2: (1, False)}  # all words familiar, published cuts
    rare = [(i, ". ".join(EASY), "en", 0) for i in range(400)] + [(400, ". ".join(HARD) + ".", "en", 0)]
    assert levels(spark, rare, [])[400] == (5, True) and levels(spark, rare, [])[0] == (1, False)


def test_cut_points():
    assert 2 < reading.best_cut(np.array([1.0, 2.0, 3.0, 4.0]), np.array([False, False, True, True])) < 3
    assert reading.best_cut(np.array([1.0, 1.0]), np.array([True, True])) <= 1
