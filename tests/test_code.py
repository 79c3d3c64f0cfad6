"""Windows of code, drafts, change checks, scripts, routes, tags: small fixtures and brute force."""

import itertools

import pytest

from corvane.functions import code as C
from corvane.operators import routes, setsim, unitsim
from corvane.sources import loaders
from corvane.sources.parse import parse_files, router_prefixes
from corvane.sources.scripts import scan_scripts, wrappers_of

FILES = "path string, text string"
BODY = "    total = 0\n    for row in rows:\n        if row.ready and row.size > limit:\n            total += row.size\n    return total\n"
UNITS = "unit_id string, path string, kind string, name string, start_line int, end_line int, body_hash string"


def test_windows_and_drafts():
    assert C.window_set(list("abcd")) == [] and len(C.window_set(list("abcdeabcde"))) == 5
    assert C.window_hash(list("abcde")) == C.window_hash(("a", "b", "c", "d", "e")) != C.window_hash(list("abced"))
    one = C.draft_windows("def f(rows, limit):\n" + BODY)
    assert one == C.draft_windows("import os\n\ndef f(rows, limit):\n    '''Says something.'''\n    # note\n" + BODY)
    assert C.draft_windows("def f():\n    return 1\n") == [] == C.draft_windows("x = 1\n")
    two = C.draft_windows("def f(rows, limit):\n" + BODY + "\n\ndef g():\n    return 1\n")
    assert set(one) < set(two)
    with pytest.raises(SyntaxError):
        C.draft_windows("def (")
    assert C.decode_set(C.encode_set(one)) == one and C.decode_set(b"x") is None is C.decode_set(C.encode_set(one)[:-2]) and C.decode_set(None) is None
    assert C.strip_documentation('class A:\n    """Doc."""\n    def f(self):\n        """Doc."""\n        if 1:\n            "kept"') == 'class A:\n\n    def f(self):\n        if 1:\n            \'kept\''


def test_unit_windows_and_changes(spark):
    decorated = "@cached\n@traced(1)\ndef big(rows, limit):\n" + BODY
    other = "def copy(rows, limit):\n" + BODY
    files = [("a.py", decorated + "\n\ndef small():\n    return 1\n\n\n\n\n"), ("b.py", other), ("bad.py", "def ("), ("none.py", None)]
    units = [("a::big", "a.py", "function", "big", 1, 8, "h1"), ("a::small", "a.py", "function", "small", 11, 16, "h2"), ("b::copy", "b.py", "function", "copy", 1, 6, "h3"), ("a::C", "a.py", "class", "C", 1, 8, "h4"), ("bad::f", "bad.py", "function", "f", 1, 9, "h5")]
    u, f = spark.createDataFrame(units, UNITS), spark.createDataFrame(files, FILES)
    sets = {r["unit_id"]: r["ws"] for r in unitsim.unit_windows(u, f).collect()}
    assert set(sets) == {"a::big", "a::small", "b::copy"} and sets["a::small"] == [] and sets["b::copy"] == C.draft_windows(other)
    cache = spark.createDataFrame([("h1", [1, 2, 3]), (None, [1])], "body_hash string, ws array<bigint>")
    assert {r["unit_id"]: r["ws"] for r in unitsim.unit_windows(u, f, cache).collect()} == sets | {"a::big": [1, 2, 3]}

    index = unitsim.unit_windows(u, f)
    matches = lambda base: {(r["unit_id"], r["match_id"]) for r in unitsim.check_changes(index.where("path = 'b.py'"), unitsim.base_functions(spark.createDataFrame(base, FILES)), index).collect()}
    assert matches([]) == {("b::copy", "a::big")}  # no former version: all of it is new
    assert matches([("b.py", other)]) == set()
    assert matches([("b.py", other.replace("copy", "renamed"))]) == {("b::copy", "a::big")}
    assert matches([("b.py", "def copy(rows, limit):\n    return 1\n")]) == {("b::copy", "a::big")}
    assert matches([("b.py", other + "\n\ndef copy(x):\n    return x\n")]) == {("b::copy", "a::big")}  # the last of a name counts


def texts(n, copies):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[(i * 7) % 90 : (i * 7) % 90 + 40] + ["the same closing words that every one of these texts has at its very end"])) for i in range(n)]
    return rows + [(1000 + i, "one text that is copied very often and has enough words in it to be compared with all the others here twice") for i in range(copies)]


@pytest.mark.parametrize("block", [4000, 7])
def test_exact_pairs_have_no_cap(spark, block):
    rows = texts(70, 61)
    pairs, members = setsim.exact_pairs(spark.createDataFrame(rows, "id int, text string"), "id", "text", block_rows=block)
    sets = {}
    for i, t in rows:
        tok = t.split()
        sets[i] = frozenset(tuple(tok[k : k + 5]) for k in range(len(tok) - 4))
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    want = {}
    for a, b in itertools.combinations(sorted(reps.values()), 2):
        both = len(sets[a] & sets[b])
        if both >= 3 and both / len(sets[a] | sets[b]) >= setsim.FLOOR:
            want[a, b] = both
    assert {(r["rep_a"], r["rep_b"]): r["shared"] for r in pairs.collect()} == want and want
    got = {r["id"]: (r["rep"], r["class_size"]) for r in members.collect()}
    assert got[1060] == (1000, 61) and all(got[i][0] == reps[sets[i]] for i in sets)


SCRIPT = """
import x from 'y'
export async function call(url, opts = {}) {
  // fetch('/no')
  const r = /fetch\\('\\/no'\\)/g
  return fetch(url, { ...opts, 'method': "put" })
}
const get2 = (u) => fetch(u)
const other = async u => { log(u); return window.fetch(u, {}) }
const fixed = (u) => fetch('/fixed', { method: `post`, body: u })
class A { fetch(url) { return this.fetch('/in-class') } }
call('/users/1', { body: {method: 'X'}, method: 'POST' })
axios.delete(`/users/${id}`)
this.$axios
  .get('/chain')
fetch('https://other/x'); fetch('//cdn/x'); fetch(makeUrl())
new fetch('/new')
get2("/w2"); unknown('/u')
const t = `a ${fetch('/inner')} b`
fetch()
"""


def test_scripts_by_structure(spark):
    assert wrappers_of(SCRIPT) == {"call", "get2", "other"}
    assert wrappers_of("function long(u) {" + "\n  log(u)" * 3000 + "\n  return fetch(u)\n}") == {"long"}
    rows = [("a.js", SCRIPT), ("b.js", "function unknown(a) { return fetch('/b') }\nother('/far')"), ("c.js", None)]
    got = {tuple(r) for r in scan_scripts(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {
        ("a.js", 6, "", "PUT"), ("a.js", 8, "", "GET"), ("a.js", 9, "", "GET"), ("a.js", 10, "/fixed", "POST"), ("a.js", 11, "/in-class", "GET"), ("a.js", 12, "/users/1", "POST"), ("a.js", 13, "/users/${id}", "DELETE"),
        ("a.js", 14, "/chain", "GET"), ("a.js", 16, "", "GET"), ("a.js", 18, "/w2", "GET"), ("a.js", 19, "/inner", "GET"), ("b.js", 1, "/b", "GET"), ("b.js", 2, "/far", "GET"),
    }


def test_routes_and_bound_calls(spark):
    files = [
        ("src/api/items.py", "router = APIRouter(prefix='/items')\nother = APIRouter()\n\n@router.get('/{item_id}')\n@router.get('/{item_id}')\ndef read(item_id):\n    pass\n\n@other.post('/plain/')\nasync def plain():\n    pass\n"),
        ("src/api/main.py", "from api import admin\nfrom .users import router as users\nimport api.extra\napp.include_router(users, prefix='/users')\napp.include_router(admin.router, prefix='/admin')\napp.include_router(local, prefix='/no')\napp.include_router(users, prefix=PREFIX)\n"),
        ("src/api/users.py", "@router.get('')\ndef listed():\n    pass\n"), ("src/api/twice.py", "@app.get('/twice')\ndef one():\n    pass\n\n@app.get('/twice')\ndef two():\n    pass\n"),
    ]
    f = spark.createDataFrame(files, FILES)
    prefixes = router_prefixes(f)
    assert {tuple(r) for r in prefixes.collect()} == {("api.items", "router", "/items"), ("api.users", "router", "/users"), ("api", "router", "/admin")}
    e = parse_files(f).where("tag = 'endpoint'").selectExpr("unit_id", "path", "name AS method", "text AS route", "decorators_json")
    full = routes.full_routes(e, prefixes)
    assert {(r["unit_id"].split("::")[1], r["method"], r["full_route"]) for r in full.collect()} == {("read", "GET", "/items/{item_id}"), ("plain", "POST", "/plain"), ("listed", "GET", "/users"), ("one", "GET", "/twice"), ("two", "GET", "/twice")}
    calls = spark.createDataFrame([("a.js", 1, "/items/${id}?x=1", "GET"), ("a.js", 2, "/users/", "GET"), ("a.js", 3, "/twice", "GET"), ("a.js", 4, "", "GET"), ("a.js", 5, "/items/${a}/b", "GET"), ("a.js", 6, "/items/7", "POST")], "path string, line int, url string, method string")
    bound = routes.bound_calls(calls, full)
    assert {r["line"]: (r["unit_id"] or "").split("::")[-1] for r in bound.collect()} == {1: "read", 2: "listed", 3: "", 4: "", 5: "", 6: ""}
    why = bound.where("unit_id is null").select("line", routes.unbound_reason(bound["url"]).alias("why")).collect()
    assert {r["line"]: r["why"] for r in why} == {3: "no route", 4: "computed", 5: "interpolated", 6: "no route"}
    assert {r["unit_id"].split("::")[1]: r["callers"] for r in routes.client_callers(bound).collect()} == {"read": ["a.js:1 — GET /items/${id}?x=1"], "listed": ["a.js:2 — GET /users/"]}


def test_tags(spark):
    text = "# corvane: unit task.main\n@deco\ndef f():\n    pass\n\n# corvane: begin area.all\nclass A:\n    # corvane: unit task.inner\n    def g(self):\n        '''\n        # corvane: end area.all\n        '''\n# corvane: end area.all\n"
    rows = [("ok.py", text), ("loose.py", "# corvane: unit x\n\ndef f():\n    pass\n"), ("indent.py", "class A:\n  # corvane: unit x\n    \n  def f(self): pass\n"), ("twice.py", "# corvane: unit x\ndef f(): pass\n# corvane: unit x\ndef g(): pass\n")]
    got = parse_files(spark.createDataFrame(rows, FILES)).collect()
    assert [(r["unit_id"], r["kind"], r["start_line"], r["end_line"]) for r in got if r["path"] == "ok.py" and r["tag"] in ("unit", "region")] == [("task.main", "function", 2, 4), ("ok::A", "class", 7, 12), ("task.inner", "function", 9, 12), ("area.all", "region", 7, 12)]
    errors = {r["path"]: r["text"] for r in got if r["tag"] == "error"}
    assert set(errors) == {"loose.py", "indent.py", "twice.py"} and "before no declaration" in errors["loose.py"] and "used twice" in errors["twice.py"]


def test_hashes_ignore_tags_and_accessors_keep_their_names(spark):
    one = "# corvane: unit a.b\n@router.get('/x')\ndef f(x=Depends(store), y=Depends(api.user), z=Depends()):\n    # corvane: begin r.s\n    return x.value\n    # corvane: end r.s\n"
    two = one.replace("a.b", "c.d").replace("r.s", "t.u")
    other = "class A:\n    @property\n    def x(self): return 1\n    @x.setter\n    def x(self, v): pass\n    @y.setter\n    def z(self, v): pass\n"
    got = {r["unit_id"]: r for r in parse_files(spark.createDataFrame([("one.py", one), ("two.py", two), ("o.py", other)], FILES)).where("tag in ('unit', 'region')").collect()}
    assert set(got) == {"a.b", "c.d", "r.s", "t.u", "o::A", "o::A.x", "o::A.x@setter", "o::A.z"}
    assert got["a.b"]["body_hash"] == got["c.d"]["body_hash"] != got["r.s"]["body_hash"] == got["t.u"]["body_hash"]
    assert got["a.b"]["dependencies_json"] == '["api.user", "store"]' and got["r.s"]["body_terms"] == "return value"
    assert got["o::A.x"]["concepts_json"] == '["a", "o", "o::A.x", "x"]'


def test_loaders(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"corpus": "c", "left": "b", "right": "a", "label": "same"}, {"corpus": "c", "left": "a", "right": "b", "label": "same"}]')
    got = loaders.load_labels(spark, str(tmp_path / "l.json"), ["same", "other"], whole=True)
    assert [tuple(r) for r in got.collect()] == [("c", "a", "b", "same")]
    (tmp_path / "m.json").write_text('{"corpus": "c", "left": "b", "right": "a", "label": "same"}\n{"corpus": "c", "left": "a", "right": "b", "label": "other"}\n')
    with pytest.raises(ValueError):
        loaders.load_labels(spark, str(tmp_path / "m.json"), ["same", "other"])
    (tmp_path / "c.json").write_text('{"item_id": 1, "question": "q"}\n{"item_id": 2, "question": " "}\n{"item_id": 3, "question": "q"}\n{"item_id": 3, "question": "r"}\n{"question": "q"}\n')
    kept, left = loaders.load_cases(spark, str(tmp_path / "c.json"))
    assert [r["item_id"] for r in kept.collect()] == [1] and {tuple(r) for r in left.collect()} == {("no question", 1), ("repeated id", 2), ("no id", 1)}


def test_search_scores_are_the_six_fields(spark):
    from corvane.functions import fuzzy
    from corvane.operators import search

    fields = "unit_id string, path string, start_line int, name string, qualname string, purpose string, doc_text string, signature string, concepts_json string, owns_json string, body_terms string, parameters_json string, returns string"
    rows = [
        ("u1", "a.py", 1, "save_report", "Store.save_report", "Writes a report.", "Writes a report to the store and keeps it.", "save_report(path: str) -> bool", '["report", "save_report"]', '["disk"]', "save report path store", '[{"name":"path","type":"str"},{"name":"n","type":"list[str]"}]', "bool"),
        ("u2", "a.py", 9, "load", "load", "load", "", "load()", "[]", "[]", "load", "[]", ""),
        ("u3", "b.py", 1, "persist", "persist", None, None, None, None, None, None, None, None),
    ]
    u = spark.createDataFrame(rows, fields)
    ask = ["save the report", "load"]
    got = {(r["query"], r["unit_id"]): r for r in search.scores(u, search.query_table(spark, ask), ["str", "int"], "bool").collect()}
    assert len(got) == 6
    for q in ask:
        for r in rows:
            text = {k: v or "" for k, v in zip(fields.replace(" string", "").replace(" int", "").split(", "), r)}
            terms = [t for t in q.split() if t != "the"]
            concept = {"u1": "report save_report disk"}.get(r[0], "")
            want = {
                "body": 100.0 * sum(t in text["body_terms"] for t in terms) / len(terms), "name": fuzzy.weighted_ratio(q, text["name"]), "qualname": fuzzy.weighted_ratio(q, text["qualname"]),
                "purpose": max(fuzzy.token_set_ratio(q, text["purpose"]), fuzzy.token_set_ratio(q, text["doc_text"])), "signature": fuzzy.token_set_ratio(q, text["signature"]), "concepts": fuzzy.token_set_ratio(q, concept),
            }
            bonus = 6.0 + 12.0 if r[0] == "u1" else 0.0
            hit = got[q, r[0]]
            assert {f: round(hit[f], 9) for f in want} == {f: round(v, 9) for f, v in want.items()} and hit["type_bonus"] == bonus
            assert abs(hit["score"] - min(100.0, bonus + sum(want[f] * w for f, w in search.WEIGHTS.items()))) < 1e-9
    plain, wide = ({(r["query"], r["unit_id"]): r["score"] for r in search.search(u, ask, None, e).collect()} for e in (False, True))
    assert wide["save the report", "u3"] > plain["save the report", "u3"] and wide["load", "u2"] == plain["load", "u2"]
