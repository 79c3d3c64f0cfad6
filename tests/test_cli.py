"""The commands over a small tree."""

import json

import pytest

from corvane.cli import main

TOTAL = "    total = 0\n    for row in rows:\n        if row.ready and row.size > limit:\n            total += row.size\n    return total\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for path, text in {
        "src/shop/tools.py": "def sum_ready(rows, limit):\n    \"\"\"Adds up what is ready.\"\"\"\n" + TOTAL + "\n\ndef load_orders(name: str) -> list[str]:\n    return sum_ready(name, 1)\n",
        "src/shop/api.py": "from shop.tools import load_orders\nrouter = APIRouter(prefix='/orders')\n\n@router.get('/{name}')\ndef read_orders(name):\n    return load_orders(name)\n",
        "tests/test_tools.py": "from shop.tools import load_orders\n\ndef test_load_orders():\n    assert load_orders('x')\n",
        "web/app.js": "fetch(`/orders/${name}`)\nfetch('/gone')\n", "bad.py": "def (", "venv/skip.py": "x = 1\n",
    }.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    return at


@pytest.fixture(scope="module")
def run(spark, root):
    def call(capsys, *args, want=0):
        assert main(["--root", str(root), "--index", str(root.parent / "index"), *args], spark) == want
        return capsys.readouterr().out

    return call


def test_commands(run, root, capsys, tmp_path):
    assert run(capsys, "search", "x", want=2) == ""
    out = run(capsys, "build")
    assert "skipped bad.py: SyntaxError" in out and "4 units, version 1" in out
    rows = json.loads(run(capsys, "search", "load orders", "--json", "--returns", "list[str]"))
    assert rows[0]["unit_id"] == "src.shop.tools::load_orders" and len(rows) == 4
    assert run(capsys, "read", "sum_ready", "--header").startswith("# src.shop.tools::sum_ready src/shop/tools.py:1-7\ndef sum_ready")
    assert "def sum_ready" in run(capsys, "read", "tools.py:3") and run(capsys, "read", "nothing", want=2) == ""
    text = run(capsys, "trace", "load_orders")
    assert "target: src.shop.tools::load_orders" in text and "caller: src.shop.api::read_orders" in text and "callee: src.shop.tools::sum_ready" in text and "test_load_orders" in text
    assert "test: " not in run(capsys, "trace", "load_orders", "--no-tests", "--callers", "0", "--signatures")
    assert run(capsys, "trace", "--undocumented", "--dry").split() == ["src.shop.api::read_orders"]
    assert run(capsys, "trace", "--endpoints", "--dry").split() == ["src.shop.api::read_orders"]
    (tmp_path / "m").write_text("callee: sum_ready  # seen\ntools.py::nothing\n")
    assert "callee: src.shop.tools::sum_ready" in run(capsys, "trace", "load_orders", "--members-from", str(tmp_path / "m"))
    assert run(capsys, "endpoints") == "GET /orders/{name} src.shop.api::read_orders\n  web/app.js:1 — GET /orders/${name}\n"
    assert run(capsys, "endpoints", "--unbound") == "web/app.js:2 GET /gone (no route)\n"
    assert "## src/shop/tools.py\n- `sum_ready` (function, 1)\n- `load_orders` (function, 10)" in run(capsys, "map")

    (tmp_path / "draft.py").write_text("def mine(rows, limit):\n" + TOTAL)
    assert "src.shop.tools::sum_ready" in run(capsys, "similar", "--draft", str(tmp_path / "draft.py"))
    assert run(capsys, "similar", "sum_ready").strip() == ""
    (tmp_path / "draft.py").write_text("def (")
    run(capsys, "similar", "--draft", str(tmp_path / "draft.py"), want=2)

    (root / "src/shop/copy.py").write_text("def again(rows, limit):\n" + TOTAL)
    (root / "bad.py").unlink()
    assert "5 units, version 2" in run(capsys, "update", "src/shop/copy.py")
    assert "src.shop.copy::again is like src.shop.tools::sum_ready" in run(capsys, "check", "src/shop/copy.py", "--fail-on-overlap", want=1)
    base = tmp_path / "base"
    (base / "src/shop").mkdir(parents=True)
    (base / "src/shop/copy.py").write_text("def again(rows, limit):\n" + TOTAL)
    assert run(capsys, "check", "src/shop/copy.py", "--base", str(base), "--rate").strip() == "2 of 5 functions overlap another"


def test_field_log(run, root, capsys, tmp_path):
    log = tmp_path / "log.jsonl"
    run(capsys, "--log", str(log), "read", "nothing", want=2)
    run(capsys, "--log", str(log), "read", "sum_ready")
    rows = [json.loads(x) for x in log.read_text().splitlines()]
    assert [(r["command"], r["exit"]) for r in rows] == [("read", 2), ("read", 0)] and all(r["at"] and r["ms"] >= 0 for r in rows)
    (root / ".corvane").mkdir()
    run(capsys, "--log", str(tmp_path / "no" / "log"), "read", "sum_ready")
    assert len((root / ".corvane" / "field.jsonl").read_text().splitlines()) == 1
