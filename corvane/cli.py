"""Commands over a source tree and its index: arguments in, text or JSON out, exit codes.

0: done; 1: a build that failed, or overlaps where these are to fail; 2: an argument that
names nothing, or several things.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import code as C
from .operators import graph, intervals, routes, search, setsim, unitsim
from .operators.build import Index, rendered
from .operators.manifest import PublishConflict
from .session import local_session
from .sources.scripts import scan_scripts
from .sources.tree import config_excludes, own_scripts, read_tree, resolve_member_lines
from .streaming.fieldlog import record

class Unclear(Exception):
    """An argument that names no unit, or several."""


class Project:
    """A tree under ``root`` and its index under ``place``."""

    def __init__(self, spark: SparkSession, root: str, place: str | None, excludes: list[str]):
        self.spark, self.root, self.excludes = spark, root, config_excludes(root, excludes)
        self.index = Index(spark, place or f"{root}/.corvane")

    def tree(self, root: str | None = None) -> DataFrame:
        return read_tree(self.spark, root or self.root, excludes=self.excludes).select("path", "text")

    def sources(self) -> DataFrame:
        return self.tree().select("path", F.lit("head").alias("version"), "text", F.lit(None).cast("timestamp").alias("mtime"))

    def units(self) -> DataFrame:
        """Units of the index as tables elsewhere have them."""
        return self.index.units().withColumn("removed", F.lit(False))

    def searched(self) -> DataFrame:
        return self.units().withColumn("owns_json", F.lit("[]"))

    def sets(self) -> DataFrame:
        return unitsim.unit_windows(self.units(), self.tree())

    def resolve(self, query: str) -> list[str]:
        """Ids that ``query`` means: an id, else path:line within a unit, else a name."""
        u = self.units()
        exact = u.where(F.col("unit_id") == query)
        path, _, line = query.rpartition(":")
        if exact.isEmpty() and path and line.isdigit():
            exact = u.where((F.col("path") == path) | F.endswith("path", F.lit("/" + path))).where(F.lit(int(line)).between(F.col("start_line"), F.col("end_line")))
        if exact.isEmpty():
            exact = u.where((F.col("name") == query) | (F.col("qualname") == query) | (F.concat_ws("::", "path", "qualname") == query))
        return [r["unit_id"] for r in exact.select("unit_id").distinct().orderBy("unit_id").collect()]

    def one(self, query: str) -> str:
        found = self.resolve(query)
        if len(found) != 1:
            raise Unclear(f"{query}: no such unit" if not found else f"{query} may be any of {', '.join(found)}")
        return found[0]

    def edges(self, relation: str) -> DataFrame:
        e = self.index.read("edges").where((F.col("relation") == relation) & (F.col("target_kind") == "unit"))
        return e.select(F.col("source_unit_id").alias("source"), F.col("target_ref").alias("target"), F.explode_outer("lines").alias("line"))

    def routes(self) -> DataFrame:
        p = self.index.read("parsed")
        e = p.where("tag = 'endpoint'").select("unit_id", "path", F.col("name").alias("method"), F.col("text").alias("route"), "decorators_json")
        return routes.full_routes(e, p.where("tag = 'prefix'").select(F.col("qualname").alias("module"), F.col("name").alias("router"), F.col("text").alias("prefix")))

    def calls(self) -> DataFrame:
        scripts = read_tree(self.spark, self.root, "*.js", self.excludes).where(own_scripts(F.col("path")))
        return routes.bound_calls(scan_scripts(scripts.select("path", "text")), self.routes())


def _show(args, rows: list[dict], line) -> None:
    print(json.dumps(rows, default=str) if args.json else "\n".join(map(line, rows)))


def build(p: Project, args) -> int:
    try:
        p.index.rebuild(p.tree())
    except (ValueError, PublishConflict) as e:
        print(e, file=sys.stderr)
        return 1
    skipped = [r.asDict() for r in p.index.read("parsed").where("tag = 'error'").select("path", F.col("text").alias("reason")).orderBy("path").collect()]
    if not args.quiet:
        _show(args, skipped, lambda r: f"skipped {r['path']}: {r['reason']}")
        print(f"{p.index.units().count()} units, version {p.index.version()}")
    return 0


def update(p: Project, args) -> int:
    if args.if_exists and not p.index.version():
        return 0
    tree = p.tree()
    p.index.update(tree.where(F.col("path").isin([x for x in args.paths if x.endswith(".py")])), tree=tree)
    print(f"{p.index.units().count()} units, version {p.index.version()}")
    return 0


def find(p: Project, args) -> int:
    got = search.search(p.searched(), [args.query], args.limit, True, args.input, args.returns)
    rows = [r.asDict() for r in got.join(p.units().select("unit_id", "path", "start_line", "signature", "purpose"), "unit_id").orderBy("place").collect()]
    _show(args, rows, lambda r: f"{r['score']:6.2f} {r['unit_id']} {r['path']}:{r['start_line']} {r['purpose']}")
    return 0


def similar(p: Project, args) -> int:
    sets = p.sets()
    if args.draft:
        text = sys.stdin.read() if args.draft == "-" else Path(args.draft).read_text()
        try:
            ws = C.draft_windows(text)
        except SyntaxError as e:
            raise Unclear(f"the draft can't be parsed: {e}") from e
        needle = p.spark.createDataFrame([("draft", None, ws)], "needle_id string, self_id string, ws array<bigint>")
    else:
        unit = p.one(args.unit)
        needle = sets.where(F.col("unit_id") == unit).select(F.col("unit_id").alias("needle_id"), F.col("unit_id").alias("self_id"), "ws")
    rows = [r.asDict() for r in unitsim.similar_units(needle, sets, args.limit, args.floor).orderBy("place").collect()]
    _show(args, rows, lambda r: f"{r['score']:.3f} {r['unit_id']} ({r['shared']} windows)")
    return 0


def check(p: Project, args) -> int:
    sets = p.sets()
    tree = p.tree()
    base = p.tree(args.base) if args.base else tree.limit(0)
    changed = tree.where(F.col("path").isin(args.paths)) if args.paths else tree.join(base, ["path", "text"], "left_anti")
    files = changed.select("path", "text")
    now = p.units().join(files.select("path"), "path", "left_semi")
    found = unitsim.check_changes(unitsim.unit_windows(now, files), unitsim.base_functions(base if not args.all_overlaps else base.limit(0)), sets, args.limit, args.floor)
    rows = [r.asDict() for r in found.orderBy(F.desc("score"), "unit_id", "match_id").collect()]
    _show(args, rows, lambda r: f"{r['score']:.3f} {r['unit_id']} is like {r['match_id']}")
    if args.rate:
        needles = sets.where("size(ws) > 0").select(F.col("unit_id").alias("needle_id"), F.col("unit_id").alias("self_id"), "ws")
        fired = unitsim.similar_units(needles, sets, 1, args.floor).select("needle_id").distinct().count()
        print(f"{fired} of {p.units().where(F.col('kind').isin(*unitsim.FUNCTIONS)).count()} functions overlap another")
    return 1 if rows and args.fail_on_overlap else 0


def trace(p: Project, args) -> int:
    u = p.units()
    if args.undocumented:
        named = F.col("name").rlike("^__.*__$") | F.exists(F.from_json("decorators_json", "array<string>"), lambda x: x.rlike(r"^property$|\.(setter|deleter|getter)$"))
        bare = u.where(F.col("kind").isin(*unitsim.FUNCTIONS) & (F.coalesce("doc_text", F.lit("")) == "") & ~named & (F.col("end_line") - F.col("start_line") + 1 > 2))
        roots = [r["unit_id"] for r in bare.orderBy("path", "start_line").collect()]
    elif args.endpoints:
        kept = p.routes().where(F.contains(F.lower("full_route"), F.lit((args.route or "").lower())) | F.contains(F.lower("unit_id"), F.lit((args.route or "").lower())))
        roots = [r["unit_id"] for r in kept.select("unit_id").distinct().orderBy("unit_id").collect()]
    else:
        roots = [p.one(args.unit)]
    if args.dry:
        print("\n".join(roots))
        return 0
    start = p.spark.createDataFrame([(r,) for r in roots], "id string")
    if args.members_from:
        members = [(roots[0], m, role) for role, ref in resolve_member_lines(Path(args.members_from).read_text()) for m in p.resolve(ref)[:1]]
        parts = p.spark.createDataFrame(members, "root string, unit_id string, role string").withColumn("depth", F.lit(1))
    else:
        tests = p.edges("TESTED_BY") if not args.no_tests else p.edges("TESTED_BY").limit(0)
        down, up = (2, 0) if args.endpoints and args.callees is None else (1 if args.callees is None else args.callees, args.callers)
        parts = graph.slices(start, p.edges("CALLS"), tests, u.select("unit_id"), down, up, args.limit)
    shown = u.select("unit_id", "path", "start_line", "end_line", "signature")
    code = shown.select("unit_id", F.col("signature").alias("code")) if args.signatures else intervals.unit_code(shown, p.sources())
    text = rendered(parts, shown, code).join(start.withColumnRenamed("id", "root"), "root", "left_semi")
    for r in text.orderBy("root").collect():
        print(json.dumps(r.asDict()) if args.json else r["markdown"])
    return 0


def read(p: Project, args) -> int:
    unit = p.one(args.unit)
    u = p.units().where(F.col("unit_id") == unit)
    row = u.join(intervals.unit_code(u, p.sources()), "unit_id").first()
    if args.header:
        print(f"# {unit} {row['path']}:{row['start_line']}-{row['end_line']}")
    print(row["code"])
    return 0


def endpoints(p: Project, args) -> int:
    if args.unbound:
        left = p.calls().where("unit_id is null").withColumn("reason", routes.unbound_reason(F.col("url"))).orderBy("path", "line")
        _show(args, [r.asDict() for r in left.collect()], lambda r: f"{r['path']}:{r['line']} {r['method']} {r['url']} ({r['reason']})")
        return 0
    got = p.routes().join(routes.client_callers(p.calls()), "unit_id", "left").orderBy("full_route", "method", "unit_id")
    _show(args, [r.asDict() for r in got.collect()], lambda r: "\n".join([f"{r['method']} {r['full_route']} {r['unit_id']}", *(f"  {c}" for c in r["callers"] or [])]))
    return 0


def render_map(p: Project, args) -> int:
    line = F.concat(F.lit("- `"), F.col("qualname"), F.lit("` ("), F.col("kind"), F.lit(", "), F.col("start_line").cast("string"), F.lit(")"))
    per = p.units().groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_line", "unit_id", line.alias("line")))).alias("ls"))
    text = "\n\n".join(f"## {r['path']}\n" + "\n".join(x["line"] for x in r["ls"]) for r in per.orderBy("path").toLocalIterator())
    Path(args.output).write_text(text + "\n") if args.output else print(text)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description=__doc__)
    top.add_argument("--root", default=".")
    top.add_argument("--index")
    top.add_argument("--log")
    top.add_argument("--exclude", action="append", default=[])
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        c = sub.add_parser(name)
        c.add_argument("--json", action="store_true")
        for flags, kind in options:
            c.add_argument(*flags, **kind)
        c.set_defaults(run=run)

    flag = {"action": "store_true"}
    limit, floor = lambda n: (("--limit",), {"type": int, "default": n}), (("--floor",), {"type": float, "default": setsim.FLOOR})
    unit = (("unit",), {"nargs": "?"})
    paths = (("paths",), {"nargs": "*"})
    add("build", build, (("--quiet",), flag))
    add("update", update, paths, (("--if-exists",), flag))
    add("search", find, (("query",), {}), limit(8), (("--input",), {"action": "append", "default": []}), (("--returns",), {}))
    add("similar", similar, unit, (("--draft",), {}), limit(8), floor)
    add("check", check, paths, (("--base",), {}), limit(3), floor, (("--all-overlaps",), flag), (("--fail-on-overlap",), flag), (("--rate",), flag))
    add("trace", trace, unit, (("--undocumented",), flag), (("--endpoints",), flag), (("--route",), {}), (("--dry",), flag), (("--callers",), {"type": int, "default": 1}), (("--callees",), {"type": int}), limit(40), (("--members-from",), {}), (("--no-tests",), flag), (("--signatures",), flag))
    add("read", read, unit, (("--header",), flag))
    add("endpoints", endpoints, (("--unbound",), flag))
    add("map", render_map, (("--output",), {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    p = Project(spark or local_session(), args.root, args.index, args.exclude)
    if args.command not in ("build", "update") and not p.index.version():
        print("there is no index; build one first", file=sys.stderr)
        return 2
    began, code = time.time(), 2
    try:
        code = args.run(p, args)
    except Unclear as e:
        print(e, file=sys.stderr)
    finally:
        record({"command": args.command, "exit": code, "ms": round(1000 * (time.time() - began))}, args.log, args.root)
    return code


if __name__ == "__main__":
    raise SystemExit(main())
