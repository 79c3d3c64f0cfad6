"""Building, updating and publishing a code index.

An index is a folder of versions. A version's tables are written to a folder of their
own and become the index by one rename of a manifest, so that readers see all of the
old version or all of the new one and a failed build leaves the old one intact.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import edge_module_key, is_test_path
from ..sources.parse import parse_files
from . import intervals
from .manifest import Manifest
from .scale import cut, cut_table


def resolve_calls(calls: DataFrame, units: DataFrame, imports: DataFrame) -> DataFrame:
    """``calls`` with target_kind, target_ref and resolution.

    ``calls``: source_unit_id, path, expr (the called expression), plain (whether that is a
    name or a chain of names), and any other columns; ``units``: unit_id, path, kind, name,
    qualname, start_line; ``imports``: path, bound, whole (the module a name is bound to) and
    symbol (module and name it is imported from), one row per name that a file binds.

    Tried in this order: ``self.m`` in a method is the only method of that name in its
    class; a bare name is a top-level unit of the module, else what it is imported from; in
    a.b.c, a an imported module or an imported name, the top-level unit c of that module,
    else of the module that a.b spells. What isn't found stays a symbol.
    """
    u = units.where(F.col("kind").isin("function", "async_function", "class")).withColumn("module", edge_module_key(F.col("path")))
    parent = F.regexp_extract("qualname", r"^(.*)\.[^.]+$", 1)
    method = F.col("kind") != "class"
    classes = u.where(~method).select("module", F.col("qualname").alias("class")).distinct()
    methods = u.where(method & F.contains("qualname", F.lit("."))).select("module", parent.alias("class"), F.col("name").alias("last"), "unit_id")
    methods = methods.join(classes, ["module", "class"], "left_semi").groupBy("module", "class", "last").agg(F.min("unit_id").alias("own"), F.count("*").alias("n")).where("n = 1").drop("n")
    top = u.where("qualname = name").groupBy("module", "name").agg(F.max(F.struct("path", "start_line", "unit_id"))["unit_id"].alias("target"))
    home = u.select(F.col("unit_id").alias("source_unit_id"), F.when(method & F.contains("qualname", F.lit(".")), parent).alias("class"))

    c = calls.withColumn("module", edge_module_key(F.col("path"))).join(home, "source_unit_id", "left")
    parts = F.split("expr", r"\.")
    bare = F.col("plain") & (F.size(parts) == 1)
    chain = F.col("plain") & (F.size(parts) > 1)
    c = c.withColumn("first", F.when(F.col("plain"), parts[0])).withColumn("last", F.when(F.col("plain"), F.element_at(parts, -1)))
    c = c.withColumn("middle", F.when(chain, F.slice(parts, 2, F.size(parts) - 2)))
    own_name = F.when((F.size(parts) == 2) & (F.col("first") == "self"), F.col("last"))
    c = c.join(methods.withColumnRenamed("last", "own_name"), (own_name == F.col("own_name")) & (c["module"] == methods["module"]) & (c["class"] == methods["class"]), "left").drop(methods["module"]).drop(methods["class"]).drop("own_name")
    c = c.join(imports.withColumnRenamed("bound", "first"), ["path", "first"], "left")
    # The module and name of a top-level unit that the call means, if there is one.
    local = top.select("module", F.col("name").alias("first"), F.col("target").alias("local"))
    c = c.join(local, ["module", "first"], "left")
    from_name, from_module = F.col("symbol").isNotNull(), F.col("whole").isNotNull()
    there = F.when(bare & from_name, F.col("symbol.module"))
    there = there.when(chain & from_module, F.concat_ws(".", F.array("whole"), F.col("middle")))
    there = there.when(chain & from_name, F.concat_ws(".", F.array("symbol.module", "symbol.name"), F.col("middle")))
    there = there.when(chain, F.concat_ws(".", F.array("first"), F.col("middle")))
    wanted = F.when(bare, F.col("symbol.name")).when(chain, F.col("last"))
    c = c.withColumn("to_module", there).withColumn("to_name", wanted)
    far = top.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("target").alias("far"))
    c = c.join(far, ["to_module", "to_name"], "left")
    target = F.coalesce("own", F.when(bare, F.col("local")), "far")
    how = F.when(F.col("own").isNotNull(), "same-class-self").when(bare & F.col("local").isNotNull(), "same-module").when(F.col("far").isNull(), "unresolved")
    how = how.when(bare, "from-import").when(from_module, "module-import").when(from_name, "from-import-module").otherwise("module-path")
    kind = F.when(target.isNotNull(), "unit").otherwise("symbol")
    ref = F.coalesce(target, F.when(F.col("expr") != "", F.col("expr")), F.lit("<unknown>"))
    return c.select(*calls.columns, kind.alias("target_kind"), ref.alias("target_ref"), how.alias("resolution"))


def call_sites(parsed: DataFrame) -> DataFrame:
    """source_unit_id, path, line, expr, plain of the calls of parsed rows: the caller is
    the narrowest unit around the line; calls outside all units are dropped."""
    units = parsed.where("tag = 'unit'").select("unit_id", "path", "start_line", "end_line")
    calls = parsed.where("tag = 'call'").select("path", "line", F.col("text").alias("expr"), (F.col("kind") == "plain").alias("plain"))
    at = intervals.enclosing(calls.select("path", "line"), units, "narrowest").withColumnRenamed("unit_id", "source_unit_id")
    return calls.join(at, ["path", "line"])


def module_imports(parsed: DataFrame) -> DataFrame:
    """(path, bound, whole, symbol) of the top-level imports of parsed rows, see
    ``resolve_calls``; where a file binds a name again the last import counts."""
    rows = parsed.where("tag = 'import' and kind <> 'nested'").select("path", F.col("name").alias("bound"), "kind", "line", F.col("qualname").alias("module"), F.col("text").alias("symbol"))
    whole = F.max(F.when(F.col("kind") == "module", F.struct("line", "module")))["module"]
    symbol = F.max(F.when(F.col("kind") == "symbol", F.struct("line", "module", F.col("symbol").alias("name"))))
    found = rows.groupBy("path", "bound").agg(whole.alias("whole"), symbol.alias("s"))
    return found.select("path", "bound", "whole", F.when(F.col("s").isNotNull(), F.struct("s.module", "s.name")).alias("symbol"))


def resolved_calls(parsed: DataFrame) -> DataFrame:
    """Call edges of parsed rows: source_unit_id, target_kind, target_ref, lines,
    expressions, resolutions."""
    units = parsed.where("tag = 'unit'").select("unit_id", "path", "kind", "name", "qualname", "start_line")
    rows = resolve_calls(call_sites(parsed), units, module_imports(parsed))
    some = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("source_unit_id", "target_kind", "target_ref").agg(some("line").alias("lines"), some("expr").alias("expressions"), some("resolution").alias("resolutions"))


def tested_by(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Resolved calls from test files to other units, inverted: source_unit_id (tested),
    target_ref (test), lines."""
    u = units.select("unit_id", is_test_path(F.col("path")).alias("in_test"))
    test, other = u.where("in_test").select(F.col("unit_id").alias("source_unit_id")), u.where("not in_test").select(F.col("unit_id").alias("target_ref"))
    c = calls.where("target_kind = 'unit'").join(test, "source_unit_id", "left_semi").join(other, "target_ref", "left_semi")
    return c.select(F.col("target_ref").alias("source_unit_id"), F.col("source_unit_id").alias("target_ref"), "lines")


def edges_of(parsed: DataFrame) -> DataFrame:
    """All edges of an index, calls before tests, with relation and provenance."""
    calls = cut(resolved_calls(parsed), "calls")
    tests = tested_by(calls, parsed.where("tag = 'unit'"))
    first = calls.select("source_unit_id", F.lit("CALLS").alias("relation"), "target_kind", "target_ref", F.lit("python-ast").alias("provenance"), "lines", "resolutions")
    second = tests.select("source_unit_id", F.lit("TESTED_BY").alias("relation"), F.lit("unit").alias("target_kind"), "target_ref", F.lit("tests").alias("provenance"), "lines", F.array().cast("array<string>").alias("resolutions"))
    return first.unionByName(second)


class Index:
    """Versions of the tables parsed and edges under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def version(self) -> int:
        return self.manifest.version()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        found = self.manifest.read(self.version() if version is None else version)
        return self.spark.read.parquet(f"{self.path}/{found['folder']}/{table}")

    def units(self) -> DataFrame:
        return self.read("parsed").where("tag in ('unit', 'region')")

    def publish(self, parsed: DataFrame, base: int | None = None) -> int:
        """Validate and write the version after ``base``, the one that ``parsed`` was made
        from; duplicate ids across files abort it, and so does another build's version."""
        base = self.version() if base is None else base
        written = cut_table(parsed, "parsed")
        again = written.df.where("tag in ('unit', 'region')").groupBy("unit_id").agg(F.countDistinct("path").alias("n")).where("n > 1").limit(3).collect()
        if again:
            raise ValueError(f"unit ids in several files: {', '.join(r['unit_id'] for r in again)}")
        folder = f"v{uuid.uuid4().hex[:12]}"
        written.df.write.parquet(f"{self.path}/{folder}/parsed")
        edges_of(written.df).write.partitionBy("provenance").parquet(f"{self.path}/{folder}/edges")
        written.drop()
        return self.manifest.publish({"folder": folder}, base)

    def rebuild(self, files: DataFrame) -> int:
        """All of ``files`` (path, text); files that can't be parsed stay as error rows."""
        base = self.version()
        return self.publish(parse_files(files), base)

    def update(self, files: DataFrame, removed: DataFrame | None = None, tree: DataFrame | None = None) -> int:
        """Replace the rows of ``files`` (path, text) and drop those of ``removed`` (path).

        ``tree`` (path, text) is the tree as it is now. With it, indexed paths that the
        tree lacks are dropped, and a file that owns an id which a replacement claims is
        read again, until no claimed id has another owner: an id may move between files.
        Without it such a claim fails as a duplicate. Edges are made anew from the stored
        rows of all files; only replaced files are parsed again.
        """
        base = self.version()
        old = self.read("parsed", base)
        gone = removed.select("path").distinct() if removed is not None else None
        if tree is not None:
            vanished = old.select("path").distinct().join(tree.select("path"), "path", "left_anti")
            gone = vanished if gone is None else gone.union(vanished).distinct()
        fresh = cut(parse_files(files), "fresh")
        replaced = cut(files.select("path").distinct(), "replaced")
        ids = lambda rows: rows.where("tag in ('unit', 'region')").select("unit_id", "path")
        while tree is not None:
            owners = ids(old).join(ids(fresh).select("unit_id").distinct(), "unit_id", "left_semi").select("path").distinct()
            others = owners.join(replaced, "path", "left_anti").join(gone, "path", "left_anti")
            others = cut(others, "owners")
            if others.isEmpty():
                break
            again = parse_files(tree.join(others, "path", "left_semi").select("path", "text"))
            fresh = cut(fresh.unionByName(again), "fresh")
            replaced = cut(replaced.union(others), "replaced")
        if gone is not None:
            old = old.join(gone, "path", "left_anti")
        # A file without any row left is replaced too.
        old = old.join(replaced, "path", "left_anti")
        return self.publish(old.select(*fresh.columns).unionByName(fresh), base)

    def update_file(self, path: str, tree: DataFrame) -> int:
        """``update`` of one path, which is dropped if ``tree`` lacks it."""
        return self.update(tree.where(F.col("path") == path).select("path", "text"), tree=tree)


def rendered(slices: DataFrame, units: DataFrame, code: DataFrame) -> DataFrame:
    """(root, markdown): each root's slice as one Markdown text: the root's own unit first,
    as target, then members by role, depth and id. Every unit of ``units`` is a root; one
    without members has its target only."""
    targets = units.select(F.col("unit_id").alias("root"), "unit_id", F.lit("target").alias("role"), F.lit(0).alias("depth"))
    parts = slices.select("root", "unit_id", "role", "depth").unionByName(targets)
    m = parts.join(units.select("unit_id", "path", "start_line", "end_line"), "unit_id").join(code, "unit_id", "left")
    part = F.format_string("## %s: %s\n%s:%d-%d\n```python\n%s\n```", "role", "unit_id", "path", "start_line", "end_line", F.coalesce("code", F.lit("")))
    order = F.struct((F.col("role") != "target").alias("rest"), "role", "depth", "unit_id", part.alias("part"))
    g = m.groupBy("root").agg(F.array_sort(F.collect_list(order)).alias("parts"))
    return g.select("root", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("markdown"))
