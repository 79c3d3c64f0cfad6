"""Bounded traversal of typed edges: adjacency, slices and closures for all roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import cut, hot_parts, salted_join


def unit_edges(references: DataFrame, relation: str) -> DataFrame:
    """(source, target, line): distinct unit-to-unit edges of a relation with their lines."""
    ok = (F.lower(F.trim("target_kind")) == "unit") & (F.col("relation") == relation)
    lines = F.from_json("evidence_json", "lines array<int>")["lines"]
    rows = references.where(ok).select(F.col("source_unit_id").alias("source"), F.trim("target_ref").alias("target"), F.explode_outer(lines).alias("line"))
    return rows.where("source is not null and target is not null and target <> ''").distinct()


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """(node, other): one step ``out``, ``in`` or ``both`` ways."""
    out, back = edges.select(F.col("source").alias("node"), F.col("target").alias("other")), edges.select(F.col("target").alias("node"), F.col("source").alias("other"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def closure(roots: DataFrame, edges: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(root, node, depth): what each root reaches within ``depth`` steps, the root
    itself left out, at its least depth. A frontier per level: a level joins only nodes
    that are new, so cycles end by themselves. Edges of hub nodes are spread over tasks."""
    step = cut(neighbours(edges, direction), "steps")
    hot = hot_parts(step, "node")
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, depth + 1):
        reached = salted_join(step, frontier.select("root", "node"), "node", hot=hot, spread=F.xxhash64("other")).select("root", F.col("other").alias("node")).distinct()
        frontier = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level))
        if level > 2:
            frontier = cut(frontier, "closure")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def slices(roots: DataFrame, calls: DataFrame, tests: DataFrame, known: DataFrame, callees_depth: int = 1, callers_depth: int = 1, limit: int = 40) -> DataFrame:
    """(root, unit_id, role, depth, call_lines, truncated): each root's callees, callers
    and tests.

    Callees are taken first and callers don't repeat them, so that a mutual neighbour
    is a callee only; the root is in neither. Units that aren't ``known`` are walked past
    but don't come out. At most ``limit`` members per root, by role, depth and unit_id;
    a root that has more is truncated and loses its tests.
    """
    down = closure(roots, calls, callees_depth, "out").withColumn("role", F.lit("callee"))
    up = closure(roots, calls, callers_depth, "in").withColumn("role", F.lit("caller"))
    up = up.join(down.select("root", "node"), ["root", "node"], "left_anti")
    members = down.unionByName(up).join(known.select(F.col("unit_id").alias("node")), "node", "left_semi")
    place = F.row_number().over(Window.partitionBy("root").orderBy("role", "depth", "node"))
    ranked = members.withColumn("place", place)
    sizes = members.groupBy("root").agg((F.count("*") > limit).alias("truncated"))
    kept = ranked.where(F.col("place") <= limit).join(sizes, "root").drop("place")
    tested = roots.select(F.col("id").alias("root")).join(tests.select(F.col("source").alias("root"), F.col("target").alias("node")).distinct(), "root")
    full = sizes.where("truncated").select("root")
    tested = tested.join(full, "root", "left_anti").join(known.select(F.col("unit_id").alias("node")), "node", "left_semi")
    tested = tested.select("root", "node", F.lit(1).alias("depth"), F.lit("test").alias("role"), F.lit(False).alias("truncated"))
    sites = calls.groupBy("source", "target").agg(F.array_sort(F.collect_set("line")).alias("call_lines"))
    both = kept.select("root", "node", "depth", "role", "truncated").unionByName(tested)
    out = F.when(F.col("role") == "caller", F.col("node")).otherwise(F.col("root"))
    to = F.when(F.col("role") == "caller", F.col("root")).otherwise(F.col("node"))
    sited = both.withColumn("source", out).withColumn("target", to).join(sites, ["source", "target"], "left")
    return sited.select("root", F.col("node").alias("unit_id"), "role", "depth", "call_lines", "truncated")
