"""Index maintenance as DataFrame transformations: replace, validate, invalidate, refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` holds, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def conflicts(new_units: DataFrame, kept_units: DataFrame) -> DataFrame:
    """(unit_id, problem): ids that occur twice in one file, in several files, or in a
    file that isn't replaced."""
    twice = new_units.groupBy("unit_id", "path").count().where("count > 1").select("unit_id", F.lit("repeated in a file").alias("problem"))
    across = new_units.groupBy("unit_id").agg(F.countDistinct("path").alias("n")).where("n > 1").select("unit_id", F.lit("in several files").alias("problem"))
    owned = new_units.select("unit_id").distinct().join(kept_units.select("unit_id").distinct(), "unit_id", "left_semi").select("unit_id", F.lit("owned by another file").alias("problem"))
    return twice.unionByName(across).unionByName(owned)


def surviving_edges(edges: DataFrame, released: DataFrame, removed: DataFrame) -> DataFrame:
    """Typed edges left after units were released for replacement: none that starts at a
    released unit, none that ends at a removed one."""
    out = edges.join(released.select(F.col("unit_id").alias("source_unit_id")).distinct(), "source_unit_id", "left_anti")
    return out.join(removed.select(F.col("unit_id").alias("target_ref")).distinct(), "target_ref", "left_anti")


def surviving_scores(scored: DataFrame, released: DataFrame) -> DataFrame:
    """Scored edges left: none that touches a released unit at either end."""
    gone = released.select("unit_id").distinct()
    out = scored.join(gone.withColumnRenamed("unit_id", "source_unit_id"), "source_unit_id", "left_anti")
    return out.join(gone.withColumnRenamed("unit_id", "target_unit_id"), "target_unit_id", "left_anti")


def stamped(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges with target_hash taken anew from the units; '' for targets that are none."""
    hashes = units.select(F.col("unit_id").alias("target_ref"), F.col("body_hash").alias("new_hash"))
    return edges.join(hashes, "target_ref", "left").withColumn("target_hash", F.coalesce("new_hash", F.lit(""))).drop("new_hash")


def invalid_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(rel_id, problem): edges of an unknown source, or with an empty target, or a unit
    target that isn't indexed."""
    known = units.select("unit_id").distinct()
    source = edges.join(known.withColumnRenamed("unit_id", "source_unit_id"), "source_unit_id", "left_anti").select("rel_id", F.lit("unknown source").alias("problem"))
    empty = edges.where("coalesce(target_ref, '') = ''").select("rel_id", F.lit("empty target").alias("problem"))
    target = edges.where("target_kind = 'unit' and target_ref <> ''").join(known.withColumnRenamed("unit_id", "target_ref"), "target_ref", "left_anti").select("rel_id", F.lit("unknown target").alias("problem"))
    return source.unionByName(empty).unionByName(target)
