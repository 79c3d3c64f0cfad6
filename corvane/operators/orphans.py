"""References to records that don't exist, found on runs of integer keys.

Keys get order-preserving integer codes: parent keys and referenced keys are
sorted together, in range partitions, and numbered. Codes of parents that follow
one another in the same state make up a run. A reference is matched as-of with
the last run that starts at or before its code; beyond that run's end there is no
parent. Far fewer runs than keys have to be carried along: where references are
sound, the parents between two unknown keys are one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import PARTITION_BITS, cut, cut_table, ordered_codes, range_parts, salted_join

#: Keys that a block, sorted and matched in one task, holds about.
BLOCK_KEYS = 2_000_000


def key_runs(coded: DataFrame) -> DataFrame:
    """The parents of ``coded`` (code, is_parent, removed) in runs:
    block, run_start, run_end, removed.

    A run is a maximal stretch of parent codes without a gap and with one value of
    ``removed``; it ends where its block, the range partition, ends. Islands by the
    difference of code and row number, per block; blocks are sized by the shuffle.
    """
    block = F.shiftright("code", PARTITION_BITS)
    rows = coded.where("is_parent").select("code", block.alias("block"), "removed")
    order = Window.partitionBy("block", "removed").orderBy("code")
    island = rows.withColumn("island", F.col("code") - F.row_number().over(order))
    return island.groupBy("block", "removed", "island").agg(F.min("code").alias("run_start"), F.max("code").alias("run_end")).drop("island")


def match_runs(coded: DataFrame, runs: DataFrame) -> DataFrame:
    """Every referenced code of ``coded`` with the run that precedes it as-of:
    code, key, first_seen, run_removed; run_removed is null where the code lies
    beyond the run's end or no run precedes it."""
    none = F.lit(None)
    refs = coded.where("is_referenced").select(
        F.shiftright("code", PARTITION_BITS).alias("block"), "code", F.lit(1).alias("side"), "key", "first_seen", none.cast("bigint").alias("run_end"), none.cast("boolean").alias("removed")
    )
    starts = runs.select(
        "block", F.col("run_start").alias("code"), F.lit(0).alias("side"), none.cast("string").alias("key"), none.cast("timestamp_ntz").alias("first_seen"), "run_end", "removed"
    )
    asof = Window.partitionBy("block").orderBy("code", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(F.when(F.col("side") == 0, F.struct("run_end", "removed")), ignorenulls=True).over(asof)
    got = refs.unionByName(starts).withColumn("run", run).where("side = 1")
    return got.select("code", "key", "first_seen", F.when(F.col("code") <= F.col("run.run_end"), F.col("run.removed")).alias("run_removed"))


def find_orphans(references: DataFrame, units: DataFrame) -> DataFrame:
    """``references`` (key, recorded_at, other columns) whose key no live unit has, or none
    had yet when they were recorded, with orphan_kind and period.

    ``units`` is the history with unit_id, run_id, indexed_at, ingested_at, removed. Kinds:
    ``missing``, else ``removed``, else ``late`` (first indexed after it was recorded). A
    null recorded_at has a null period and can't be late; a parent without any indexed_at
    isn't late either. References have to have a key.
    """
    parents = units.where("unit_id is not null").groupBy(F.col("unit_id").alias("key")).agg(
        F.max(F.struct("run_id", "ingested_at", F.coalesce("removed", F.lit(False)).alias("removed")))["removed"].alias("removed"), F.min(F.col("indexed_at").cast("timestamp_ntz")).alias("first_seen")
    )
    used = references.select("key").distinct()
    domain = parents.select("key", "removed", "first_seen", F.lit(True).alias("is_parent"), F.lit(False).alias("is_referenced")).unionByName(
        used.select("key", F.lit(None).cast("boolean").alias("removed"), F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(False).alias("is_parent"), F.lit(True).alias("is_referenced"))
    )
    keyed = domain.groupBy("key").agg(F.max("removed").alias("removed"), F.max("first_seen").alias("first_seen"), F.max("is_parent").alias("is_parent"), F.max("is_referenced").alias("is_referenced"))
    keys = cut_table(keyed, "orphan-keys")
    blocks = max(range_parts(units.sparkSession), -(-keys.df.count() // BLOCK_KEYS))
    coded = cut(ordered_codes(keys.df, "key", partitions=blocks), "orphans")
    keys.drop()
    state = match_runs(coded, key_runs(coded)).select("key", "run_removed", "first_seen")
    joined = salted_join(references, state, "key")
    kind = F.when(F.col("run_removed").isNull(), "missing").when(F.col("run_removed"), "removed").when(F.col("first_seen") > F.col("recorded_at"), "late")
    found = joined.withColumn("orphan_kind", kind).where("orphan_kind is not null")
    return found.withColumn("period", F.date_format("recorded_at", "yyyy-MM")).drop("run_removed", "first_seen")


def _key(column: str):
    """A key without surrounding white space of any kind."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def unit_references(references: DataFrame) -> DataFrame:
    """(rel_id, key, recorded_at) of the references to units in ``references`` (rel_id,
    target_kind, target_ref, recorded_at). target_kind is compared without surrounding white
    space and letter case. A null or blank target_ref is no reference and a null rel_id no
    record."""
    rows = references.where("rel_id is not null").select("rel_id", F.lower(_key("target_kind")).alias("kind"), _key("target_ref").alias("key"), F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))
    return rows.where("kind = 'unit' and key is not null and key <> ''").drop("kind")


def orphan_references(references: DataFrame, units: DataFrame) -> DataFrame:
    """rel_id, target_ref, orphan_kind, period, once per rel_id, of ``unit_references``; see
    ``find_orphans``. Of one rel_id delivered with different contents the smallest row counts."""
    found = find_orphans(unit_references(references), units)
    one = found.select("rel_id", F.struct("key", "orphan_kind", "period").alias("hit")).groupBy("rel_id").agg(F.min("hit").alias("hit"))
    return one.select("rel_id", F.col("hit.key").alias("target_ref"), "hit.orphan_kind", "hit.period")


def orphan_report(references: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """record_table, orphan_kind, period, n_references, n_targets: orphans of the references
    to units in hard_relationships (``references``, once per rel_id and content) and of both
    ends of soft_relationships (``links``: source_unit_id, relation, target_unit_id,
    provenance, recorded_at; repeated rows count once)."""
    hard = unit_references(references).select(F.lit("hard_relationships").alias("record_table"), F.col("rel_id").cast("string").alias("record"), "key", "recorded_at")
    once = links.select("source_unit_id", "relation", "target_unit_id", "provenance", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at")).distinct()
    record = F.concat_ws("\u0000", "source_unit_id", "relation", "target_unit_id", "provenance")
    ends = once.select(record.alias("record"), "recorded_at", F.explode(F.array(_key("source_unit_id"), _key("target_unit_id"))).alias("key")).where("key <> ''")
    soft = ends.select(F.lit("soft_relationships").alias("record_table"), "record", "key", "recorded_at")
    found = find_orphans(hard.distinct().unionByName(soft), units)
    return found.groupBy("record_table", "orphan_kind", "period").agg(F.count("*").alias("n_references"), F.countDistinct("key").alias("n_targets"))
