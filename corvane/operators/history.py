"""Current states of append-only histories with repeated and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Per key the ``keep`` columns of the row that is greatest in ``order``; rows
    equal in all of ``order`` are told apart by ``keep`` itself, so the answer
    doesn't depend on the order of arrival. Nulls in ``order`` come first.
    Combined before the shuffle: one row per key and task crosses the network."""
    best = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k_{c}") for c in keep]))
    got = df.groupBy(*key).agg(best.alias("best_row"))
    return got.select(*key, *[F.col(f"best_row.k_{c}").alias(c) for c in keep])


def current_units(units: DataFrame) -> DataFrame:
    """unit_id, run_id, removed, body_hash, git_file_commit of each unit's current
    version: that of the greatest run_id. A null ``removed`` counts as false, a null
    hash as ''. Rows without a unit_id are no unit."""
    rows = units.where("unit_id is not null").select(
        "unit_id",
        "run_id",
        "ingested_at",
        F.coalesce("removed", F.lit(False)).alias("removed"),
        F.coalesce("body_hash", F.lit("")).alias("body_hash"),
        "git_file_commit",
    )
    return latest(rows, ["unit_id"], ["run_id", "ingested_at"], ["run_id", "removed", "body_hash", "git_file_commit"])
