"""Scored links between units, cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_links(links: DataFrame, relation: str) -> DataFrame:
    """source_unit_id, target_unit_id, score: one row per directed pair.

    ``links`` needs source_unit_id, relation, target_unit_id, score, provenance and
    recorded_at; other columns aren't looked at. Rows with a null end, or a score
    that is null, NaN or outside 0 to 1 are ignored. Of the rows of one (source,
    relation in any letter case, target, provenance) the latest recorded_at counts,
    a null time before any other and of equal times the greatest score; of the
    provenances the greatest score. Self-references are dropped. Both steps combine
    before they shuffle and cluster by the pair, so that neither a source nor a pair
    delivered very often is too large for a task.
    """
    score = F.col("score")
    rows = links.where(
        (F.lower("relation") == relation.lower()) & F.col("source_unit_id").isNotNull() & F.col("target_unit_id").isNotNull()
        & score.isNotNull() & ~F.isnan(score) & score.between(0.0, 1.0) & (F.col("source_unit_id") != F.col("target_unit_id"))
    ).select("source_unit_id", "target_unit_id", "provenance", "recorded_at", (score + F.lit(0.0)).alias("score"))
    last = rows.groupBy("source_unit_id", "target_unit_id", "provenance").agg(F.max(F.struct("recorded_at", "score"))["score"].alias("score"))
    return last.groupBy("source_unit_id", "target_unit_id").agg(F.max("score").alias("score"))
