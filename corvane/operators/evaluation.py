"""Retrieval metrics, pair scores, samples and tests over rankings and labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scale import cut, global_places


def ranking(scored: DataFrame, case: str = "q", item: str = "item", score: str = "score") -> DataFrame:
    """Place of every item of its case: score descending, then item."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy(F.desc(score), item)))


def case_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 8) -> DataFrame:
    """Per case with relevant items: hits at 1, 3, 5 and k, recall at k, reciprocal rank.

    ``ranked``: q, item, place; ``relevant``: q, item. A case without any hit has 0s."""
    hit = relevant.distinct().join(ranked.where(F.col("place") <= k), ["q", "item"], "left")
    at = [F.max(F.when(F.col("place") <= n, 1).otherwise(0)).alias(f"hit_{n}") for n in (1, 3, 5)]
    per = hit.groupBy("q").agg(*at, F.count("place").alias("found"), F.count("*").alias("n_relevant"), F.min("place").alias("first"))
    return per.select(
        "q", "hit_1", "hit_3", "hit_5", F.when(F.col("found") > 0, 1).otherwise(0).alias("hit_k"), (F.col("found") / F.col("n_relevant")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank")
    )


def fused_ranks(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: (q, item, fused) of ``rankings`` (arm, q, item, place)."""
    return rankings.groupBy("q", "item").agg(F.sum(1.0 / (k + F.col("place"))).alias("fused"))


def pair_scores(returned: DataFrame, labels: DataFrame) -> DataFrame:
    """Per arm: returned, labelled and positive pairs and the three precisions; unlabelled
    pairs count as wrong in the pessimistic and as right in the optimistic one.

    ``returned``: arm, pair; ``labels``: pair, positive. Precision is null without labels."""
    j = returned.join(labels, "pair", "left")
    g = j.groupBy("arm").agg(F.count("*").alias("returned"), F.count("positive").alias("labelled"), F.count_if("positive").alias("positives"))
    pool = labels.agg(F.count_if("positive").alias("pool_positives"))
    g = g.join(F.broadcast(pool))
    unlabelled = F.col("returned") - F.col("labelled")
    recall = F.try_divide("positives", "pool_positives")
    precision = F.try_divide("positives", "labelled")
    return g.select(
        "arm", "returned", "labelled", "positives", precision.alias("precision"), (F.col("positives") / F.col("returned")).alias("pessimistic"),
        ((F.col("positives") + unlabelled) / F.col("returned")).alias("optimistic"), recall.alias("recall_in_pool"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
    )


def spread_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``n`` rows evenly spaced in ``order``, ends included; places are rounded half to
    even. Fewer rows than n come back whole."""
    placed = cut(global_places(rows, order), "spread")
    last = placed.agg(F.max("place").alias("last"))
    wanted = rows.sparkSession.range(n).join(last).select(F.bround(F.col("id") * F.col("last") / F.lit(max(1, n - 1))).cast("bigint").alias("place")).distinct()
    return placed.join(F.broadcast(wanted), "place", "left_semi")


def _resampled(diffs: DataFrame, draws: int, weights: str) -> DataFrame:
    """(arm, draw, total): weighted sums of the differences, per draw. A pair's weights
    come from a generator seeded with the pair itself, so that sums can be made anywhere,
    in part: no task holds an arm."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for arm, seed, diff in zip(pdf["arm"], pdf["seed"], pdf["diff"]):
                rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
                w = rng.integers(0, 2, draws) * 2.0 - 1.0 if weights == "signs" else rng.poisson(1.0, draws)
                sums[arm] = sums.get(arm, 0.0) + diff * w
        for arm, total in sums.items():
            yield pd.DataFrame({"arm": arm, "draw": np.arange(draws), "total": total})

    parts = diffs.select("arm", F.xxhash64("arm", "pair").alias("seed"), "diff").mapInPandas(run, "arm string, draw int, total double")
    return parts.groupBy("arm", "draw").agg(F.sum("total").alias("total"))


def sign_flip(diffs: DataFrame, draws: int = 20_000) -> DataFrame:
    """(arm, n, p): one-sided sign-flip permutation test of paired differences (arm, pair,
    diff) with add-one; 1 where their sum isn't above 0."""
    seen = diffs.groupBy("arm").agg(F.count("*").alias("n"), F.sum("diff").alias("seen"))  # one row per arm
    j = _resampled(diffs, draws, "signs").join(seen, "arm")
    p = (F.count_if(F.col("total") >= F.col("seen") - 1e-9) + 1) / (F.count("*") + 1)
    return j.groupBy("arm", "n").agg(F.when(F.max("seen") <= 0, 1.0).otherwise(p).alias("p"))


def bootstrap_lower(diffs: DataFrame, draws: int = 5_000) -> DataFrame:
    """(arm, n, lower): fifth percentile of the Poisson-bootstrapped mean difference."""
    n = diffs.groupBy("arm").agg(F.count("*").alias("n"))
    j = _resampled(diffs, draws, "poisson").join(n, "arm")
    return j.groupBy("arm", "n").agg(F.percentile(F.col("total") / F.col("n"), F.lit(0.05)).alias("lower"))


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of ``k`` discordant pairs one way of ``n``, at even odds (k the lesser)."""
    def tail(k: int, n: int) -> float:
        at = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, at)))

    return pd.Series([tail(int(a), int(b)) for a, b in zip(k, n)], dtype=float)


def power(n: int, tie_rate: float, p_up: float, trials: int = 400, draws: int = 20_000, seed: int = 7) -> float:
    """Share of ``trials`` simulated experiments of ``n`` pairs whose one-sided sign-flip test
    is below 0.05. A pair ties, or differs by 0.1 to 0.5 in favour of one side, by ``p_up``.
    All trials use the same ``draws`` flips."""
    rng = np.random.default_rng([seed, n, int(100 * tie_rate), int(100 * p_up)])
    size = rng.uniform(0.1, 0.5, (n, trials)) * np.where(rng.random((n, trials)) < p_up, 1.0, -1.0)
    diffs = np.where(rng.random((n, trials)) < tie_rate, 0.0, size)
    seen, hits = diffs.sum(axis=0), np.zeros(trials)
    for k in range(0, draws, 2_000):
        signs = rng.integers(0, 2, (min(2_000, draws - k), n)) * 2.0 - 1.0
        hits += (signs @ diffs >= seen - 1e-9).sum(axis=0)
    p = np.where(seen <= 0, 1.0, (hits + 1) / (draws + 1))
    return float((p < 0.05).mean())
