"""Evaluation data from JSON files, validated: rows that break a rule are counted, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASES = "item_id bigint, suite string, target string, question string, answer string"
LABELS = "corpus string, left string, right string, label string"


def read_json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """Rows of JSON lines, or of files that hold one array each (``whole``). A record that
    isn't of the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(whole).lower()).json(path)


def split_by(rows: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(kept, left out): rows whose ``reason`` is null, and (reason, n) of the others."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def load_cases(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cases with an id of their own and a question; (reason, n) of the others."""
    rows = read_json(spark, path, CASES, whole)
    again = F.count("*").over(Window.partitionBy("item_id")) > 1
    why = F.when(F.col("item_id").isNull(), "no id").when(F.trim(F.coalesce("question", F.lit(""))) == "", "no question").when(again, "repeated id")
    return split_by(rows, why)


def load_labels(spark: SparkSession, path: str, known: list[str], whole: bool = False) -> DataFrame:
    """(corpus, left, right, label) once per pair, left < right. A label beyond ``known``, a
    pair labelled in two ways and a missing end raise."""
    rows = read_json(spark, path, LABELS, whole).select("corpus", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "label").distinct()
    wrong = rows.where(~F.col("label").isin(known) | F.col("label").isNull() | F.col("left").isNull() | F.col("right").isNull()).limit(3).collect()
    twice = rows.groupBy("corpus", "left", "right").count().where("count > 1").limit(3).collect()
    if wrong or twice:
        raise ValueError(f"labels that can't be used: {[tuple(r) for r in [*wrong, *twice]]}")
    return rows


def load_units(units: DataFrame, least_lines: int = 5) -> tuple[DataFrame, DataFrame]:
    """Comparable units, and (reason, n) of those left out."""
    n = F.col("end_line") - F.col("start_line") + 1
    return split_by(units, F.when(F.col("unit_id").isNull(), "no id").when(F.col("kind") == "class", "class").when(n < least_lines, "short"))
