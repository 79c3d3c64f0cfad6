"""Event streams: windows, sessions, deduplication and upserts. All queries run on a
finite trigger here; on a cluster the trigger is the caller's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{table}.parquet*")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote. Every batch goes to
    the shared folder under its number, so that a repeated batch replaces itself; in
    complete mode the last batch is the result."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/corvane/stream-{uuid.uuid4().hex}"
    seen = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        seen.append(number)

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = sorted(set(seen))
    if not batches:
        return spark.createDataFrame([], df.schema)
    wanted = batches[-1:] if mode == "complete" else batches
    return spark.read.schema(df.schema).parquet(*[f"{place}/out/batch={n}" for n in wanted])


def _at(column: str = "ts"):
    return F.col(column).cast("timestamp")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type."""
    rows = events.withColumn("at", _at()).withWatermark("at", late)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return rows.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: a gap of ``gap`` ends one."""
    rows = events.withColumn("at", _at()).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def first_deliveries(rows: DataFrame, keys: list[str], at: str, late: str = "365 days") -> DataFrame:
    """Rows of a stream once per key, among those that arrive within ``late``."""
    return rows.withColumn("at", _at(at)).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)
