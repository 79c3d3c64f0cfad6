"""Processing only new or changed records, with the target as the state.

Every output row stores the key and the version of the source record it came
from. What is left to do is the anti-join of the source's (key, version) pairs
with those of the last published target: nothing else is remembered, so a run
that died half way leaves nothing to repair and nothing is done twice.

A target version is written to a folder of its own and becomes the target by one
claim of the next manifest, on the version that the run read its state from: a run
that another one overtook fails instead of repeating records.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import current_units, latest
from .manifest import Manifest, PublishConflict
from .scale import cut, salted_join

KEY, VERSION = "source_key", "source_version"
_PAIR = "source_pair"


def _paired(df: DataFrame) -> DataFrame:
    return df.withColumn(_PAIR, F.concat_ws("\u0000", KEY, VERSION))


def pending(source: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``source`` (source_key, source_version, ...) whose version isn't the one that
    ``done`` (source_key, source_version; the stored state, one row per key) holds.

    Two disjoint parts: records are anti-joined on key and version; removals, whose version
    is '' (or null), count where the state holds a version other than ''. Rows with a null
    key are no records. Source rows may be many per key: hot keys are spread over tasks.
    """
    left = source.where(F.col(KEY).isNotNull()).withColumn(VERSION, F.coalesce(VERSION, F.lit("")))
    right = done.where(F.col(KEY).isNotNull()).select(KEY, F.coalesce(VERSION, F.lit("")).alias(VERSION)).where(F.col(VERSION) != "")
    changed = salted_join(_paired(left.where(F.col(VERSION) != "")), _paired(right).select(_PAIR), _PAIR, "left_anti").select(*left.columns)
    removed = salted_join(left.where(F.col(VERSION) == ""), right.select(KEY), KEY, "left_semi").select(*left.columns)
    return changed.unionByName(removed)


def processed_states(checkpoints: DataFrame, runs: DataFrame) -> DataFrame:
    """The stored state that attempts left: of each unit the last checkpoint of an
    attempt that ended ok. ``runs`` has one row per attempt; only its keys are
    broadcast, and Spark does so by its own size estimate."""
    ok = runs.where(F.lower(F.trim("status")) == "ok").select("run_id", "attempt").distinct()
    kept = checkpoints.where("unit_id is not null").join(ok, ["run_id", "attempt"], "left_semi")
    last = latest(kept, ["unit_id"], ["run_id", "attempt", "processed_at"], ["body_hash"])
    return last.select(F.col("unit_id").alias(KEY), F.col("body_hash").alias(VERSION))


def unit_states(current: DataFrame) -> DataFrame:
    """(source_key, source_version) of current units: their hash, or '' if they are removed."""
    return current.select(F.col("unit_id").alias(KEY), F.when(F.col("removed"), F.lit("")).otherwise(F.col("body_hash")).alias(VERSION))


def pending_units(units: DataFrame, checkpoints: DataFrame, runs: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """unit_id of every unit whose state (hash of the current version, '' if that is
    removed) isn't the one last processed. Commits aren't compared: a commit that
    leaves the body alone is no change. Empty tables give no rows."""
    current = current_units(units) if current is None else current
    return pending(unit_states(current), cut(processed_states(checkpoints, runs), "processed")).select(F.col(KEY).alias("unit_id"))


def stale_references(references: DataFrame, current: DataFrame) -> DataFrame:
    """rel_id, once each, of the references whose source unit is live and whose
    source_hash (null as '') isn't the unit's hash: the references' stored versions are
    anti-joined with those of the live units, what is left of live units is stale.
    ``references`` may be delivered again and one source may hold many of them; the joins
    spread such a source."""
    rows = references.where("rel_id is not null and source_unit_id is not null").select("rel_id", F.col("source_unit_id").alias(KEY), F.coalesce("source_hash", F.lit("")).alias(VERSION))
    live = current.where(~F.col("removed")).select(F.col("unit_id").alias(KEY), F.col("body_hash").alias(VERSION))
    other = salted_join(_paired(rows), _paired(live).select(_PAIR), _PAIR, "left_anti", spread=F.xxhash64("rel_id"))
    other = cut(other.select("rel_id", KEY).distinct(), "stale")
    return salted_join(other, live.select(KEY), KEY, "left_semi", spread=F.xxhash64("rel_id")).select("rel_id").distinct()


def pending_work(units: DataFrame, checkpoints: DataFrame, runs: DataFrame, references: DataFrame) -> DataFrame:
    """(record_table, record_key) of everything that the next run has to process."""
    current = cut(current_units(units).select("unit_id", "removed", "body_hash"), "current")
    first = pending_units(units, checkpoints, runs, current).select(F.lit("units").alias("record_table"), F.col("unit_id").alias("record_key"))
    second = stale_references(references, current).select(F.lit("hard_relationships").alias("record_table"), F.col("rel_id").cast("string").alias("record_key"))
    return first.unionByName(second)


class Target:
    """A versioned target table under ``path``.

    Manifest n names the folders of rows that make up version n, each row with the
    ``target_version`` that added it, and the folders of its state, (source_key,
    source_version, target_version): a compacted one and at most COMPACT later ones, so
    that a run doesn't read all rows ever published. Folders without a manifest are
    leftovers of runs that died and are never read.
    """

    COMPACT = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def version(self) -> int:
        """The last published version, 0 if there is none."""
        return self.manifest.version()

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, or None before the first."""
        folders = self.manifest.read(self.version() if version is None else version).get("folders")
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def current(self) -> DataFrame | None:
        """The rows of the newest version of each key only."""
        rows = self.read()
        if rows is None:
            return None
        newest = rows.groupBy(KEY).agg(F.max("target_version").alias("target_version"))
        return rows.join(newest, [KEY, "target_version"], "left_semi")

    def state(self, version: int | None = None) -> DataFrame:
        """(source_key, source_version, target_version) last stored for each key."""
        folders = self.manifest.read(self.version() if version is None else version).get("state")
        if not folders:
            return self.spark.createDataFrame([], f"{KEY} string, {VERSION} string, target_version bigint")
        return latest(self.spark.read.parquet(*folders), [KEY], ["target_version"], [VERSION, "target_version"])

    def publish(self, rows: DataFrame, base: int | None = None) -> int:
        """Write ``rows`` (with source_key and source_version) as the version after
        ``base``, the version whose state they were made from (the last one if none is
        given). PublishConflict if another run published on that base."""
        base = self.version() if base is None else base
        version, name, old = base + 1, uuid.uuid4().hex[:12], self.manifest.read(base)
        folder, state = f"{self.path}/v{version}-{name}", f"{self.path}/state{version}-{name}"
        rows.withColumn("target_version", F.lit(version).cast("bigint")).write.parquet(folder)
        delta = self.spark.read.parquet(folder).select(KEY, VERSION, "target_version")
        kept = old.get("state", [])
        if len(kept) > self.COMPACT:
            delta, kept = latest(self.spark.read.parquet(*kept).unionByName(delta), [KEY], ["target_version"], [VERSION, "target_version"]), []
        else:
            delta = delta.distinct()
        delta.write.parquet(state)
        return self.manifest.publish({"folders": [*old.get("folders", []), folder], "state": [*kept, state]}, base)

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame], tries: int = 1) -> int | None:
        """Process what is pending and publish it; None if there was nothing to do.

        ``process`` maps pending source rows to output rows and has to keep
        source_key and source_version, one row or more per record (a removal, version
        '', needs a row too: it is the tombstone that records the removal as done).
        If another run publishes in between, nothing of this one counts; up to ``tries``
        times what is pending then is processed instead.
        """
        for left in range(tries - 1, -1, -1):
            base = self.version()
            todo = pending(source, self.state(base))
            if todo.isEmpty():
                return None
            try:
                return self.publish(process(todo), base)
            except PublishConflict:
                if not left:
                    raise
        return None
