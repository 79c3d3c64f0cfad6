"""Building blocks that keep the other operators whole under skew, loss and size.

* ``cut``: ends a lineage in the shared checkpoint folder, as a written table.
* ``hot_parts`` / ``salted_join``: a join of many rows per key with at most one
  row per key, in which keys that hold a large part of the rows are spread over
  several tasks.
* ``ordered_codes``: order-preserving 64-bit codes for the distinct values of a
  column, without a single-task sort.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hash bucket of keys with more rows than this is spread.
HOT_ROWS = 50_000
#: Keys are counted in so many hash buckets. A bucket is hot if it has more than twice the
#: mean of all, so that under half of the buckets are and the list of them is bounded.
HOT_BUCKETS = 1 << 18
PARTITION_BITS = 33
#: Removes the shuffle files of a query once it ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's
    checkpoint folder. Where neither is set a single machine gets a folder of its own; a
    cluster fails, since executors would write to machines that the others don't see."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return context.getCheckpointDir().rstrip("/")


class Written:
    """A table written by ``cut``; ``drop()`` removes its files, the application's end at
    the latest."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def _place(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def drop(self) -> None:
        fs, place = self._place()
        fs.delete(place, True)


@contextmanager
def tidied(spark: SparkSession):
    """Queries run in here leave no shuffle files behind: what they give is written or here."""
    before = spark.conf.get(_TIDY, None)
    try:
        if before is not None:
            spark.conf.set(_TIDY, "true")
        yield
    finally:
        if before is not None:
            spark.conf.set(_TIDY, before)


def cut_table(df: DataFrame, label: str = "t", **options) -> Written:
    """Run ``df`` once and go on from its written rows, which survive executors. The
    shuffle files of that run aren't needed any more and go with its end. ``options`` are
    the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.options(**{"compression": "snappy"} | options).parquet(path)
    table = Written(spark, path, spark.read.schema(df.schema).parquet(path))
    fs, place = table._place()
    fs.deleteOnExit(place)
    return table


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    return cut_table(df, label).df


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(HOT_BUCKETS)).cast("int")


def hot_parts(df: DataFrame, key: str, rows: int | None = None, counted: str | None = None) -> list[tuple[int, int]]:
    """The hot buckets of ``key``, (bucket, parts): those with more than ``rows`` rows and
    more than twice the mean of all buckets, with the number of parts of that size.

    Counts are combined before the shuffle. Whatever the table holds, under half of the
    HOT_BUCKETS come to the driver, and a key beyond them has under 2 / HOT_BUCKETS of all
    rows. ``counted`` names a column of counts where ``df`` is already grouped.
    """
    rows = HOT_ROWS if rows is None else rows
    n = F.count("*") if counted is None else F.sum(counted)
    counts = df.where(F.col(f"`{key}`").isNotNull()).groupBy(_bucket(key).alias("hot_bucket")).agg(n.alias("n"))
    mean = counts.agg((F.sum("n") * 2.0 / HOT_BUCKETS).alias("m")).scalar()
    least = F.greatest(F.lit(float(rows)), mean)
    found = counts.where(F.col("n") > least).select("hot_bucket", F.ceil(F.col("n") / least).cast("int").alias("hot_parts"))
    with tidied(df.sparkSession):
        return [(r["hot_bucket"], r["hot_parts"]) for r in found.collect()]


def salted_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", rows: int | None = None, spread: Column | None = None, hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """``many`` joined with ``one`` (at most one row per key) on ``key``.

    Rows of a hot bucket of keys go to several tasks by a hash of ``spread`` (all columns
    of ``many`` if none is given), and its rows of ``one`` are repeated for each of them;
    all other keys join plainly. The result equals the plain join's, for any ``how`` that
    keeps or drops rows of ``many`` only. ``hot`` has the hot buckets where the caller
    knows them.
    """
    hot = hot_parts(many, key, rows) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    spark = many.sparkSession
    parts = F.broadcast(spark.createDataFrame(hot, "hot_bucket int, hot_parts int"))  # under HOT_BUCKETS / 2 rows of 8 bytes
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]) if spread is None else spread
    left = many.withColumn("hot_hash", spread).withColumn("hot_bucket", _bucket(key)).join(parts, "hot_bucket", "left")
    left = left.withColumn("hot_salt", F.coalesce(F.pmod("hot_hash", F.col("hot_parts")).cast("int"), F.lit(0))).drop("hot_parts", "hot_hash", "hot_bucket")
    right = one.withColumn("hot_bucket", _bucket(key)).join(parts, "hot_bucket", "left")
    right = right.withColumn("hot_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("hot_parts"), F.lit(1)) - 1))).drop("hot_parts", "hot_bucket")
    return left.join(right, [key, "hot_salt"], how).drop("hot_salt")


def blocks(df: DataFrame, parts: Column, spread: Column) -> DataFrame:
    """``df`` with blk, lo, hi: rows are in blocks by ``spread`` and stand once for every
    pair of blocks that theirs is part of. Joined on (lo, hi) under ``meet`` any two rows of
    a key meet once, and no task holds more than two of its blocks."""
    mine = df.withColumn("blk", F.pmod(spread, parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return mine.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).drop("other")


def meet(a: str = "a", b: str = "b") -> Column:
    same = (F.col(f"{a}.lo") == F.col(f"{b}.lo")) & (F.col(f"{a}.hi") == F.col(f"{b}.hi"))
    return same & ((F.col(f"{a}.blk") != F.col(f"{b}.blk")) | (F.col(f"{a}.lo") == F.col(f"{a}.hi")))


def self_pairs(rows: DataFrame, key: str, near: Column, block_rows: int) -> DataFrame:
    """(x, y), once each: the ids of two rows (key, id, ...; written, since read twice) of one
    key for which ``near``, a condition on a.* and b.* that orders the two, holds. Keys of
    more than ``block_rows`` rows meet in blocks, in tasks of their own."""
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & near
    found = lambda df, more: df.alias("a").join(df.alias("b"), on & more).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    hot = hot_parts(rows, key, block_rows)
    if not hot:
        return found(rows, F.lit(True)).distinct()
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, "hot_bucket int, hot_parts int"))  # see hot_parts
    marked = rows.withColumn("hot_bucket", _bucket(key)).join(parts, "hot_bucket", "left").drop("hot_bucket")
    split = blocks(marked.where("hot_parts is not null"), F.col("hot_parts"), F.xxhash64("id")).drop("hot_parts")
    return found(marked.where("hot_parts is null").drop("hot_parts"), F.lit(True)).unionByName(found(split, meet())).distinct()


def range_parts(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_codes(df: DataFrame, key: str, code: str = "code", partitions: int | None = None) -> DataFrame:
    """``df``, distinct in ``key``, with a bigint ``code`` that ascends with the
    key's byte order. Codes of one range partition follow one another; the
    partition is ``code >> PARTITION_BITS``. Cut the result before using it twice,
    since range bounds are sampled anew in each run."""
    n = partitions or range_parts(df.sparkSession)
    return df.repartitionByRange(n, F.col(key)).sortWithinPartitions(key).withColumn(code, F.monotonically_increasing_id())


def global_places(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, its row's position (from 0) in ``order``, without a sort in
    one task: rows are sorted within range partitions and the partitions' sizes, one
    number each, shift their positions."""
    n = range_parts(df.sparkSession)
    coded = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place_code", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place_code", PARTITION_BITS)
    sizes = coded.groupBy(part.alias("place_part")).count().orderBy("place_part").collect()  # one row per partition
    starts, before = [], 0
    for r in sizes:
        starts.append((r["place_part"], before))
        before += r["count"]
    shift = df.sparkSession.createDataFrame(starts, "place_part bigint, place_start bigint")
    at = F.col("place_code").bitwiseAND((1 << PARTITION_BITS) - 1) + F.col("place_start")
    return coded.withColumn("place_part", part).join(F.broadcast(shift), "place_part").withColumn("place", at).drop("place_part", "place_start", "place_code")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: for steps that
    work long on each row of a few small files. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
