"""Set similarity over token windows: candidate pairs, needle search, floors.

Pairs meet in blocks (blockpairs), in which no window is a hot key. Where a query's
definition has it, pairs must share windows of at most MAX_DF records; scores use the full sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_hashes, tokens, windows
from . import blockpairs
from .scale import cut, cut_table, salted_join, spread, tidied

MAX_DF, MIN_SHARED, FLOOR, WIDTH, LEAST_TOKENS = 60, 3, 0.27, 5, 20
#: Windows of texts are hashes, of which only runs that recur in other texts get shorter: pages
#: as long as that.
DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(16 << 20), "parquet.enable.dictionary": "false"}


def _hashed(records: DataFrame, key: str, text: str, width: int, least_tokens: int, *more: Column) -> DataFrame:
    tok = spread(records.select(F.col(key).alias("id"), F.col(text).alias("text"), *more)).withColumn("tok", tokens(F.col("text"))).drop("text")
    hashed = tok.withColumn("th", F.when(F.size("tok") >= least_tokens, token_hashes(F.col("tok")))).drop("tok")
    return hashed.withColumn("ws", F.array_distinct(windows(F.col("th"), width))).drop("th")


def window_sets(records: DataFrame, key: str, text: str, width: int = WIDTH, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(id, ws): the distinct windows of each record of enough tokens, written once:
    everything below reads them several times."""
    # Filtered only once it is written: a filter here would be pushed below the tokens and
    # run the tokeniser again for every window.
    return cut(_hashed(records, key, text, width, least_tokens), "windows").where("size(ws) > 0")


def exploded(sets: DataFrame) -> DataFrame:
    """(id, w) of window sets."""
    return sets.select("id", F.explode("ws").alias("w"))


def postings(records: DataFrame, key: str, text: str, width: int = WIDTH, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(id, w): distinct windows of each record; records of too few tokens have none."""
    return exploded(window_sets(records, key, text, width, least_tokens))


def set_sizes(posts: DataFrame) -> DataFrame:
    return posts.groupBy("id").agg(F.count("*").alias("n"))


def coded_sets(records: DataFrame, key: str, text: str, tag: Column | None = None, **options):
    """Written (id, tag, code, ws) of records, as blockpairs takes it; empty sets are in it."""
    more = [] if tag is None else [tag.alias("tag")]
    return blockpairs.coded(_hashed(records, key, text, WIDTH, LEAST_TOKENS, *more), None if tag is None else F.col("tag"), **options)


def pairs_of(records: DataFrame, key: str, text: str, reduce, cap: int | None = None, tag: Column | None = None) -> DataFrame:
    """What ``reduce`` (of blockpairs) keeps of all pairs of records with MIN_SHARED windows in
    common, of windows that at most ``cap`` records hold where given. Scores use the full sets.
    ``tag`` is a column of numbers for blockpairs.Best."""
    table = coded_sets(records, key, text, tag)
    found = blockpairs.block_pairs(table.df.where("size(ws) > 0"), reduce, MIN_SHARED, cap)
    table.drop()
    return found


def all_pairs(records: DataFrame, key: str, text: str) -> DataFrame:
    """(left_id, right_id, shared, score), left_id < right_id: Jaccard of pairs with MIN_SHARED
    windows in common among those of at most MAX_DF records."""
    return pairs_of(records, key, text, blockpairs.Pairs(records.schema[key].dataType), MAX_DF)


def best_of(records: DataFrame, key: str, text: str, cap: int | None = None, tag: Column | None = None) -> DataFrame:
    """(id, score): the best score of each record that has a match, of another tag where given."""
    best = pairs_of(records, key, text, blockpairs.Best(records.schema[key].dataType), cap, tag)
    return best.groupBy("id").agg(F.max("score").alias("score"))


def exact_pairs(records: DataFrame, key: str, text: str, floor: float = FLOOR, min_shared: int = MIN_SHARED, block_rows: int = blockpairs.BLOCK_ROWS, members: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, members) without a bound on how many records share a window.

    Records of equal window sets are one class, named by the least id: members has id, rep,
    class_size. pairs (rep_a, rep_b, shared, score), rep_a < rep_b, are all pairs of classes
    with ``min_shared`` windows in common and a Jaccard similarity of ``floor`` or more. Codes
    of records that aren't the first of their class, 8 bytes each, come to the driver. Without
    ``members`` the tables of classes go before pairs are sought.
    """
    table = coded_sets(records, key, text, **DENSE)
    sets = table.df.where("size(ws) > 0")
    ordered = F.sort_array("ws")
    signed = cut_table(sets.select("id", "code", F.to_json(F.struct(F.size("ws").alias("n"), F.xxhash64(ordered).alias("h"), F.hash(ordered).alias("g"))).alias("sig")), "signed")
    named = cut_table(signed.df.groupBy("sig").agg(F.min(F.struct("id", "code")).alias("first"), F.count("*").alias("class_size")).select("sig", F.col("first.id").alias("rep"), F.col("first.code").alias("code"), "class_size"), "classes")
    with tidied(records.sparkSession):
        again = signed.df.join(named.df.select("code"), "code", "left_anti").select("code").toArrow()["code"].to_numpy()
    of_class = None
    if members:
        of_class = salted_join(signed.df.select("id", "sig"), named.df.select("sig", "rep", "class_size"), "sig", spread=F.xxhash64("id")).select("id", "rep", "class_size")
    else:
        signed.drop()
        named.drop()
    found = blockpairs.block_pairs(sets, blockpairs.Pairs(records.schema[key].dataType, float(floor)), min_shared, skip=again if len(again) else None, block_rows=block_rows, floor=float(floor))
    table.drop()
    return found.withColumnsRenamed({"left_id": "rep_a", "right_id": "rep_b"}), of_class


def needle_scores(needles: DataFrame, posts: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(needle_id, id, shared, score) of every needle against every record, no frequency
    bound. ``needles`` and ``posts`` are postings; only windows of a needle meet."""
    hits = needles.select(F.col("id").alias("needle_id"), "w").join(posts, "w").groupBy("needle_id", "id").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    sized = hits.join(set_sizes(needles).toDF("needle_id", "n_needle"), "needle_id").join(set_sizes(posts), "id")
    return sized.select("needle_id", "id", "shared", (F.col("shared") / (F.col("n_needle") + F.col("n") - F.col("shared"))).alias("score"))


def ranked(scores: DataFrame, k: int = 8, floor: float | None = None) -> DataFrame:
    """The k best records per needle: score descending, then id."""
    some = scores if floor is None else scores.where(F.col("score") >= floor)
    place = F.row_number().over(Window.partitionBy("needle_id").orderBy(F.desc("score"), "id"))
    return some.withColumn("place", place).where(F.col("place") <= k)


def floor_report(scores: DataFrame, k: int = 8, floor: float = FLOOR) -> DataFrame:
    """needle_id, checked, below_floor over the k best: rows cut by k are in neither."""
    return ranked(scores, k).groupBy("needle_id").agg(F.count("*").alias("checked"), F.count_if(F.col("score") < floor).alias("below_floor"))


def best_scores(ids: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, best): the best score of every id of ``ids``, 0.0 where it has no match."""
    best = scores.groupBy("id").agg(F.max("score").alias("best"))
    return ids.join(best, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))


def false_positive_rates(best: DataFrame, floors: int = 61) -> DataFrame:
    """(floor, rate) at floors 0.00, 0.01, ...: the share of null scores at or above."""
    grid = best.select("best", F.explode(F.sequence(F.lit(0), F.lit(floors - 1))).alias("c"))
    return grid.groupBy("c").agg((F.count_if(F.col("best") >= F.col("c") / 100) / F.count("*")).alias("rate")).select((F.col("c") / 100).alias("floor"), "rate")
