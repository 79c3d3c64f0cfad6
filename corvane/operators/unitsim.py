"""Units of code compared as sets of token windows: indexed units, drafts and changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..functions import code as C
from . import blockpairs, setsim
from .scale import cut, spread

FUNCTIONS = ("function", "async_function", "method")


def _declared(batches):
    kinds = {"path": pa.string(), "name": pa.string(), "line": pa.int32(), "of_def": pa.bool_(), "n_tokens": pa.int32(), "ws": pa.list_(pa.int64())}
    for b in batches:
        rows = []
        for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist()):
            try:
                found = C.declarations(text)
            except (SyntaxError, ValueError, RecursionError):
                continue
            sets: dict[int, tuple] = {}
            for line, of_def, node in found:
                if id(node) not in sets:
                    try:
                        tokens = C.code_tokens(C.normal_code(node))
                    except (SyntaxError, ValueError, RecursionError):
                        tokens = []
                    sets[id(node)] = (len(tokens), C.window_set(tokens) if len(tokens) >= C.LEAST_TOKENS else [])
                rows.append((path, node.name, line, of_def, *sets[id(node)]))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))


def declared_windows(files: DataFrame) -> DataFrame:
    """path, name, line, of_def, n_tokens, ws of every function of ``files`` (path, text),
    for the line of its def and for those of its decorators; ws is empty if it is too small.
    Files that can't be parsed and null texts have no rows."""
    some = spread(files.where("path is not null and text is not null").select("path", "text"))
    return some.mapInArrow(_declared, "path string, name string, line int, of_def boolean, n_tokens int, ws array<bigint>")


def comparable(units: DataFrame) -> DataFrame:
    return units.where(F.col("kind").isin(*FUNCTIONS) & (F.col("end_line") - F.col("start_line") + 1 >= C.LEAST_LINES))


def unit_windows(units: DataFrame, files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """unit_id, path, start_line, name, body_hash, n_tokens, ws of the comparable ``units``
    (functions of LEAST_LINES lines or more) whose first line starts a function of ``files``
    (path, text); ws is empty below LEAST_TOKENS tokens.

    ``cache`` (body_hash, ws) holds sets of earlier runs: units with such a body aren't
    parsed again and have a null n_tokens. A line that several functions share means the
    one that is defined there.
    """
    wanted = comparable(units).select("unit_id", "path", "start_line", "name", "body_hash")
    known = None
    if cache is not None:
        sets = cache.where("body_hash is not null and ws is not null").groupBy("body_hash").agg(F.max("ws").alias("ws"))
        known = wanted.join(sets, "body_hash").select(*wanted.columns, F.lit(None).cast("int").alias("n_tokens"), "ws")
        wanted = wanted.join(sets.select("body_hash"), "body_hash", "left_anti").select(*wanted.columns)
        files = files.join(wanted.select("path").distinct(), "path", "left_semi")
    at = declared_windows(files).groupBy("path", F.col("line").alias("start_line")).agg(F.max_by(F.struct("n_tokens", "ws"), "of_def").alias("d"))
    fresh = wanted.join(at, ["path", "start_line"]).select(*wanted.columns, "d.n_tokens", "d.ws")
    return fresh if known is None else fresh.unionByName(known)


_SET = StructType([StructField("body_hash", StringType()), StructField("ws", ArrayType(LongType()))])


def read_cache(rows: DataFrame) -> DataFrame:
    """(body_hash, ws) of cached payloads (body_hash, payload); what can't be read is a miss."""

    def run(batches):
        for b in batches:
            sets = [C.decode_set(p) for p in b["payload"].to_pylist()]
            kept = [k for k, s in enumerate(sets) if s is not None]
            yield pa.RecordBatch.from_arrays([b["body_hash"].take(pa.array(kept, pa.int64())), pa.array([sets[k] for k in kept], pa.list_(pa.int64()))], ["body_hash", "ws"])

    return rows.where("body_hash is not null and payload is not null").select("body_hash", "payload").mapInArrow(run, _SET)


def write_cache(sets: DataFrame) -> DataFrame:
    """(body_hash, payload) of window sets (body_hash, ws), once per hash."""
    encode = F.udf(C.encode_set, BinaryType(), useArrow=True)
    return sets.groupBy("body_hash").agg(F.max("ws").alias("ws")).select("body_hash", encode("ws").alias("payload"))


def posts(sets: DataFrame, key: str = "unit_id") -> DataFrame:
    return sets.select(F.col(key).alias("id"), F.explode("ws").alias("w"))


def similar_units(needles: DataFrame, sets: DataFrame, k: int | None = 8, floor: float = setsim.FLOOR) -> DataFrame:
    """needle_id, unit_id, place, shared, score: per needle (needle_id, self_id, ws) the units
    of ``sets`` at ``floor`` or above but for self_id, score descending, then path and line;
    the ``k`` best, or all."""
    left, right = (blockpairs.coded(x) for x in (needles.select(F.col("needle_id").alias("id"), "ws"), sets.select(F.col("unit_id").alias("id"), "ws")))
    kind = needles.schema["needle_id"].dataType
    some = F.size("ws") > 0
    hits = blockpairs.block_pairs(left.df.where(some), blockpairs.Pairs(kind, floor, needles=True), setsim.MIN_SHARED, others=right.df.where(some))
    hits = hits.withColumnsRenamed({"left_id": "needle_id", "right_id": "unit_id"})
    left.drop()
    right.drop()
    other = hits.join(needles.select("needle_id", "self_id"), "needle_id").where(~F.col("unit_id").eqNullSafe(F.col("self_id")))
    placed = other.join(sets.select("unit_id", "path", "start_line"), "unit_id")
    place = F.row_number().over(Window.partitionBy("needle_id").orderBy(F.desc("score"), "path", "start_line", "unit_id"))
    found = placed.withColumn("place", place).select("needle_id", "unit_id", "place", "shared", "score")
    return found if k is None else found.where(F.col("place") <= k)


def check_changes(changed: DataFrame, base: DataFrame, sets: DataFrame, limit: int = 3, floor: float = setsim.FLOOR) -> DataFrame:
    """unit_id, match_id, shared, score: overlaps that changed functions brought.

    ``changed`` and ``sets``: unit_windows of the changed files and of the whole index;
    ``base`` (path, name, ws): the functions of those files as they were, of several of a
    name the last. Each function's ``limit`` best matches count but for those that its
    former version had at ``floor`` too, however many; a function without one has brought
    all of them.
    """
    changed, base = cut(changed.where("size(ws) > 0"), "changed"), cut(base.where("size(ws) > 0"), "base")
    now = similar_units(changed.select(F.col("unit_id").alias("needle_id"), F.col("unit_id").alias("self_id"), "ws"), sets, limit, floor)
    old = changed.select("unit_id", "path", "name").join(base, ["path", "name"]).select(F.col("unit_id").alias("needle_id"), F.col("unit_id").alias("self_id"), "ws")
    then = similar_units(old, sets, None, floor).select("needle_id", "unit_id")
    return now.join(then, ["needle_id", "unit_id"], "left_anti").select(F.col("needle_id").alias("unit_id"), F.col("unit_id").alias("match_id"), "shared", "score")


def base_functions(files: DataFrame) -> DataFrame:
    """(path, name, line, ws) of the functions of ``files`` by bare name, the last of each."""
    rows = declared_windows(files).where("of_def")
    return rows.groupBy("path", "name").agg(F.max("line").alias("line"), F.max_by("ws", "line").alias("ws"))
