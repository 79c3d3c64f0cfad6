"""Near-duplicate records among sets of hashed windows.

Sets are points of a segment-popcount embedding: the hash space is cut into
segments and a set becomes the vector of its counts per segment. The Manhattan
distance of two such vectors never exceeds the size of the sets' symmetric
difference, and sets of Jaccard similarity t or more differ by at most
(1 - t) / (1 + t) of their sizes' sum: a search under that bound loses nothing.

A grid over the vectors can't find the candidates at a similarity of 0.5 (figures in
the README), so another method does: a prefix join on single windows, rare ones first,
with size and position bounds. The vectors' Manhattan distance then cuts the candidates
before any set is fetched, and the sets themselves decide.

Equal sets are joined once, as a class. Pairs of classes, the classes' members and the
groups that pairs form are the result; ``similar_pairs`` expands them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import Written, blocks, cut_table, meet, salted_join, self_pairs
from .bitmaps import bitmap_of, kept, known
from .components import connected_components

SEGMENTS = 256
#: Windows of more sets than this are told apart by count: so many of the most common ones
#: exactly, 16 bytes each, all others by the sum of their counts in hash buckets, 4 bytes each.
LEAST_COMMON, MAX_COMMON, COUNT_BUCKETS = 8, 500_000, 1 << 22
#: Windows are counted by their upper 40 bits, of 64, since what is counted is shuffled. Windows
#: that agree in these count together: any order of windows serves, and none is missed.
COUNTED_SHIFT = 24
#: Rows of one window, or copies of one set, that meet one another in a task.
PAIR_ROWS = 4_000


def read_set(payload: bytes | None) -> np.ndarray | None:
    """The distinct windows of a payload in ascending order; None if it is null or
    can't be read whole (no zlib stream, cut short, not a multiple of 8 bytes)."""
    if payload is None:
        return None
    try:
        stream = zlib.decompressobj()
        raw = stream.decompress(payload) + stream.flush()
    except zlib.error:
        return None
    if not stream.eof or len(raw) % 8:
        return None
    got = np.frombuffer(raw, "<i8")
    return got if len(got) < 2 or (got[1:] > got[:-1]).all() else np.unique(got)


def write_set(windows) -> bytes:
    return zlib.compress(np.unique(np.asarray(windows, "<i8")).tobytes(), 1)


def signature(windows: np.ndarray) -> str:
    return hashlib.blake2b(windows.tobytes(), digest_size=16).hexdigest()


def popcounts(windows: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Counts per segment of the 64-bit hash space; ``segments`` is a power of two."""
    return np.bincount((windows.astype(np.uint64) >> np.uint64(64 - int(segments).bit_length() + 1)).astype(np.int64), minlength=segments)


def embed(windows: np.ndarray) -> bytes:
    """The counts as half bytes. Counts above 15 are cut, which can only bring two
    vectors nearer to one another: the distance stays a lower bound."""
    c = np.minimum(popcounts(windows), 15).astype(np.uint8)
    return (c[::2] << 4 | c[1::2]).tobytes()


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of embedded vectors, row by row."""
    halves = [np.abs((x(a)).astype(np.int16) - x(b)).sum(axis=1) for x in (lambda v: v >> 4, lambda v: v & 15)]
    return halves[0] + halves[1]


def bound(total, t: float):
    """The greatest symmetric difference at similarity t of two sets whose sizes sum to ``total``."""
    return total - 2 * np.ceil(t / (1 + t) * total - 1e-9)


def _catalogue(batches):
    for b in batches:
        sets = [read_set(p) for p in b["payload"].to_pylist()]
        kept = [k for k, s in enumerate(sets) if s is not None and len(s)]
        out = b.select(["body_hash", "mark"]).take(pa.array(kept, pa.int64()))
        sizes, sigs = pa.array([len(sets[k]) for k in kept], pa.int32()), pa.array([signature(sets[k]) for k in kept], pa.string())
        yield pa.RecordBatch.from_arrays([out["body_hash"], sizes, sigs, out["mark"]], ["body_hash", "n", "sig", "mark"])


def _decoded(batches):
    for b in batches:
        sets = [read_set(p) for p in b["payload"].to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        windows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]), pa.int64()))
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.diff(ends).astype(np.int32)), pa.array([embed(s) for s in sets], pa.binary()), windows], ["id", "n", "vec", "ws"])


def _prefixes(order, t: float):
    """order: what ``window_order`` gives."""

    def run(batches):
        values, counts, buckets, repeated = order.value
        for b in batches:
            if not b.num_rows:
                continue
            size = b["n"].to_numpy().astype(np.int64)
            w, of = b["ws"].flatten().to_numpy(), np.repeat(np.arange(b.num_rows), size)
            part = w >> COUNTED_SHIFT
            place = buckets[part & (len(buckets) - 1)].astype(np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, part), len(values) - 1)
                place = np.where(values[at] == part, counts[at], place)
            by = np.lexsort((w, place, of))
            position = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
            n = size[of]
            keep = np.flatnonzero(position < n - np.ceil(t * n - 1e-9) + 1)
            keep = keep[known(repeated, part[by[keep]])]  # a window of one set joins nothing
            arrays = [w[by[keep]], b["id"].to_numpy()[of[keep]], (n[keep] << 32) + position[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["w", "id", "at"])

    return run


def _near(t: float):
    """Pairs whose vectors are within the bound."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("vec_a", "vec_b"))
            most = bound(b["n_a"].to_numpy().astype(np.int64) + b["n_b"].to_numpy(), t)
            yield b.filter(pa.array(manhattan(u, v) <= most)).select(["x", "y"])

    return run


def window_order(sets: DataFrame):
    """(values, counts, buckets, repeated) for ``_prefixes``, bounded whatever the sets hold:
    the most common windows and their counts, counts of the others in buckets, and a bitmap
    of the windows of more than one set."""
    counts = cut_table(sets.select(F.explode("ws").alias("w")).groupBy(F.shiftright("w", COUNTED_SHIFT).alias("w")).count().where("count > 1"), "nd-common")
    often = counts.df.where(F.col("count") > LEAST_COMMON)
    by_count = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct count
    sizes = often.groupBy("count").agg(F.count("*").alias("n")).withColumn("so_far", F.sum("n").over(by_count))
    least = sizes.where(F.col("so_far") <= MAX_COMMON).agg(F.min("count")).first()[0]
    is_common = F.lit(False) if least is None else F.col("count") >= least
    found = often.where(is_common).toArrow()
    rest = often.where(~is_common).groupBy(F.col("w").bitwiseAND(F.lit(COUNT_BUCKETS - 1)).alias("k")).agg(F.sum("count").alias("c")).toArrow()
    repeated = bitmap_of(counts.df, "w")
    counts.drop()
    buckets = np.zeros(COUNT_BUCKETS if rest.num_rows else 1, np.int32)
    buckets[rest["k"].to_numpy().astype(np.int64)] = np.minimum(rest["c"].to_numpy().astype(np.int64), 2**31 - 1)
    value, count = (found[c].to_numpy().astype(np.int64) for c in ("w", "count"))
    order = np.argsort(value)
    return value[order], count[order], buckets, repeated


def candidates(sets: DataFrame, t: float) -> Written:
    """(x, y), once each, of the classes (id, n, ws) that share a window among the first of
    each in the common order and whose sizes and positions allow a similarity of t."""
    order = sets.sparkSession.sparkContext.broadcast(window_order(sets))
    postings = cut_table(sets.select("id", "n", "ws").mapInArrow(_prefixes(order, t), "w bigint, id bigint, at bigint"), "nd-postings")
    order.destroy()
    # at holds the set's size and the window's place, in one number for the shuffle's sake.
    (na, pa_), (nb, pb) = ((F.shiftright(f"{r}.at", 32), F.col(f"{r}.at").bitwiseAND(F.lit(0xFFFFFFFF))) for r in "ab")
    least = F.lit(t / (1 + t)) * (na + nb) - 1e-9  # windows that two such sets must share
    near = ((na < nb) | ((na == nb) & (F.col("a.id") < F.col("b.id")))) & (na >= F.lit(t) * nb - 1e-9) & (na - pa_ >= least) & (nb - pb >= least)
    out = cut_table(self_pairs(postings.df, "w", near, PAIR_ROWS), "nd-pairs")
    postings.drop()
    return out


def similar_classes(sets: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (rep_a, rep_b, similarity), rep_a < rep_b, of classes
    of equal sets whose similarity is at least ``threshold``; members (body_hash, rep,
    class_size) of every readable, non-empty set. rep is the least body_hash of its class.

    ``sets``: body_hash, payload. Null hashes, null, unreadable and empty payloads
    don't count. A hash delivered several times counts once; should its readable
    sets differ, the smallest one by size and signature counts.
    """
    t = float(threshold)
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = sets.where("body_hash is not null and payload is not null").select("body_hash", F.md5("payload").alias("mark"), "payload")
    seen = rows.mapInArrow(_catalogue, "body_hash string, n int, sig string, mark string")
    one = cut_table(seen.groupBy("body_hash").agg(F.min(F.struct("n", "sig", "mark")).alias("s")).select("body_hash", "s.n", "s.sig", "s.mark"), "nd-sets").df
    least = F.min(F.struct("body_hash", "mark"))
    grouped = one.groupBy("sig").agg(least.alias("r"), F.count("*").alias("class_size"))
    classes = cut_table(grouped.select("sig", F.col("r.body_hash").alias("rep"), F.col("r.mark").alias("mark"), "class_size").withColumn("id", F.monotonically_increasing_id()), "nd-classes").df
    members = salted_join(one.select("body_hash", "sig"), classes.select("sig", "rep", "class_size"), "sig", spread=F.xxhash64("body_hash")).select("body_hash", "rep", "class_size")

    # The set of each class, decoded once. Repeated deliveries are combined before the shuffle.
    once = rows.groupBy("body_hash", "mark").agg(F.first("payload").alias("payload"))
    named = once.join(classes.select(F.col("rep").alias("body_hash"), "mark", "id").hint("shuffle_merge"), ["body_hash", "mark"]).select("id", "payload")
    full = cut_table(named.mapInArrow(_decoded, "id bigint, n int, vec binary, ws array<bigint>"), "nd-decoded")

    found = candidates(full.df, t)
    points = full.df.select("id", "n", "vec")
    embedded = found.df.join(points.toDF("x", "n_a", "vec_a"), "x").join(points.toDF("y", "n_b", "vec_b"), "y")
    close = cut_table(embedded.mapInArrow(_near(t), "x bigint, y bigint"), "nd-close")
    found.drop()
    # Only sets of pairs that are left are shuffled: a bitmap of their ids lets them through.
    ids = close.df.select(F.explode(F.array("x", "y")).alias("id")).select(F.xxhash64("id").alias("h"))
    bits = sets.sparkSession.sparkContext.broadcast(bitmap_of(ids))
    windows = full.df.select("id", "ws", F.xxhash64("id").alias("h")).mapInArrow(kept(bits, ["id", "ws"]), "id bigint, ws array<bigint>")
    both = close.df.join(windows.toDF("x", "a"), "x").join(windows.toDF("y", "b"), "y")
    shared = F.size(F.array_intersect("a", "b"))
    scored = both.select("x", "y", (shared / (F.size("a") + F.size("b") - shared)).alias("similarity")).where(F.col("similarity") >= t)
    names = classes.select("id", "rep")
    named = scored.join(names.toDF("x", "ra"), "x").join(names.toDF("y", "rb"), "y")
    pairs = cut_table(named.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"), "similarity"), "nd-verified").df
    for table in (full, close):
        table.drop()
    bits.destroy()
    return pairs, members


def similar_groups(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """body_hash, class_id, group_id, n_links of every readable, non-empty set: the class of
    equal sets, the least body_hash linked to it directly or through others, and how many
    other classes are similar. A set without links is a group of its own class."""
    pairs, members = similar_classes(sets, threshold)
    groups = connected_components(pairs, "rep_a", "rep_b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    known = cut_table(groups.join(links, "rep"), "nd-groups").df
    out = salted_join(cut_table(members, "nd-members").df, known, "rep", "left", spread=F.xxhash64("body_hash"))
    return out.select("body_hash", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def similar_pairs(sets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(hash_a, hash_b), hash_a < hash_b: all pairs of distinct hashes whose sets have
    a similarity of at least ``threshold``, equal sets included. Copies of one set meet in
    blocks of PAIR_ROWS."""
    pairs, members = similar_classes(sets, threshold)
    members = cut_table(members, "nd-members").df
    m = members.select("rep", "body_hash")
    across = pairs.join(m.toDF("rep_a", "ha"), "rep_a").join(m.toDF("rep_b", "hb"), "rep_b").select("ha", "hb")
    copies = blocks(members.where("class_size > 1"), F.ceil(F.col("class_size") / PAIR_ROWS).cast("int"), F.xxhash64("body_hash"))
    same = (F.col("a.rep") == F.col("b.rep")) & (F.col("a.body_hash") < F.col("b.body_hash")) & meet()
    inside = copies.alias("a").join(copies.alias("b"), same).select(F.col("a.body_hash").alias("ha"), F.col("b.body_hash").alias("hb"))
    return across.unionByName(inside).select(F.least("ha", "hb").alias("hash_a"), F.greatest("ha", "hb").alias("hash_b"))
