"""Fixed-capacity containers filled by linear grouping.

Token lengths are whole numbers up to the capacity, so the plan is made on the
histogram of lengths, which has at most ``capacity`` rows however large the corpus:

1. Large lengths are put, longest first, into groups of equal cardinality and rounded
   up to their group's longest; a few sizes remain.
2. Configurations of these sizes (how many of each share a container) are optimised by
   column generation: a linear program over configurations, new ones by a knapsack.
3. Actual lengths are substituted for the rounded ones, which only frees space.
4. Small lengths go best-fit, longest first, into the free space, then into new containers.

Containers of the same lengths are one class with a count. Documents get a rank among
those of their length, by a window over hash buckets, and rank ranges map to
containers by a lookup table whose size doesn't depend on the number of documents.
"""

from __future__ import annotations

import base64
import os
import warnings

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import cut_table, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GROUPS = 24
#: Lengths up to capacity / SMALL are small.
SMALL = 8
BUCKET_ROWS = 200_000

#: How the byte-level vocabulary splits text before merging. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a vocabulary file of ranks, loaded once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _pieces(name: str, capacity: int):
    def run(batches):
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            out = [[], [], [], []]
            for d, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                n = len(encode(text)) if text else 0
                for k in range(max(1, -(-n // capacity))):
                    for o, v in zip(out, (d, k, k * capacity, min(capacity, n - k * capacity))):
                        o.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["doc_id", "piece", "token_start", "n_tokens"])

    return run


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in groups of equal cardinality: lists of (length, count)."""
    total = sum(counts.values())
    size = -(-total // groups) if total else 0
    out: list[list[tuple[int, int]]] = []
    free = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not free:
                out.append([])
                free = size
            take = min(left, free)
            out[-1].append((length, take))
            left, free = left - take, free - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and whole numbers of containers that hold ``demand[g]`` items of
    ``sizes[g]``: the linear program's solution rounded down, the rest first-fit."""
    k = len(sizes)
    if not k:
        return []
    size = np.array(sizes)
    need = np.array(demand, float)
    # Starting basis: containers of one size each.
    basis = np.diag((capacity // size).astype(float))
    for _ in range(60 * k):
        inverse = np.linalg.inv(basis)
        price = np.ones(k) @ inverse
        value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for w in range(int(size.min()), capacity + 1):
            fits = np.flatnonzero(size <= w)
            gain = value[w - size[fits]] + price[fits]
            g = int(gain.argmax())
            value[w], pick[w] = (gain[g], fits[g]) if gain[g] > value[w - 1] + 1e-12 else (value[w - 1], -1)
        if value[capacity] <= 1 + 1e-7:
            break  # no configuration is worth more than a container: optimal
        column, w = np.zeros(k), capacity
        while w > 0:
            if pick[w] < 0:
                w -= 1
            else:
                column[pick[w]] += 1
                w -= int(size[pick[w]])
        x, change = inverse @ need, inverse @ column
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    else:
        warnings.warn("configurations aren't proven optimal: column generation was stopped", stacklevel=2)
    amounts = np.floor(np.linalg.solve(basis, need) + 1e-9)
    out, left = [], np.array(demand, dtype=object)
    for j in range(k):
        column = basis[:, j].astype(int)
        n = int(max(0, amounts[j]))
        n = min([n, *(int(left[g]) // int(column[g]) for g in range(k) if column[g])])
        if n:
            out.append((tuple(int(c) for c in column), n))
            left = left - column.astype(object) * n
    while any(left > 0):  # what rounding down left over, longest first
        room, column = capacity, [0] * k
        for g in np.argsort(-size, kind="stable"):
            fit = int(min(left[g], room // size[g]))
            column[g] = fit
            room -= fit * int(size[g])
        n = min(int(left[g]) // column[g] for g in range(k) if column[g])
        out.append((tuple(column), n))
        left = left - np.array(column, dtype=object) * n
    return out


def container_classes(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[dict[int, int], int]]:
    """Classes of containers that hold the histogram's items exactly: (lengths with
    how many of each, number of such containers)."""
    limit = capacity // small
    done: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        done.append(({capacity: 1}, histogram[capacity]))
    grouped = linear_groups({n: c for n, c in histogram.items() if limit < n < capacity}, groups)
    plan = configurations([g[0][0] for g in grouped], [sum(c for _, c in g) for g in grouped], capacity)
    queues = [[list(r) for r in g] for g in grouped]

    def take(g: int, n: int) -> list[tuple[int, int]]:
        runs = []
        while n:
            length, count = queues[g][0]
            t = min(n, count)
            runs.append((length, t))
            n -= t
            if t == count:
                queues[g].pop(0)
            else:
                queues[g][0][1] -= t
        return runs

    # by_room[r]: classes with r free, as [lengths, count].
    by_room: dict[int, list[list]] = {}

    def put(lengths: dict[int, int], n: int) -> None:
        room = capacity - sum(k * v for k, v in lengths.items())
        by_room.setdefault(room, []).append([lengths, n])

    for column, n in plan:
        slots = [take(g, n) for g, c in enumerate(column) for _ in range(c)]
        at, within = [0] * len(slots), [0] * len(slots)
        left = n
        while left:
            t = min([left, *(s[a][1] - w for s, a, w in zip(slots, at, within))])
            lengths: dict[int, int] = {}
            for j, s in enumerate(slots):
                length = s[at[j]][0]
                lengths[length] = lengths.get(length, 0) + 1
                within[j] += t
                if within[j] == s[at[j]][1]:
                    at[j], within[j] = at[j] + 1, 0
            put(lengths, t)
            left -= t
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r in by_room]] = True
    for length in range(limit, 0, -1):
        left = histogram.get(length, 0)
        while left:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                n, rest = divmod(left, each)
                for k, count in ((each, n), (rest, 1)):
                    if k and count:
                        put({length: k}, count)
                        rooms[capacity - k * length] = True
                break
            room = int(fits[0]) + length  # best fit: the least room that is enough
            lengths, count = by_room[room][-1]
            times = min(room // length, max(1, left // count))  # fill all of a class alike
            n = min(count, left)
            if n < count:
                by_room[room][-1][1] -= n
                times = 1
            else:
                by_room[room].pop()
            rooms[room] = bool(by_room[room])
            put({**lengths, length: lengths.get(length, 0) + times}, n)
            rooms[room - times * length] = True
            left -= n * times
    for entries in by_room.values():
        done += [(lengths, n) for lengths, n in entries if n]
    return done


def lookup(classes: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Rank ranges per length: from ``start`` on, ``each`` items of a length go into
    every container, from number ``base`` on; ``free`` is the space left there."""
    rows, used, base = [], {}, 0
    for lengths, n in classes:
        free = capacity - sum(k * v for k, v in lengths.items())
        for length, each in lengths.items():
            start = used.get(length, 0)
            rows.append((length, start, base, each, free))
            used[length] = start + each * n
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "start": table[:, 1], "base": table[:, 2], "each": table[:, 3], "free": table[:, 4]}


def _place(table):
    def run(batches):
        t = table.value
        for b in batches:
            length, rank = b["n_tokens"].to_numpy().astype(np.int64), b["rank"].to_numpy()
            if not len(length) or not len(t["key"]):
                continue
            row = np.searchsorted(t["key"], (length << 44) + rank, "right") - 1
            container = t["base"][row] + (rank - t["start"][row]) // t["each"][row]
            yield pa.RecordBatch.from_arrays([pa.array(container), b["doc_id"], b["piece"], b["token_start"], b["n_tokens"], pa.array(t["free"][row].astype(np.int32))], ["container_id", "doc_id", "piece", "token_start", "n_tokens", "space_left"])

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, groups: int = GROUPS, small: int = SMALL, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """container_id, doc_id, piece, token_start, n_tokens, space_left: one row per piece
    of a document, with its container and the space left in that.

    A text longer than ``capacity`` is split into pieces of ``capacity`` tokens and a
    rest; no other text is split. A text without tokens (null, empty) takes no
    space: its row has a null container_id and space_left and n_tokens 0. Rows with a
    null doc_id are left out; repeated documents are packed as often as they occur.
    """
    spark = documents.sparkSession
    rows = documents.where("doc_id is not null").select("doc_id", "text")
    spark.sparkContext.addFile(tokenizer)  # executors get the vocabulary from here
    pieces = spread(rows).mapInArrow(_pieces(os.path.basename(tokenizer), capacity), "doc_id bigint, piece int, token_start bigint, n_tokens int")
    items = cut_table(pieces.withColumn("row", F.monotonically_increasing_id()), "packing").df
    histogram = {r["n_tokens"]: r["count"] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    histogram.pop(0, None)
    table = spark.sparkContext.broadcast(lookup(container_classes(histogram, capacity, groups, small), capacity))
    buckets = max([1, *(-(-c // bucket_rows) for c in histogram.values())])
    held = items.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = held.groupBy("n_tokens", "bucket").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("c")).drop("c")
    place = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece", "row")) - 1
    ranked = held.withColumn("place", place).join(before, ["n_tokens", "bucket"]).withColumn("rank", (F.col("place") + F.col("before")).cast("bigint"))
    out = "container_id bigint, doc_id bigint, piece int, token_start bigint, n_tokens int, space_left int"
    packed = ranked.select("doc_id", "piece", "token_start", "n_tokens", "rank").mapInArrow(_place(table), out)
    empty = items.where("n_tokens = 0").select(F.lit(None).cast("bigint").alias("container_id"), "doc_id", "piece", "token_start", "n_tokens", F.lit(None).cast("int").alias("space_left"))
    return packed.unionByName(empty)


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_containers, n_pieces, n_tokens, space_left, least_containers (what the sum of
    tokens needs at least) over a result of ``pack_documents``."""
    boxes = packed.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return boxes.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(capacity - F.col("tokens")), F.lit(0)).alias("space_left"), F.coalesce(F.ceil(F.sum("tokens") / capacity), F.lit(0)).cast("bigint").alias("least_containers"),
    )
