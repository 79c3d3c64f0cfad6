"""Positions matched with line spans: equi-joins on the file with a span test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64

#: Which of several enclosing spans wins, as a key to be minimised. ``narrowest``: the
#: shortest, then the first, then the least id; ``innermost``: the one that starts
#: last, then ends first; ``smallest``: the shortest, then the first in the file.
RULES = {
    "narrowest": lambda: F.struct(F.col("end_line") - F.col("start_line"), "start_line", "unit_id"),
    "innermost": lambda: F.struct(-F.col("start_line"), "end_line", "unit_id"),
    "smallest": lambda: F.struct(F.col("end_line") - F.col("start_line"), "start_line", "end_line", "unit_id"),
}


def containing(points: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, line, unit_id, start_line, end_line): every distinct point with each span of
    its file that encloses it, ends included.

    Spans are split into the blocks of lines that they touch, so that the join is an
    equi-join on (path, block) and a file with very many spans is no hot key.
    """
    p = points.select("path", "line").distinct().withColumn("block", F.floor(F.col("line") / block))
    s = spans.select("path", "start_line", "end_line", "unit_id").where("start_line <= end_line")
    s = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))))
    return p.join(s, ["path", "block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line"))).drop("block")


def enclosing(points: DataFrame, spans: DataFrame, rule: str = "narrowest", block: int = BLOCK) -> DataFrame:
    """(path, line, unit_id): for every distinct point the span of its file that encloses
    it, chosen by ``rule``. Points outside all spans have no row."""
    hit = containing(points, spans, block)
    return hit.groupBy("path", "line").agg(F.min(RULES[rule]())["unit_id"].alias("unit_id"))


def unit_code(spans: DataFrame, sources: DataFrame) -> DataFrame:
    r"""(unit_id, code): lines start_line to end_line (from 1) of each span's file.

    Files are split into blocks of BLOCK lines before they are shuffled, and spans into the
    blocks they touch, which makes the interval join an equi-join on (path, block). A head
    file that is there in several texts counts with the latest mtime, then the greatest
    hash. Spans beyond the text are cut to it; spans that touch no line have no row. Line
    ends come out as \n.
    """
    heads = sources.where("version = 'head' and path is not null and text is not null")
    files = heads.select("path", F.struct("mtime", F.xxhash64("text").alias("h")).alias("edition"), F.split("text", "\r\n|\r|\n").alias("lines"))
    blocks = files.select("path", "edition", "lines", F.explode(F.sequence(F.lit(0), ((F.size("lines") - 1) / BLOCK).cast("int"))).alias("block"))
    blocks = blocks.select("path", "edition", "block", F.slice("lines", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("part"))
    touched = spans.where("start_line >= 1 and end_line >= start_line").select("unit_id", "path", "start_line", "end_line")
    touched = touched.withColumn("block", F.explode(F.sequence(((F.col("start_line") - 1) / BLOCK).cast("int"), ((F.col("end_line") - 1) / BLOCK).cast("int"))))
    newest = files.groupBy("path").agg(F.max("edition").alias("newest"))
    first = F.greatest(F.col("start_line") - F.col("block") * BLOCK, F.lit(1))
    last = F.least(F.col("end_line") - F.col("block") * BLOCK, F.size("part"))
    met = touched.join(newest, "path").join(blocks, ["path", "block"]).where((last >= first) & F.col("edition").eqNullSafe(F.col("newest")))
    pieces = met.select("unit_id", "block", F.array_join(F.slice("part", first, last - first + 1), "\n").alias("piece"))
    ordered = F.array_sort(F.collect_set(F.struct("block", "piece")))  # a set: files may be delivered again
    return pieces.groupBy("unit_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "\n").alias("code"))
