"""Connected components by deterministic Boruvka hooking.

Nodes get order-preserving integer codes, so that the least code of a component is
its least identifier. In a round every component picks its smallest outgoing edge
under a fixed order of all edges (a hash of the pair, then the pair): the picked
edges form trees whose only cycles are mutual picks. Pointer doubling collapses
each tree onto its root, edges are relabelled by root and made distinct, and
rounds go on until no edge is left. A component at least halves the number of its
parts in a round. All minima combine before the shuffle, so hubs are no skew
there; the lookups of a label spread hot nodes over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import HOT_ROWS, cut_table, ordered_codes, salted_join


def _no_hot(rows: int):
    """A table of no more rows than a hot bucket has needs no search for one."""
    return [] if rows <= HOT_ROWS else None


def _roots(edges: DataFrame, hot):
    """(node, root) for one round of hooking on distinct edges (a, b), a < b."""
    rank = F.xxhash64("a", "b")
    both = edges.select(F.col("a").alias("node"), F.struct(rank.alias("h"), "a", "b").alias("e")).unionByName(edges.select(F.col("b").alias("node"), F.struct(rank.alias("h"), "a", "b").alias("e")))
    pick = both.groupBy("node").agg(F.min("e").alias("e")).select("node", F.when(F.col("e.a") == F.col("node"), F.col("e.b")).otherwise(F.col("e.a")).alias("up"))
    at = cut_table(pick, "cc-pick")
    while True:
        # A mutual pick is a tree's only cycle: its smaller node becomes the root. Two
        # nodes that point at one another only do so in the first step.
        over = at.df.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        two = salted_join(at.df, over, "up", hot=hot)
        root = F.when(F.col("up2") == F.col("node"), F.least("node", "up")).otherwise(F.col("up2"))
        step = cut_table(two.select("node", root.alias("up"), (root != F.col("up")).alias("moved")), "cc-up")
        at.drop()
        at = step
        if at.df.where("moved").isEmpty():
            return at


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node that a link joins with another one, with the
    least node of its component in byte order.

    Links count in either direction; repeated links, links of a node with itself
    and links with a null end add nothing. Without any link the result is empty.
    """
    pairs = links.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where("x is not null and y is not null and x <> y")
    pairs = cut_table(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cc-pairs")
    names = pairs.df.select(F.col("x").alias("name")).unionByName(pairs.df.select(F.col("y").alias("name"))).distinct()
    codes = cut_table(ordered_codes(names, "name"), "cc-codes").df
    hot = _no_hot(pairs.df.count())
    left = salted_join(pairs.df, codes.select(F.col("name").alias("x"), F.col("code").alias("a")), "x", spread=F.xxhash64("y"), hot=hot)
    coded = salted_join(left.select("y", "a"), codes.select(F.col("name").alias("y"), F.col("code").alias("b")), "y", spread=F.xxhash64("a"), hot=hot)
    edges = cut_table(coded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "cc-edges")
    pairs.drop()
    rounds = []
    n = edges.df.count()
    nodes = _no_hot(2 * n)
    while n:
        hot = _no_hot(2 * n)  # a node of each end, at most
        roots = _roots(edges.df, hot)
        rounds.append(roots.df.select("node", F.col("up").alias("root")))
        map_a = rounds[-1].select(F.col("node").alias("a"), F.col("root").alias("ra"))
        map_b = rounds[-1].select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = salted_join(edges.df, map_a, "a", spread=F.xxhash64("b"), hot=hot).select("b", "ra")
        whole = salted_join(half, map_b, "b", spread=F.xxhash64("ra"), hot=hot).where("ra <> rb")
        next_edges = cut_table(whole.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        edges.drop()
        edges, n = next_edges, next_edges.df.count()
    spark = links.sparkSession
    label = spark.createDataFrame([], "node bigint, root bigint")
    for k, roots in reversed(list(enumerate(rounds))):
        if k == len(rounds) - 1:
            label = roots
            continue
        later = label.select(F.col("node").alias("root"), F.col("root").alias("last"))
        label = salted_join(roots, later, "root", "left", spread=F.xxhash64("node"), hot=nodes).select("node", F.coalesce("last", "root").alias("root"))
    label = cut_table(label, "cc-label").df
    least = cut_table(label.groupBy("root").agg(F.min("node").alias("least")), "cc-least").df
    named = salted_join(label, least, "root", spread=F.xxhash64("node"), hot=nodes).select("node", "least")
    firsts = codes.join(least.select(F.col("least").alias("code")), "code", "left_semi").select(F.col("code").alias("least"), F.col("name").alias("component"))
    named = salted_join(named, firsts, "least", spread=F.xxhash64("node"), hot=nodes)
    return named.join(codes.select(F.col("code").alias("node"), "name"), "node").select(F.col("name").alias("node"), "component")
