"""The best N items of every group, by bisection of all groups at once.

Items of a group are ordered by an order-preserving integer code: the bits of the
score, high and low half, and where scores tie the identifier's bytes. Every group has
an interval of codes in which its cutoff lies. A pass splits the intervals of all
groups at midpoints (several levels at once, PARTS - 1 of them), counts the rows above
each midpoint, and keeps of each group only the part in which the N-th row lies: rows
above it are chosen, rows below are out. The passes end when every group's part holds
exactly as many rows as it still needs. A pass cuts an interval to 1/PARTS, so that a
half of 32 bits takes at most 8 passes and four bytes of identifiers 12. Rows only meet
counts, so a group may be of any size: no task sorts or holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import HOT_ROWS, cut_table, hot_parts, salted_join

PARTS = 16
#: Bytes of an identifier that one code holds, as three hex digits each.
CODE_BYTES = 4
#: What the code is made of: a half of the score's bits, or from 0 on the identifier's bytes there.
HIGH, LOW = -2, -1


def score_code(score: Column) -> Column:
    """The bits of a double as a bigint in the order of the doubles, infinities included."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def half(code: Column, at: Column) -> Column:
    return F.when(at == HIGH, F.shiftright(code, 32)).otherwise(code.bitwiseAND(F.lit(0xFFFFFFFF)))


def id_code(item: Column, offset: Column) -> Column:
    """A bigint that descends with the bytes of ``item`` after ``offset``. A byte is
    written as 1xx and the end as 000, so that a prefix comes before its extensions."""
    rest = F.hex(F.substring(F.encode(item, "UTF-8"), offset + 1, F.lit(CODE_BYTES)))
    digits = F.rpad(F.regexp_replace(rest, "(..)", "1$1"), CODE_BYTES * 3, "0")
    return -F.conv(digits, 16, 10).cast("bigint")


def common_prefix(a: str, b: str) -> Column:
    """Bytes that two strings, encoded in the columns a and b, have in common at the start."""
    return F.expr(f"coalesce(array_max(filter(sequence(0, least(octet_length({a}), octet_length({b}))), i -> substring(encode({a}, 'UTF-8'), 1, i) = substring(encode({b}, 'UTF-8'), 1, i))), 0)")


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 5, parts: int = PARTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows (group, item, score) of the ``n`` best items of every group: score
    descending, then item ascending in byte order.

    ``rows`` has one row per group and item (repeated rows are taken as one); rows
    with a null group, item or score or a NaN score are left out, infinite scores are
    scores. Groups of at most n rows come back whole; n below 1 gives no rows; an empty
    table an empty one.
    """
    given = {"g": group, "i": item, "s": score}
    clean = rows.select(*[F.col(f"`{c}`").alias(a) for a, c in given.items()]).where("g is not null and i is not null and s is not null and not isnan(s)")
    back = lambda df: df.select(*[F.col(a).alias(c) for a, c in given.items()])
    if n < 1:
        return back(clean.limit(0))
    scored = clean.withColumn("s", F.col("s").cast("double") + F.lit(0.0)).distinct()
    base = cut_table(scored.withColumn("code", score_code(F.col("s"))), "topn")
    sizes = cut_table(base.df.groupBy("g").agg(F.count("*").alias("size"), F.min("code").alias("lo"), F.max("code").alias("hi")), "topn-groups")
    at = F.lit(HIGH)
    state = sizes.df.select("g", "size", F.lit(n).cast("bigint").alias("need"), half(F.col("lo"), at).alias("lo"), half(F.col("hi"), at).alias("hi"), at.alias("at"))
    first = salted_join(base.df, state, "g", hot=hot_parts(sizes.df, "g", hot_rows, "size"), spread=F.xxhash64("i"))
    # Groups of n rows or fewer are chosen as they are: only the others are bisected.
    start = cut_table(first.withColumn("chosen", F.col("size") <= n).drop("size"), "topn-start")
    base.drop()
    sizes.drop()
    done, live = [start.df.where("chosen").select("g", "i", "s")], start.df.where("not chosen").drop("chosen")
    while not live.isEmpty():
        value = F.when(F.col("at") < 0, half(F.col("code"), F.col("at"))).otherwise(id_code(F.col("i"), F.col("at")))
        width = F.col("hi") - F.col("lo") + 1  # below 2 to the power of 48: no overflow
        split = live.withColumn("v", value).withColumn("part", F.floor((F.col("v") - F.col("lo")) * parts / width).cast("int"))
        ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("v", "code", "i") for f in (F.min, F.max)]
        counts = split.groupBy("g", "part").agg(F.count("*").alias("c"), F.first("need").alias("need"), F.first("at").alias("at"), *ends)
        above = F.sum("c").over(Window.partitionBy("g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        cutoff = counts.withColumn("above", above).where((F.col("above") < F.col("need")) & (F.col("above") + F.col("c") >= F.col("need")))
        # Where all values are alike the code goes on: to the scores' other half, or to the
        # bytes behind those that all identifiers share.
        tied = F.col("v_min") == F.col("v_max")
        to_low = tied & (F.col("at") == HIGH) & (F.col("code_min") != F.col("code_max"))
        shared = F.when(tied & ~to_low & (F.col("i_min") != F.col("i_max")), common_prefix("i_min", "i_max"))
        cutoff = cutoff.withColumn("to_low", to_low).withColumn("shared", shared)
        lo = F.when(F.col("to_low"), half(F.col("code_min"), F.lit(LOW))).when(F.col("shared").isNotNull(), id_code(F.col("i_max"), F.col("shared"))).otherwise(F.col("v_min"))
        hi = F.when(F.col("to_low"), half(F.col("code_max"), F.lit(LOW))).when(F.col("shared").isNotNull(), id_code(F.col("i_min"), F.col("shared"))).otherwise(F.col("v_max"))
        next_at = F.when(F.col("to_low"), LOW).when(F.col("shared").isNotNull(), F.col("shared")).otherwise(F.col("at"))
        need = F.col("need") - F.col("above")
        bounds = cutoff.select("g", F.col("part").alias("cut_part"), need.alias("need"), lo.alias("lo"), hi.alias("hi"), next_at.cast("int").alias("at"), (F.col("c") == need).alias("all_in"))
        met = salted_join(split.select("g", "i", "s", "code", "part"), bounds, "g", spread=F.xxhash64("i"), rows=hot_rows).where(F.col("part") >= F.col("cut_part"))
        chosen = (F.col("part") > F.col("cut_part")) | F.col("all_in")
        step = cut_table(met.select("g", "i", "s", "code", chosen.alias("chosen"), "need", "lo", "hi", "at"), "topn-pass").df
        done.append(step.where("chosen").select("g", "i", "s"))
        live = step.where("not chosen").drop("chosen")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return back(out)
