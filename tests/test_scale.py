from pyspark.sql import functions as F

from corvane.operators import scale


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_salted_join_equals_plain_join(spark):
    many = spark.range(400).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    many = many.unionByName(spark.createDataFrame([(None, 1000)], "k string, id long"))
    one = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("other", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = many.join(one, "k", how).select(*many.columns)
        got = scale.salted_join(many, one, "k", how, rows=20)
        assert rows(got.select(*many.columns)) == rows(want)
    hot = spark.createDataFrame([("hot",)], "k string").select(scale._bucket("k").alias("b")).first()["b"]
    assert scale.hot_parts(many, "k", 20) == [(hot, 7)]
    grouped = many.groupBy("k").count()
    assert scale.hot_parts(grouped, "k", 20, "count") == [(hot, 7)]


def test_every_hot_key_is_spread(spark):
    """No list of a fixed length: 3,000 hot keys are all found."""
    many = spark.range(3000 * 12).select((F.col("id") % 3000).alias("k"), "id")
    hot = scale.hot_parts(many, "k", 10)
    assert sum(n for _, n in hot) >= 2 * len(hot) and len(hot) > 2900
    one = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = scale.salted_join(many, one, "k", rows=10)
    assert got.count() == 36000 and got.where("v <> 2 * k").count() == 0


def test_ordered_codes_follow_byte_order(spark):
    names = ["b", "a", "ä", "z", "A", "", "aa"]
    df = scale.cut(scale.ordered_codes(spark.createDataFrame([(n,) for n in names], "n string"), "n", partitions=3))
    got = [r["n"] for r in df.orderBy("code").collect()]
    assert got == sorted(names, key=lambda s: s.encode())


def test_global_places(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int")
    got = {r["x"]: r["place"] for r in scale.global_places(df, ["x"]).collect()}
    assert got == {i: i for i in range(101)}
    assert scale.global_places(df.limit(0), ["x"]).count() == 0
