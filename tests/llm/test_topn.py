import random

from pyspark.sql import functions as F

from lodestone.llm.topn import top_n

from ..conftest import rows


def brute(data, n):
    groups = {}
    for g, s, i in data:
        groups.setdefault(g, []).append((-s, i))
    return sorted(((g, -s, i, k + 1) for g, v in groups.items() for k, (s, i) in enumerate(sorted(v)[:n])), key=repr)


def order():
    return [F.col("s").desc(), F.col("i").asc()]


def test_unequal_groups(spark):
    rng = random.Random(1)
    data = [("hot", rng.randrange(50), i) for i in range(5000)] + [(f"g{rng.randrange(400)}", rng.randrange(9), i) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, s int, i int").repartition(7)
    for n in (1, 3, 40):
        assert rows(top_n(df, ["g"], order(), n)) == brute(data, n)


def test_group_over_many_partitions(spark):
    data = [("one", i // 3, i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, s int, i int")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows(top_n(df, ["g"], order(), 1500)) == brute(data, 1500)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_nulls_ties_repeats_and_empty(spark):
    data = [(None, 1, 1), (None, 1, 2), (None, 2, 3), ("a", 1, 1), ("a", 1, 1), ("a", 1, 2)]
    df = spark.createDataFrame(data, "g string, s int, i int")
    assert rows(top_n(df, ["g"], order(), 2)) == sorted([(None, 2, 3, 1), (None, 1, 1, 2), ("a", 1, 1, 1), ("a", 1, 1, 2)], key=repr)
    assert rows(top_n(df.limit(0), ["g"], order(), 2)) == []
    assert rows(top_n(df, ["g"], order(), 0)) == []


def test_further_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "x", [1, 2], 5), (1, "y", None, 7)], "part int, kind string, extra array<int>, count int")
    got = top_n(df, ["part"], [F.col("count").desc()], 1, position="rank")
    assert got.columns == ["part", "kind", "extra", "count", "rank"]
    assert rows(got) == [(1, "y", None, 7, 1)]
