"""Keys that many rows share: the sketch, joins that spread them, and where their rows go."""

import pytest
from pyspark.sql import functions as F

from rowforge.operators import heavy, keys


@pytest.fixture(scope="module")
def sides(spark):
    """Half of both tables has one key; a third of each has none; 'alone' keys are heavy on one side only."""
    n = F.col("id")
    left = spark.range(0, 600, 1, 3).select(
        F.when(n % 2 == 0, "hot").when(n % 3 == 0, "").when(n % 5 == 0, "left alone").otherwise(F.concat(F.lit("k"), n)).alias("a"), F.lit("x").alias("b"), (n % 7).cast("string").alias("v")
    )
    right = spark.range(0, 300, 1, 3).select(
        F.when(n % 2 == 0, "hot").when(n % 3 == 0, None).when(n % 5 == 0, "right alone").otherwise(F.concat(F.lit("k"), n)).alias("c"), F.lit(" x ").alias("d"), n.cast("string").alias("w")
    )
    return left, right


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_spread_join_equals_the_plain_one(sides, how):
    left, right = sides
    pairs = [("a", "c"), ("b", "d")]
    plain = keys.join_tables(left, right, pairs, how, max_rows=None, piece_rows=None).df
    for piece in (1, 20, 100, 10_000):
        assert rows(keys.join_tables(left, right, pairs, how, max_rows=None, piece_rows=piece).df) == rows(plain)
    assert keys.join_tables(left.limit(0), right, pairs, how, max_rows=None, piece_rows=5).df.count() == (300 if how in ("right", "outer") else 0)


def test_heavy_keys(sides):
    left, right = (side.select(keys.key(columns).alias("k")) for side, columns in zip(sides, (["a", "b"], ["c", "d"]), strict=True))
    table = heavy.heavy_keys(left, right, "k", keys.key_text(F.col("k")), 40)
    found = {r["k"]["k0"]: (r["pieces_l"], r["pieces_r"], r["both"]) for r in table.collect()}
    assert found == {"hot": (8, 4, True)}  # 300 and 150 rows in pieces of 40
    assert heavy.heavy_keys(left, right, "k", keys.key_text(F.col("k")), 1000) is None


def test_frequent(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("v"))
    found = heavy.frequent(df, F.col("v"), 100)
    assert (found.rows, found.values) == (30_000, ["hot"])
    assert heavy.frequent(df.limit(0), F.col("v"), 1) == heavy.Frequent(0, [])


def test_rows_of_a_hot_key_and_of_none_are_spread(spark, sides):
    """Without adaptive execution the plain join puts them into one partition; here none has far more than its share."""
    left = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 == 0, "").when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("a"), F.col("id").cast("string").alias("v"))
    right = spark.createDataFrame([("hot", "1"), ("", "2"), ("other", "3")], "c string, w string")
    share = {}
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for piece in (None, 500):
            df = keys.join_tables(left, right, [("a", "c")], "outer", max_rows=None, piece_rows=piece).df
            counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(counts) == 40_002
            share[piece] = max(counts) / sum(counts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert share[None] > 0.7 and share[500] < 0.2
