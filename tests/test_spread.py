"""Distribution helpers: the paths taken on big tables, forced on small ones."""

import pytest
from pyspark.sql import functions as F

from polarframe.operators import distribute


@pytest.fixture
def hot(spark):
    """A third of all rows under one key, another sixth under no key at all."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("id"))
    return spark.range(6000).select(key.alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_skew_join_equals_join(spark, hot, rows, how):
    table = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).union(
        spark.createDataFrame([(7, 14)], "k long, w long"))
    assert rows(distribute.skew_join(hot, table, ["k"], how), "k", "v", "w") == rows(hot.join(table, ["k"], how), "k", "v", "w")


def test_skew_join_spreads_the_hot_key(spark, hot):
    table = spark.createDataFrame([(7, 14)], "k long, w long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = distribute.skew_join(hot, table, ["k"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in joined.filter("k = 7").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 2000 and len(sizes) == 4 and max(sizes) < 1200


def test_lookup_join_leaves_broadcast_above_the_bound(spark, hot, rows, monkeypatch):
    table = spark.range(6000).select(F.col("id").alias("k"), F.col("id").alias("w"))
    small = rows(distribute.lookup_join(hot, table, ["k"]), "k", "v", "w")
    monkeypatch.setattr(distribute, "BROADCAST_VALUES", 10)
    assert rows(distribute.lookup_join(hot, table, ["k"]), "k", "v", "w") == small


@pytest.fixture(params=["true", "false"])
def slices(spark, request):
    """With and without merging of small partitions: one slice, and several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(spark, descending, slices):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("n"))
    got = {r.o: r.cum_n for r in distribute.prefix_sums(df, "o", ["n"], ["g"], descending).collect()}
    for g in (0, 1):
        total = 0
        for o in sorted(range(g, 1000, 2), reverse=descending):
            total += o % 7
            assert got[o] == total
    whole = distribute.prefix_sums(df, "o", ["n"]).agg(F.max("cum_n")).first()[0]
    assert whole == sum(i % 7 for i in range(1000))


def test_settle_cuts_lineage_into_the_configured_folder(spark, tmp_path):
    df = distribute.settle(spark.range(10).filter("id > 3"))
    assert df.count() == 6
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_group_stats_keep_rows_without_key(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, v double")
    out = distribute.with_group_stats(df, ["g"], [F.avg("v").alias("m")])
    assert rows(out, "g", "v", "m") == [(None, 5.0, None), ("a", 1.0, 2.0), ("a", 3.0, 2.0)]


def test_salts_follow_the_rows_of_a_key(spark, hot, rows, monkeypatch):
    monkeypatch.setattr(distribute, "SALTS", 2)
    monkeypatch.setattr(distribute, "ROWS_PER_SALT", 100)
    table = spark.range(6000).select(F.col("id").alias("k"), F.col("id").alias("w"))
    assert rows(distribute.skew_join(hot, table, ["k"]), "k", "v", "w") == rows(hot.join(table, ["k"], "left"), "k", "v", "w")


def test_long_values_count_by_what_they_hold(spark):
    table = spark.range(10).select("id", F.repeat(F.lit("x"), 80).alias("s"), F.sequence(F.lit(1), F.lit(5)).alias("a"))
    assert distribute._values(table, None) == 10 * (1 + 10 + 5)
    assert distribute._values(table.select("id"), None) == 10 and distribute._values(table, 3) == 30


def test_only_hot_keys_are_named_and_nothing_is_written(spark, hot):
    """A planted hot key is found with its salts; rows without a key and the thousands of small keys are not listed, and no file appears."""
    import os

    folder = distribute.shared_folder(spark).removeprefix("file:")
    before = sum(len(f) for _, _, f in os.walk(folder))
    whole = hot.unionByName(spark.range(10_000, 60_000).select(F.col("id").alias("k"), F.col("id").alias("v")))
    seven = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint")).alias("h")).first().h
    assert distribute.hot_keys(whole, ["k"]) == [(seven, distribute.SALTS)]
    assert sum(len(f) for _, _, f in os.walk(folder)) == before
    assert distribute.hot_keys(whole.where("k is null"), ["k"]) == []


def test_rows_without_a_key_are_spread(spark, hot):
    table = spark.createDataFrame([(7, 14)], "k long, w long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = distribute.skew_join(hot, table, ["k"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in joined.filter("k is null").groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 350


def test_keys_of_different_types_meet(spark, hot, rows):
    """The other table has narrower or text keys, some of which fit no key."""
    narrow = spark.createDataFrame([(7, 1), (8, 2), (None, 3)], "k int, w long")
    assert rows(distribute.skew_join(hot, narrow, ["k"]), "k", "v", "w") == rows(hot.join(narrow, ["k"], "left"), "k", "v", "w")
