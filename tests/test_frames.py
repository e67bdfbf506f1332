"""Sources, cleaning and profiling on handmade frames: nulls, NaN, empty and constant columns."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from polarframe.functions import calendar
from polarframe.operators import clean, labels, profile, splits
from polarframe.sources.readers import decode_packed, read_observations, union_tiles
from polarframe.sources.schemas import OCEAN_PACKING, V1, V2, PackSpec
from polarframe.sources.sinks import materialize, preview, save_predictions, write_observations

NAN = float("nan")


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, NAN, None), (3, None, "c"), (4, 3.0, "d")], "id int, v double, s string")


def test_schemas():
    assert len(V1) == 19 and len(V2) == 31 and V1["time"].dataType.simpleString() == "bigint"
    assert all(f.nullable for f in V1) and all(f.nullable for f in V2)


def test_read_and_convert_v1(spark, tmp_path, rows):
    day = 86_400 * 10**9
    midnight = 18_078 * day  # 2019-07-01 UTC
    made = [(midnight - 1, 1.0), (midnight, 2.0), (midnight + 1, 3.0)]
    spark.createDataFrame(made, "time long, x float").write.parquet(str(tmp_path / "v1"))
    df = read_observations(spark, str(tmp_path / "v1"), V1)
    assert df.columns == V1.fieldNames()
    got = rows(calendar.with_date_from_ns(df), "x", "time")
    assert got == [(1.0, dt.date(2019, 6, 30)), (2.0, dt.date(2019, 7, 1)), (3.0, dt.date(2019, 7, 1))]


def test_month_index_inverse(spark, rows):
    df = spark.createDataFrame([(2019 * 12 + 12,), (2020 * 12 + 1,)], "month_idx int")
    assert rows(calendar.with_year_month(df), "year", "month_of_year") == [(2019, 12), (2020, 1)]
    december, january = calendar.cyclic_month(df).orderBy("month_idx").collect()
    assert math.isclose(december.sin_month, 0, abs_tol=1e-12) and math.isclose(january.sin_month, 0.5)


def test_decode_packed_limits(spark, rows):
    df = spark.createDataFrame([(1, -32767), (2, 0), (3, 1), (4, 31700), (5, 31701)], "id int, so int")
    got = dict(rows(decode_packed(df, {"so": OCEAN_PACKING["so"]}), "id", "so"))
    assert [got[i] is None for i in range(1, 6)] == [True, True, False, False, True]
    assert got[3] == pytest.approx(0.0, abs=1e-12)
    assert decode_packed(df, {"so": PackSpec(fill=0)}).filter("so is null").count() == 1


def test_decode_cf_time(spark):
    df = spark.createDataFrame([(31.5,)], "time double")
    out = calendar.decode_cf_time(df, "time", calendar.SECONDS_PER_DAY, calendar.GRAVITY_EPOCH)
    text = out.select(F.date_format("exact_time", "yyyy-MM-dd HH"), "month_idx").first()
    assert tuple(text) == ("2002-02-01 12", 2002 * 12 + 2)


def test_tiles_and_preview(spark, rows):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(4, 3)], "y int, x int")
    assert rows(union_tiles({"A1": a, "A2": b}), "x", "y", "tile") == [(1, 2, "A1"), (3, 4, "A2")]
    assert preview(spark.range(10).withColumn("v", -F.col("id")), ["v"], ["id"], 3).collect() == [(0,), (-1,), (-2,)]


def test_sinks_round_trip(spark, tmp_path, rows):
    df = spark.range(1000).select((F.col("id") % 3 + 24240).cast("int").alias("month_idx"), F.col("id").alias("x"))
    write_observations(df, str(tmp_path / "obs"))
    assert rows(spark.read.parquet(str(tmp_path / "obs")), "x", "month_idx") == rows(df, "x", "month_idx")
    assert rows(materialize(df, str(tmp_path / "flat")), "x", "month_idx") == rows(df, "x", "month_idx")
    for model, split in (("m", "val"), ("m", "test")):
        save_predictions(df.withColumn("model", F.lit(model)), model, split, str(tmp_path / "predictions"))
    saved = spark.read.parquet(str(tmp_path / "predictions"))
    assert saved.groupBy("model", "split").count().count() == 2 and saved.count() == 2000


def test_a_crowded_month_is_written_by_several_tasks(spark, tmp_path):
    month = F.when(F.col("id") % 3 == 0, F.col("id") % 7 + 1).otherwise(24240)
    df = spark.range(300_000).select(month.cast("int").alias("month_idx"), F.xxhash64("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        write_observations(df, str(tmp_path / "obs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "obs").iterdir() if d.is_dir()}
    assert files["month_idx=24240"] > 2 and len(files) == 8
    assert spark.read.parquet(str(tmp_path / "obs")).count() == 300_000


def test_season_prunes_month_partitions(spark, tmp_path):
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in V2 if f.name not in ("x", "month_idx")]
    df = spark.range(1200).select((F.col("id") % 24 + 2019 * 12 + 1).cast("int").alias("month_idx"), F.col("id").cast("double").alias("x"), *columns)
    write_observations(df, str(tmp_path / "obs"))
    winter = clean.season(read_observations(spark, str(tmp_path / "obs"), V2), 2020)
    assert winter.count() == 150 and set(winter.columns) == set(V2.fieldNames())
    plan = winter.select("x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month_idx" in plan and "ReadSchema: struct<x:double>" in plan


def test_missing_values(mixed, rows):
    assert rows(clean.drop_missing(mixed, ["v"]), "id") == [(1,), (4,)]
    filled = clean.flag_and_fill(mixed, "v", ["v"])
    assert rows(filled, "id", "ocean_valid", "v") == [(1, 1, 1.0), (2, 0, 0.0), (3, 0, 0.0), (4, 1, 3.0)]
    ratios = dict(rows(profile.missing_ratios(mixed), "column", "ratio"))
    assert ratios == {"id": 0.0, "v": 0.5, "s": 0.25}
    assert rows(profile.missing_report(mixed, 0.25), "column") == [("v",)]  # strictly above


def test_summaries_skip_nan(mixed):
    row = profile.summarize(mixed, ["v"]).first()
    assert (row.n, row["mean"], row.min_value, row.max_value) == (2, 2.0, 1.0, 3.0)
    assert row.stddev == pytest.approx(math.sqrt(2))


def test_empty_table(spark):
    empty = spark.createDataFrame([], StructType([StructField("v", DoubleType())]))
    assert profile.missing_ratios(empty).first().ratio is None
    assert profile.histogram(empty, "v", 4).agg(F.sum("n")).first()[0] == 0
    assert profile.shape(empty).first().n_rows == 0


@pytest.mark.parametrize("values, counts", [
    ([5.0, 5.0, 5.0], [3, 0, 0, 0]),
    ([0.0, 1.0, 2.0, 4.0, NAN, None], [1, 1, 1, 1]),
    ([None, None], [0, 0, 0, 0]),
])
def test_histogram(spark, values, counts):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.n for r in profile.histogram(df, "v", 4).orderBy("bin_id").collect()] == counts


def test_range_and_log(spark, rows):
    df = spark.createDataFrame([(-2.0,), (0.0,), (None,)], "v double")
    assert rows(clean.log1p_cols(df, ["v"]), "v", "log_v") == [(None, None), (-2.0, None), (0.0, 0.0)]
    assert rows(clean.valid_range(df, {"v": (-1, 1)}), "v") == [(None,), (None,), (0.0,)]


def test_sample_does_not_depend_on_partitions(spark, rows):
    df = spark.range(20_000)
    one = rows(clean.sample_rows(df.repartition(7), 0.05, 42, ["id"]), "id")
    assert one == rows(clean.sample_rows(df.repartition(2), 0.05, 42, ["id"]), "id")
    assert 800 < len(one) < 1200


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v), None) for v in [1, 2, 3, 4, 100]], "v double, w double")
    by = {r["column"]: r for r in profile.box_stats(df, ["v", "w"]).collect()}
    row = by["v"]
    assert (row.n, row.q1, row["median"], row.q3) == (5, 2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1.0, 4.0, 1)
    assert by["w"].n == 0 and by["w"]["median"] is None and by["w"].n_outliers == 0


def test_quantiles_with_a_hot_value(spark):
    # A third of all rows share one value.
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 77.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7.0).alias("v"))
    values = np.array([r.v for r in df.collect()])
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.share: r for r in profile.quantiles(df, ["v"], shares).collect()}
    for share in shares:
        assert got[share].value == pytest.approx(np.quantile(values, share), rel=1e-12)
        assert got[share].low == np.quantile(values, share, method="lower") and got[share].n == 30_000


def test_summaries_keep_whole_numbers(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1, 0.5), (big + 2, -7, NAN), (None, 3, None)], "a long, b int, c double")
    got = {r.column: r for r in profile.summarize(df).collect()}
    assert (got["a"].min_whole, got["a"].max_whole, got["a"].n) == (big, big + 2, 2)
    assert (got["b"].min_whole, got["b"].max_whole, got["b"].max_value) == (-7, 3, 3.0)
    assert (got["c"].min_whole, got["c"].max_whole, got["c"].min_value, got["c"].n) == (None, None, 0.5, 1)


VALUES = [0.0, -0.0, 1e-310, -1e-310, 5e300, -5e300, float("inf"), float("-inf"), 3.0, 3.0, -3.0, 1.0 + 2**-52, 1.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_quantiles_are_the_order_statistics(spark, parts):
    """Doubles of any sign and size, ties, NULL and NaN, whole numbers beyond 2^53 and a column without values, all at once."""
    rng = random.Random(parts)
    floats = VALUES + [rng.gauss(0, 10.0 ** rng.randint(-8, 8)) for _ in range(1500)] + [rng.choice(VALUES) for _ in range(300)]
    longs = [2**53 + 1 + 2 * rng.randint(-4, 4) for _ in range(900)] + [-(2**63), 2**63 - 1, 0, -1] + [None] * (len(floats) - 904)
    rows = [(f if i % 11 else None, g, None) for i, (f, g) in enumerate(zip(floats, longs))] + [(float("nan"), None, None)] * 5
    df = spark.createDataFrame(rows, "f double, g long, e double").repartition(parts)
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    got = {(r.column, r.share): r for r in profile.quantiles(df, ["f", "g", "e"], shares).collect()}
    assert len(got) == 3 * len(shares)
    for i, name in enumerate(("f", "g", "e")):
        kept = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        for share in shares:
            r, place = got[name, share], (len(kept) - 1) * share
            assert r.n == len(kept)
            if not kept:
                assert r.low is r.high is r.value is None
                continue
            assert (r.low, r.high) == (float(kept[math.floor(place)]), float(kept[math.ceil(place)]))
            assert r.low <= r.value <= r.high


def test_quantiles_of_one_value_and_small_types(spark):
    df = spark.createDataFrame([(7, 1.5)] * 40, "i int, d float")
    assert {(r.column, r.n, r.low, r.value) for r in profile.quantiles(df, ["i", "d"], [0.5]).collect()} == {("i", 40, 7.0, 7.0), ("d", 40, 1.5, 1.5)}



def test_correlations_use_pairwise_complete_rows(spark):
    made = [(1.0, 2.0, 5.0, 1e9), (2.0, 4.0, 5.0, 1e9 + 1), (3.0, None, 5.0, 1e9 + 3), (4.0, 7.0, NAN, 1e9 + 2), (None, 1.0, 5.0, None)]
    df = spark.createDataFrame(made, "a double, b double, c double, d double")
    got = {(r.column_a, r.column_b): r.r for r in profile.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16 and got[("a", "a")] == 1.0 and got[("b", "a")] == got[("a", "b")]
    for x, y in (("a", "b"), ("a", "d"), ("b", "d")):
        pairs = [(r[x], r[y]) for r in df.collect() if r[x] is not None and r[y] is not None]
        assert got[(x, y)] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], rel=1e-9)
    assert got[("a", "c")] is None  # no spread


def test_hexbin_counts_every_point(spark):
    df = spark.range(500).select((F.col("id") % 23).alias("x"), (F.col("id") % 31).alias("y"), F.lit(2.0).alias("z"))
    out = profile.hexbin_mean(df, "x", "y", "z", gridsize=10, clip=1.0)
    assert out.agg(F.sum("n")).first()[0] == 500 and out.filter("mean <> 1.0").count() == 0


def test_hexbin_does_not_look_at_other_columns(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("z"), F.when(F.col("id") < 5, True).alias("early"))
    assert profile.hexbin_mean(df, "x", "y", "z").agg(F.sum("n")).first()[0] == 100


def test_undersample_keeps_rows_without_a_region(spark):
    rows = spark.range(4_000).select(
        F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("month_idx"), F.when(F.col("id") % 2 == 0, "A").alias("regional_subset_id"),
        F.when(F.col("id") % 40 < 2, 1).otherwise(0).alias("basal_loss_agreement"), F.lit("clash").alias("_region"),
    )
    out = splits.undersample(rows, ratios={"A": 5.0})
    assert out.columns == rows.columns
    kept = {(r.regional_subset_id, r.basal_loss_agreement): r["count"] for r in out.groupBy("regional_subset_id", "basal_loss_agreement").count().collect()}
    assert kept[("A", 1)] == kept[(None, 1)] == 100
    assert 400 < kept[("A", 0)] < 600 and 850 < kept[(None, 0)] < 1_150


def test_weights_count_usable_rows_only(spark):
    rows = spark.createDataFrame([(1, "A"), (0, "A"), (0, "B"), (0, "B"), (None, "A"), (1, None)], "basal_loss_agreement int, regional_subset_id string")
    got = {(r.basal_loss_agreement, r.regional_subset_id): r.weight for r in labels.sample_weights(rows).collect()}
    assert got[(1, "A")] == 2.0 and got[(0, "B")] == pytest.approx(2 / 3)
    assert got[(None, "A")] is None and got[(1, None)] is None


def test_missing_months_and_logarithms(spark):
    rows = spark.createDataFrame([(2020 * 12 + 5, 1.0), (None, NAN), (2021 * 12 + 1, None)], "month_idx int, v double")
    assert {r.month_idx for r in clean.drop_years(rows, [2020]).collect()} == {None, 2021 * 12 + 1}
    assert [r.log_v for r in clean.log1p_cols(rows, ["v"]).collect()][1:] == [None, None]


def test_series_outlier(spark):
    df = spark.createDataFrame([(m, 10.0 + (m % 3)) for m in range(24)] + [(24, 90.0)], "month_idx int, v double")
    assert [r.month_idx for r in profile.series_outliers(df, "v", 3.5).filter("is_outlier").collect()] == [24]
