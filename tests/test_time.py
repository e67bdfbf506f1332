"""Fusion joins, temporal features, labels and splits on handmade frames."""

import math

import pytest
from pyspark.sql import functions as F

from polarframe.functions import physics
from polarframe.operators import fusion, labels, splits, temporal


@pytest.fixture
def gappy(spark):
    return spark.createDataFrame([(1, 1, 10, 1.0), (1, 1, 11, 3.0), (1, 1, 14, 8.0)], "x int, y int, month_idx int, v double")


def _by_month(df, name):
    return {r.month_idx: r[name] for r in df.collect()}


def test_windows_respect_calendar_gaps(gappy):
    quarterly = fusion.quarterly_stats(gappy, ["v"])
    assert _by_month(quarterly, "v_quarterly_avg") == {10: 1.0, 11: 2.0, 14: 8.0}
    assert _by_month(quarterly, "v_quarterly_std") == {10: None, 11: pytest.approx(math.sqrt(2)), 14: None}
    assert _by_month(temporal.expanding_mean(gappy, "v"), "pixel_mean_v") == {10: 1.0, 11: 2.0, 14: 4.0}
    assert _by_month(temporal.momentum(gappy, "v"), "v_momentum") == {10: None, 11: 2.0, 14: None}
    assert _by_month(temporal.rate(gappy, "v"), "v_rate") == {10: None, 11: 24.0, 14: pytest.approx(20.0)}
    assert _by_month(temporal.acceleration(gappy, "v"), "v_acceleration") == {10: None, 11: None, 14: None}
    assert _by_month(temporal.trailing_mean(gappy, "v", 4), "v_4mo_avg") == {10: 1.0, 11: 2.0, 14: 5.5}
    assert _by_month(fusion.height_rate(gappy, 3, "v"), "dhdt_lag1") == {10: None, 11: None, 14: 20.0}


def test_last_expanding_mean_is_the_plain_mean(spark):
    df = spark.range(300).select((F.col("id") % 4).alias("x"), F.lit(0).alias("y"), F.floor(F.col("id") / 4).cast("int").alias("month_idx"), (F.col("id") % 11).alias("v"))
    last = temporal.expanding_mean(df, "v").groupBy("x").agg(F.max_by("pixel_mean_v", "month_idx").alias("last"), F.avg("v").alias("mean"))
    assert last.filter("abs(last - mean) > 1e-12").count() == 0


def test_pixel_features_shuffle_once(spark):
    df = spark.createDataFrame([(1, 1, 10, 1.0, 2.0)], "x int, y int, month_idx int, delta_h double, surface_slope double")
    out = temporal.acceleration(temporal.rate(temporal.momentum(temporal.expanding_mean(df, "delta_h"), "delta_h"), "delta_h"), "delta_h")
    out = fusion.height_rate(temporal.trailing_mean(temporal.lag_diff(out, "surface_slope"), "delta_h", 6), 3)
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_pixel_months_collapse_a_crowded_pixel(spark, rows):
    df = spark.range(1000).select(F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(5).alias("month_idx"), F.col("id").cast("double").alias("v"))
    assert rows(fusion.to_pixel_months(df, ["v"]), "x", "month_idx", "v") == [(1, 5, 499.5)]


def test_zscore_of_single_row_and_constant_group(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 1.0), ("c", 3.0)], "g string, v double")
    out = temporal.group_zscore(df, ["g"], "v", out="z")
    assert rows(out, "g", "z") == [("a", None), ("b", None), ("b", None), ("c", pytest.approx(-math.sqrt(0.5))), ("c", pytest.approx(math.sqrt(0.5)))]


def test_sample_at_depth(spark):
    ocean = spark.createDataFrame([(1, 5, d, v) for d, v in ((10.0, 1.0), (20.0, 3.0), (40.0, 7.0), (50.0, None))], "c int, month_idx int, depth double, value double")
    points = spark.createDataFrame([(1, 5, d) for d in (0.0, 15.0, 19.0, 30.0, 90.0)] + [(1, 5, None), (2, 5, 10.0)], "c int, month_idx int, clamped_depth double")
    near = {(r.c, r.clamped_depth): r.value_at_depth for r in fusion.sample_at_depth(points, ocean, ["c", "month_idx"]).collect()}
    assert near == {(1, 0.0): 1.0, (1, 15.0): 1.0, (1, 19.0): 3.0, (1, 30.0): 3.0, (1, 90.0): 7.0, (1, None): None, (2, 10.0): None}
    line = {r.clamped_depth: r.value_at_depth for r in fusion.sample_at_depth(points.filter("c = 1"), ocean, ["c", "month_idx"], mode="linear").collect()}
    assert line == {0.0: 1.0, 15.0: 2.0, 19.0: pytest.approx(2.8), 30.0: 5.0, 90.0: 7.0, None: None}


def test_clamp_depth(spark, rows):
    ocean = spark.createDataFrame([(1, 100.0, 1.0), (1, 200.0, None), (1, 150.0, float("nan"))], "c int, depth double, value double")
    drafts = spark.createDataFrame([(1, 50.0), (1, 500.0), (2, 50.0)], "c int, ice_draft double")
    assert rows(fusion.clamp_depth(drafts, ocean, ["c"]), "c", "ice_draft", "clamped_depth") == [(1, 50.0, 50.0), (1, 500.0, 100.0), (2, 50.0, None)]


def test_disaggregation_keeps_the_mascon_mean(spark):
    df = spark.createDataFrame([(1, 1, 6.0, 1.0), (1, 1, 6.0, -3.0), (1, 1, 6.0, 2.0), (2, 1, 4.0, 0.0)], "mascon_id int, month_idx int, lwe_mo double, delta_h double")
    out = fusion.disaggregate_mass(df)
    assert out.filter("mascon_id = 1").agg(F.avg("lwe_fused")).first()[0] == pytest.approx(6.0)
    assert out.filter("mascon_id = 2").first().lwe_fused is None


def test_calendar_gaps(spark, rows):
    df = spark.createDataFrame([(1, m) for m in range(1, 13) if m not in (4, 9)] + [(2, 40)], "k int, month_idx int")
    assert rows(fusion.calendar_gaps(df, ["k"], 3, 10).filter("k = 1"), "month_idx") == [(4,), (9,)]
    assert fusion.calendar_gaps(df, ["k"], 3, 10).filter("k = 2").count() == 8


def test_ice_geometry_and_physics(spark):
    df = spark.createDataFrame([(100.0, 500.0), (600.0, 100.0), (None, 1.0)], "surface double, thickness double")
    assert [(r.ice_base, r.ice_draft) for r in physics.ice_geometry(df).collect()] == [(-400.0, 400.0), (500.0, 0.0), (None, None)]
    water = spark.createDataFrame([(34.0, 500.0, -1.0)], "so_mo double, clamped_depth double, thetao_mo double")
    row = physics.thermal_driving(physics.freezing_point(water)).first()
    assert row.t_f_mo == pytest.approx(-0.057 * 34 - 0.38) and row.t_star_mo == pytest.approx(-1 + 0.057 * 34 + 0.38)


def test_label_uses_training_statistics_only(spark, rows):
    train = [("m", "r", 1, float(v), float(v)) for v in range(10)]
    later = [("m", "r", 9, -100.0, -100.0), ("m", "r", 9, -100.0, 50.0), ("m", "r", 9, None, -100.0), ("n", "r", 9, -1.0, -1.0)]
    df = spark.createDataFrame(train + later, "mascon_id string, regional_subset_id string, month_idx int, lwe_quarterly_avg double, delta_h double")
    out = labels.agreement_label(df, stats_from=df.filter("month_idx = 1")).filter("month_idx = 9")
    got = {(r.mascon_id, r.lwe_quarterly_avg, r.delta_h): r[labels.LABEL] for r in out.collect()}
    assert got == {("m", -100.0, -100.0): 1, ("m", -100.0, 50.0): 0, ("m", None, -100.0): None, ("n", -1.0, -1.0): None}


@pytest.fixture
def rare(spark):
    return spark.range(20_000).select(
        F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("month_idx"),
        F.when(F.col("id") % 4 == 0, "ross").otherwise("ronne").alias("regional_subset_id"),
        (F.col("id") % 100 < 3).cast("int").alias(labels.LABEL),
    )


def test_undersampling_keeps_positives(rare):
    out = splits.undersample(rare, ratio=5)
    pos, neg = out.filter(f"{labels.LABEL} = 1").count(), out.filter(f"{labels.LABEL} = 0").count()
    assert pos == 600 and 2700 < neg < 3300
    by = {r.regional_subset_id: r.n for r in splits.undersample(rare, ratio=10, ratios={"ross": 2}).filter(f"{labels.LABEL} = 0").groupBy("regional_subset_id").agg(F.count("x").alias("n")).collect()}
    assert 320 < by["ross"] < 480 and 3600 < by["ronne"] < 4400


def test_sample_weights_balance_classes_and_regions(rare):
    out = labels.sample_weights(rare)
    by = out.groupBy(labels.LABEL).agg(F.avg("weight").alias("w"), F.count("x").alias("n")).collect()
    heavy = {r[labels.LABEL]: r.w for r in by}
    assert heavy[1] > 10 * heavy[0] and out.count() == 20_000


def test_splits_are_disjoint_and_whole(spark, rare):
    months = spark.range(24230, 24300).select(F.col("id").cast("int").alias("month_idx"))
    assert {r.split for r in splits.temporal_split(months).collect()} == {"train", "val", "test"}
    assert splits.temporal_split(months, train_start=splits.TRAIN_START).filter("split is null").count() == splits.TRAIN_START - 24230
    a, b = splits.oof_split(rare)
    assert a.count() + b.count() == 20_000 and a.join(b, "x", "left_semi").count() == 0
    train, val = splits.region_fold(rare, "ross")
    assert train.count() == 15_000 and val.count() == 5_000


def test_expanding_folds(spark, rows):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("month_idx"))
    out = splits.expanding_folds(df, start=4, end=9, step=3)
    assert rows(out.filter("fold = 1 and role = 'val'"), "month_idx") == [(8,), (9,)]
    for fold in (0, 1):
        train, val = splits.expanding_fold(df, fold, 4, 9)
        assert rows(train, "month_idx") == rows(out.filter(f"fold = {fold} and role = 'train'"), "month_idx")
        assert rows(val, "month_idx") == rows(out.filter(f"fold = {fold} and role = 'val'"), "month_idx")
