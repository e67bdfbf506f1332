"""The bucketed fact table keeps exchanges out of pixel windows; months added one by one equal one run."""

import random
import re

import pytest
from pyspark.sql import functions as F

from polarframe.operators import stored, temporal

COLUMNS = "x long, y long, delta_h double, surface_slope double, t_star_mo double, so_mo double, lwe_mo double, lwe_quarterly_avg double, mascon_id int, regional_subset_id string, month_idx int"


@pytest.fixture(scope="module")
def facts(spark):
    """Pixels that appear late, skip months, and lack values."""
    rng = random.Random(7)
    rows = []
    for p in range(40):
        for m in range(24000 + p % 9, 24030):
            if rng.random() < 0.2:
                continue
            value = lambda share: float(rng.randrange(100)) if rng.random() > share else None
            rows.append((p % 8, p // 8, value(0.1), value(0.2), rng.choice([value(0.3), float("nan")]), value(0.5), value(0.1), value(0.1), p % 3, "ab"[p % 2], m))
    return spark.createDataFrame(rows, COLUMNS).cache()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, facts, tmp_path):
    name = f"facts_{tmp_path.name.replace('-', '_')}"
    yield name, stored.write_bucketed(facts, name, str(tmp_path / "facts"), 5)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_pixel_windows_on_the_stored_table_need_no_exchange(spark, facts, table, rows):
    name, df = table
    windows = lambda d: temporal.acceleration(temporal.rate(temporal.trailing_mean(temporal.expanding_mean(d, "delta_h"), "t_star_mo", 6), "delta_h"), "delta_h")
    assert "hashpartitioning(x" in _plan(windows(facts))
    assert "Exchange" not in _plan(windows(df))
    # The whole feature set has exchanges for its small tables of groups only.
    assert not re.search(r"Exchange hashpartitioning\(x#", _plan(temporal.temporal_features(df)))
    names = ["x", "y", "month_idx", "pixel_mean_delta_h", "delta_h_rate", "delta_h_acceleration", "t_star_6mo_avg"]
    assert rows(windows(df), *names) == rows(windows(facts), *names)


def test_floating_keys_are_refused(facts, tmp_path):
    with pytest.raises(ValueError, match="floating"):
        stored.write_bucketed(facts.withColumn("x", F.col("x").cast("double")), "never", str(tmp_path / "never"), 5)


def test_months_of_the_stored_table_prune(table):
    _, df = table
    plan = _plan(df.filter("month_idx = 24010"))
    assert re.search(r"PartitionFilters: \[[^\]]*month_idx[^\]]*24010", plan)


def test_the_stored_table_opens_in_another_catalog(spark, facts, table, tmp_path, rows):
    name, df = table
    again = stored.open_bucketed(spark, f"{name}_again", str(tmp_path / "facts"), COLUMNS, 5)
    try:
        whole = [c for c in facts.columns if c != "t_star_mo"]  # holds NaN
        assert rows(again, *whole) == rows(facts, *whole)
        assert "Exchange" not in _plan(temporal.expanding_mean(again, "delta_h"))
    finally:
        spark.sql(f"DROP TABLE {name}_again")


FEATURES = [
    "x", "y", "month_idx", "pixel_mean_delta_h", "delta_h_deviation", "surface_slope_change", "delta_h_momentum", "delta_h_rate", "delta_h_acceleration",
    "t_star_6mo_avg", "thermal_anomaly", "salinity_stratification_proxy", "lwe_trend", "mascon_mean_delta_h", "regional_delta_h_percentile",
]


def test_months_added_one_by_one_equal_one_run(spark, facts, tmp_path, rows):
    root, first = str(tmp_path / "monthly"), 24017
    history = facts.where(F.col("month_idx") <= first)
    stored.start(temporal.temporal_features(history), history, root, first)
    for month in range(first + 1, 24030):
        stored.add_month(facts.where(F.col("month_idx") == month), root, month, month - 1)
        if month % 4 == 0:  # a run that failed is done again
            stored.add_month(facts.where(F.col("month_idx") == month), root, month, month - 1)
    got = rows(spark.read.parquet(f"{root}/features"), *FEATURES)
    want = rows(temporal.temporal_features(facts), *FEATURES)
    assert len(got) == len(want) == facts.count()
    for a, b in zip(got, want):
        assert a == pytest.approx(b, nan_ok=True)


def test_a_month_that_is_known_or_mixed_is_an_error(spark, facts, tmp_path):
    root = str(tmp_path / "late")
    stored.start(temporal.temporal_features(facts), facts, root, 24029)
    with pytest.raises(ValueError):
        stored.add_month(facts.where("month_idx = 24010"), root, 24010, 24029)
    with pytest.raises(ValueError):
        stored.add_month(facts.withColumn("month_idx", F.col("month_idx") + 100), root, 24130, 24029)


def test_an_empty_month_keeps_the_state(spark, facts, tmp_path):
    root = str(tmp_path / "empty")
    stored.start(temporal.temporal_features(facts), facts, root, 24029)
    stored.add_month(facts.where("false"), root, 24030, 24029)
    state = spark.read.parquet(f"{root}/state")
    one, two = (state.where(F.col("upto") == u).drop("upto") for u in (24029, 24030))
    assert one.exceptAll(two).isEmpty() and two.count() == one.count() > 0
