"""Per-pixel temporal memory and neighbourhood context.

Pixel windows expect one row per (pixel, month), see ``fusion.to_pixel_months``; a window then holds
at most as many rows as there are months. All of them share one partitioning and ordering, so Spark
shuffles and sorts the table once for the whole feature set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from polarframe.functions.calendar import month_of, year_of
from polarframe.functions.missing import present
from polarframe.operators.distribute import with_group_stats

PIXEL = ["x", "y"]


def pixel_window(key: list[str] = PIXEL) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("month_idx")


def _running_mean(df: DataFrame, name: str, key: list[str]) -> Column:
    return F.avg(present(df, name)).over(pixel_window(key).rowsBetween(Window.unboundedPreceding, 0))


def _consecutive(key: list[str]) -> Column:
    return F.col("month_idx") - F.lag("month_idx").over(pixel_window(key)) == 1


def expanding_mean(df: DataFrame, name: str, key: list[str] = PIXEL, out: str | None = None) -> DataFrame:
    """Mean of all months up to and including the current one: no look-ahead."""
    return df.withColumn(out or f"pixel_mean_{name}", _running_mean(df, name, key))


def deviation(df: DataFrame, name: str, key: list[str] = PIXEL, out: str | None = None) -> DataFrame:
    """Value minus the pixel's expanding mean."""
    return df.withColumn(out or f"{name}_deviation", present(df, name) - _running_mean(df, name, key))


def lag_diff(df: DataFrame, name: str, key: list[str] = PIXEL, out: str | None = None) -> DataFrame:
    """Value minus the previous row of the pixel, whatever the gap."""
    value = present(df, name)
    return df.withColumn(out or f"{name}_change", value - F.lag(value).over(pixel_window(key)))


def momentum(df: DataFrame, name: str, key: list[str] = PIXEL) -> DataFrame:
    """Change against the previous calendar month; NULL across a gap."""
    value = present(df, name)
    step = value - F.lag(value).over(pixel_window(key))
    return df.withColumn(f"{name}_momentum", F.when(_consecutive(key), step))


def rate(df: DataFrame, name: str, key: list[str] = PIXEL) -> DataFrame:
    """Change against the previous row per year of elapsed time."""
    value, window = present(df, name), pixel_window(key)
    years = (F.col("month_idx") - F.lag("month_idx").over(window)) / F.lit(12.0)
    return df.withColumn(f"{name}_rate", F.try_divide(value - F.lag(value).over(window), years))


def acceleration(df: DataFrame, name: str, key: list[str] = PIXEL) -> DataFrame:
    """Change of the momentum between consecutive months."""
    step = f"{name}_momentum"
    with_step = df if step in df.columns else momentum(df, name, key)
    change = F.col(step) - F.lag(step).over(pixel_window(key))
    out = with_step.withColumn(f"{name}_acceleration", F.when(_consecutive(key), change))
    return out if step in df.columns else out.drop(step)


def trailing_mean(df: DataFrame, name: str, months: int, key: list[str] = PIXEL, out: str | None = None) -> DataFrame:
    """Mean over the last ``months`` calendar months, the current one included."""
    window = pixel_window(key).rangeBetween(-(months - 1), 0)
    label = out or f"{name.removesuffix('_mo')}_{months}mo_avg"
    return df.withColumn(label, F.avg(present(df, name)).over(window))


def lwe_trend(df: DataFrame) -> DataFrame:
    return df.withColumn("lwe_trend", F.col("lwe_mo") - F.col("lwe_quarterly_avg"))


def group_mean(df: DataFrame, keys: list[str], name: str, out: str | None = None) -> DataFrame:
    """Mean of the row's group, e.g. of all pixels of a gravity cell in the same month."""
    return with_group_stats(df, keys, [F.avg(present(df, name)).alias(out or f"mascon_mean_{name}")])


def group_zscore(df: DataFrame, keys: list[str], name: str, out: str | None = None) -> DataFrame:
    """Standardised position inside the row's group; NULL where the group has no spread."""
    value = present(df, name)
    joined = with_group_stats(df, keys, [F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd")])
    score = F.try_divide(value - F.col("_mu"), F.col("_sd"))
    return joined.withColumn(out or f"regional_{name}_percentile", score).drop("_mu", "_sd")


def seasonal_metrics(df: DataFrame, name: str, key: list[str] = PIXEL) -> DataFrame:
    """Seasonal amplitude per pixel and interannual anomaly per (pixel, year).

    Month-of-year means, yearly means and the overall mean come from the same partial sums: the
    table is aggregated once to (pixel, year, month of year) and never joined to itself in full.
    """
    value = present(df, name).cast("double")
    partial = df.groupBy(*key, year_of(F.col("month_idx")).alias("year"), month_of(F.col("month_idx")).alias("moy")).agg(
        F.sum(value).alias("s"), F.count(value).alias("n")
    )
    mean = F.try_divide(F.sum("s"), F.sum("n"))
    # Bounded windows: a pixel has as many rows as (year, month) pairs.
    seasonal = partial.groupBy(*key, "moy").agg(mean.alias("m")).groupBy(*key).agg((F.max("m") - F.min("m")).alias("seasonal_amplitude"))
    yearly = partial.groupBy(*key, "year").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = Window.partitionBy(*key)
    anomaly = F.try_divide(F.col("s"), F.col("n")) - F.try_divide(F.sum("s").over(whole), F.sum("n").over(whole))
    return yearly.select(*key, "year", anomaly.alias("interannual_anomaly")).join(seasonal, list(key))


def temporal_features(df: DataFrame, key: list[str] = PIXEL) -> DataFrame:
    """All pixel-window and context features of the fused table."""
    out = expanding_mean(df, "delta_h", key)
    out = out.withColumn("delta_h_deviation", F.col("delta_h") - F.col("pixel_mean_delta_h"))
    out = lag_diff(out, "surface_slope", key)
    out = acceleration(rate(momentum(out, "delta_h", key), "delta_h", key), "delta_h", key)
    out = trailing_mean(out, "t_star_mo", 6, key)
    out = deviation(out, "t_star_mo", key, out="thermal_anomaly")
    out = deviation(out, "so_mo", key, out="salinity_stratification_proxy")
    out = lwe_trend(out)
    out = group_mean(out, ["mascon_id", "month_idx"], "delta_h")
    return group_zscore(out, ["regional_subset_id", "month_idx"], "delta_h")
