"""The reference questions: regimes, mass-change regression, explained share, geometry-mass coupling."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarframe.functions.calendar import cyclic_month
from polarframe.functions.missing import present
from polarframe.functions.projection import to_geographic
from polarframe.ml.evaluate import importances
from polarframe.operators.distribute import settle
from polarframe.operators.temporal import PIXEL, seasonal_metrics

REGIME_FEATURES = ["dh_dt", "seasonal_amplitude", "mean_slope", "lat"]


def regime_features(df: DataFrame, slope: str = "surface_slope") -> DataFrame:
    """Per pixel: trend in metres per year, seasonal amplitude, mean slope, latitude."""
    height = present(df, "delta_h").cast("double")
    trend = df.groupBy(*PIXEL).agg(
        (F.regr_slope(height, F.col("month_idx").cast("double")) * 12.0).alias("dh_dt"),
        F.avg(present(df, slope)).alias("mean_slope"),
    )
    seasonal = seasonal_metrics(df, "delta_h").groupBy(*PIXEL).agg(F.max("seasonal_amplitude").alias("seasonal_amplitude"))
    return to_geographic(trend.join(seasonal, PIXEL)).drop("lon")


def regimes(df: DataFrame, k: int = 4, slope: str = "surface_slope") -> DataFrame:
    """Elevation-change regimes by k-means on standardised pixel features; NULL for pixels that lack one."""
    table = settle(regime_features(df, slope))
    stages = [
        VectorAssembler(inputCols=REGIME_FEATURES, outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        KMeans(k=k, seed=42, featuresCol="features", predictionCol="regime"),
    ]
    placed = Pipeline(stages=stages).fit(table).transform(table).select(*PIXEL, "regime", "features")
    return table.select(*PIXEL, *REGIME_FEATURES).join(placed, PIXEL, "left")


MASS_FEATURES = ["delta_h", "dh_rate", "dh_lag1", "dh_lag2", "dh_lag3", "dh_anomaly", "sin_month", "cos_month", "mean_x", "mean_y"]


def mascon_months(df: DataFrame, lags: int = 3) -> DataFrame:
    """Per (mascon, month): mean height change, its lags, rate and anomaly, season, position, mass change.

    The pixel table is aggregated once; all windows then run on one row per mascon and month.
    """
    base = df.groupBy("mascon_id", "month_idx").agg(
        F.avg(present(df, "delta_h")).alias("delta_h"), F.avg(present(df, "lwe_mo")).alias("lwe"),
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"),
    )
    months = Window.partitionBy("mascon_id").orderBy("month_idx")
    at = lambda name, back: F.max(name).over(months.rangeBetween(-back, -back))
    so_far = F.avg("delta_h").over(months.rowsBetween(Window.unboundedPreceding, 0))
    lagged = base.withColumns(
        {f"dh_lag{i}": at("delta_h", i) for i in range(1, lags + 1)}
        | {"dh_rate": (F.col("delta_h") - at("delta_h", 1)) * 12.0, "dh_anomaly": F.col("delta_h") - so_far, "mass_change": F.col("lwe") - at("lwe", 1)}
    )
    return cyclic_month(lagged)


def mass_regression(df: DataFrame, algo: str = "gbt", train_end: int | None = None, **params):
    """Fit monthly mass change per mascon from elevation; returns (model, predictions on all months).

    Months with all features and a mass change are learnt from; the prediction is NULL where a feature is missing.
    """
    months = settle(mascon_months(df))
    table = months.na.drop(subset=MASS_FEATURES)
    kinds = {"gbt": GBTRegressor, "rf": RandomForestRegressor}
    learner = kinds[algo](featuresCol="features", labelCol="mass_change", seed=42, **params)
    stages = [VectorAssembler(inputCols=MASS_FEATURES, outputCol="features"), learner]
    known = table.na.drop(subset=["mass_change"])
    train = known if train_end is None else known.filter(F.col("month_idx") <= train_end)
    model = Pipeline(stages=stages).fit(train)
    predicted = model.transform(table).select("mascon_id", "month_idx", "features", "prediction")
    return model, months.join(predicted, ["mascon_id", "month_idx"], "left")


def grouped_r2(df: DataFrame, keys: list[str], target: str, prediction: str) -> DataFrame:
    """Explained share of variance per group, from sums of one pass."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    residual, spread = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return df.filter(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(
        (F.lit(1.0) - F.try_divide(residual, spread)).alias("r2"), F.count(F.lit(1)).alias("n")
    )


def mass_skill(df: DataFrame, algo: str = "gbt", train_end: int | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """(R2 per mascon, ranked feature importances) of the mass-change regression."""
    model, predicted = mass_regression(df, algo, train_end, **params)
    return grouped_r2(predicted, ["mascon_id"], "mass_change", "prediction"), importances(df.sparkSession, model.stages[-1], MASS_FEATURES)


def coupling(df: DataFrame, lags: list[int] = (-2, -1, 0, 1, 2)) -> DataFrame:
    """Correlation of height change with mass ``lag`` months later, per mascon."""
    base = df.groupBy("mascon_id", "month_idx").agg(
        F.avg(present(df, "delta_h")).alias("dh"), F.avg(present(df, "lwe_mo")).alias("lwe")
    )
    months = Window.partitionBy("mascon_id").orderBy("month_idx")
    names = {lag: f"lwe_{i}" for i, lag in enumerate(lags)}
    shifted = base.withColumns({n: F.max("lwe").over(months.rangeBetween(lag, lag)) for lag, n in names.items()})
    pair = lambda n: F.struct(F.corr("dh", n).alias("r"), F.count(F.when(F.col("dh").isNotNull(), F.col(n))).alias("n"))
    wide = shifted.groupBy("mascon_id").agg(*[pair(n).alias(n) for n in names.values()])
    rows = [F.struct(F.lit(lag).alias("lag"), F.col(f"{n}.r").alias("r"), F.col(f"{n}.n").alias("n")) for lag, n in names.items()]
    return wide.select("mascon_id", F.inline(F.array(*rows)))
