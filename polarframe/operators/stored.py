"""The stored fact table: laid out for pixel windows, and continued month by month.

Layout. ``write_bucketed`` keeps a folder per month, so filters on months prune, and deals every month's rows to the same buckets by
pixel. Windows and aggregates per pixel then read bucket by bucket: no exchange, however often features are computed.

Adding a month. All pixel features of a month follow from that month's rows and a few numbers per pixel: sums and counts of the running means, the last row's
values and the last months of the trailing mean. ``add_month`` joins the new rows to that state, writes the month's features over that
month alone, and writes the state up to it beside the older ones; so a run that fails in between is repeated without harm, and history is never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.functions.missing import is_floating, present
from polarframe.operators.temporal import PIXEL, group_mean, group_zscore, lwe_trend, momentum

#: Months of the trailing mean, the current one included.
TRAIL = 6
#: Columns with a running mean per pixel.
RUNNING = {"delta_h": "dh", "t_star_mo": "t", "so_mo": "so"}


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: list[str] = PIXEL) -> DataFrame:
    """``df`` as table ``name`` under ``path``: folders by month, buckets by pixel, sorted by pixel inside a file.

    Every task writes one bucket of all months, so there are as many files as months times buckets. A pixel has at most as many rows as there
    are months, so buckets are even. Choose ``buckets`` for the largest month: a few hundred megabytes a file. The key must be whole numbers or text
    (``cell_x``, ``cell_y`` of a pixel): Spark normalises floating-point keys before it compares them and can't use buckets of them.
    """
    floating = [k for k in key if is_floating(df, k)]
    if floating:
        raise ValueError(f"buckets by floating-point columns can't be used by windows: {floating}")
    dealt = df.repartition(buckets, *key)
    dealt.write.mode("overwrite").option("path", path).partitionBy("month_idx").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, columns: str, buckets: int, key: list[str] = PIXEL) -> DataFrame:
    """The same table in a new session, whose catalog does not know it; ``columns`` is its schema as DDL."""
    at = path.replace("\\", "\\\\").replace("'", "\\'")
    names = ", ".join(f"`{k}`" for k in key)
    spark.sql(
        f"CREATE TABLE `{name}` ({columns}) USING parquet PARTITIONED BY (month_idx) CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{at}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def _recent(values: Column, month: Column) -> Column:
    """Months that a trailing mean after ``month`` can still reach."""
    return F.filter(values, lambda r: r["m"] > month - F.lit(TRAIL - 1))


def state_of(history: DataFrame) -> DataFrame:
    """One row per pixel: what the features of the next month need to know of all months before it."""
    rows = momentum(history, "delta_h")
    parts = [c for name, short in RUNNING.items() for c in (F.sum(present(history, name).cast("double")).alias(f"s_{short}"), F.count(present(history, name)).alias(f"n_{short}"))]
    last = F.struct(present(history, "delta_h").alias("delta_h"), present(history, "surface_slope").alias("surface_slope"), F.col("delta_h_momentum").alias("momentum"))
    value = present(history, "t_star_mo").cast("double")
    months = F.collect_list(F.when(value.isNotNull(), F.struct(F.col("month_idx").alias("m"), value.alias("v"))))  # at most the months of a pixel
    found = rows.groupBy(*PIXEL).agg(F.max("month_idx").alias("month"), F.max_by(last, "month_idx").alias("last"), months.alias("recent"), *parts)
    return found.withColumn("recent", _recent(F.col("recent"), F.col("month"))).withColumns(
        {f"s_{s}": F.coalesce(f"s_{s}", F.lit(0.0)) for s in RUNNING.values()}
    )


def advance(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of one later month beside the state of their pixels: (the columns of ``rows``, ``_before``, ``_after``).

    Pixels without a row this month have NULL in the columns of ``rows`` and keep their state as ``_after``.
    """
    old = state.select(*PIXEL, F.struct(*[c for c in state.columns if c not in PIXEL]).alias("_before"))
    both = rows.join(old, PIXEL, "full")
    b, month = F.col("_before"), F.col("month_idx")
    fields = {"month": month}
    for name, short in RUNNING.items():
        value = present(rows, name).cast("double")
        fields[f"s_{short}"] = F.coalesce(b[f"s_{short}"], F.lit(0.0)) + F.coalesce(value, F.lit(0.0))
        fields[f"n_{short}"] = F.coalesce(b[f"n_{short}"], F.lit(0)) + value.isNotNull().cast("bigint")
    height, slope = present(rows, "delta_h"), present(rows, "surface_slope")
    step = F.when(month - b["month"] == 1, height - b["last"]["delta_h"])
    fields["last"] = F.struct(height.alias("delta_h"), slope.alias("surface_slope"), step.alias("momentum"))
    value = present(rows, "t_star_mo").cast("double")
    own = F.when(value.isNotNull(), F.array(F.struct(month.alias("m"), value.alias("v"))))
    nothing = F.array().cast(state.schema["recent"].dataType)
    fields["recent"] = _recent(F.concat(F.coalesce(b["recent"], nothing), F.coalesce(own.cast(state.schema["recent"].dataType), nothing)), month)
    order = state.drop(*PIXEL).columns
    after = F.struct(*[fields[c].cast(state.schema[c].dataType).alias(c) for c in order])
    return both.withColumn("_after", F.when(month.isNotNull(), after).otherwise(b))


def month_features(advanced: DataFrame, rows: DataFrame) -> DataFrame:
    """``temporal.temporal_features`` of the month's rows."""
    b, a, month = F.col("_before"), F.col("_after"), F.col("month_idx")
    mean = lambda short: F.try_divide(a[f"s_{short}"], a[f"n_{short}"].cast("double"))
    height = present(rows, "delta_h")
    step = height - b["last"]["delta_h"]
    nothing = F.array().cast(advanced.select("_after.recent").schema[0].dataType)
    trail = F.filter(F.concat(F.coalesce(b["recent"], nothing), F.filter(a["recent"], lambda r: r["m"] == month)), lambda r: r["m"] > month - F.lit(TRAIL))
    kept = advanced.where(month.isNotNull())
    out = kept.withColumns({
        "pixel_mean_delta_h": mean("dh"), "delta_h_deviation": F.col("delta_h") - mean("dh"),
        "surface_slope_change": present(rows, "surface_slope") - b["last"]["surface_slope"],
        "delta_h_momentum": a["last"]["momentum"],
        "delta_h_rate": F.try_divide(step, (month - b["month"]) / F.lit(12.0)),
        "delta_h_acceleration": F.when(month - b["month"] == 1, a["last"]["momentum"] - b["last"]["momentum"]),
        "t_star_6mo_avg": F.try_divide(F.aggregate(trail, F.lit(0.0), lambda s, r: s + r["v"]), F.size(trail).cast("double")),
        "thermal_anomaly": present(rows, "t_star_mo") - mean("t"),
        "salinity_stratification_proxy": present(rows, "so_mo") - mean("so"),
    }).drop("_before", "_after")
    out = group_mean(lwe_trend(out), ["mascon_id", "month_idx"], "delta_h")
    return group_zscore(out, ["regional_subset_id", "month_idx"], "delta_h")


def write_month(df: DataFrame, path: str, by: str) -> None:
    """Overwrite the folders of the months in ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def start(features: DataFrame, history: DataFrame, root: str, upto: int) -> None:
    """Store a table computed in one run and the state that continues it."""
    write_month(features, f"{root}/features", "month_idx")
    write_month(state_of(history).withColumn("upto", F.lit(upto)), f"{root}/state", "upto")


def add_month(rows: DataFrame, root: str, month: int, after: int) -> None:
    """Features of ``month`` from its rows and the state up to ``after``; both are written under ``root``.

    Rows of other months, or of pixels whose state is not older than the month, are an error.
    """
    spark = rows.sparkSession
    state = spark.read.parquet(f"{root}/state").where(F.col("upto") == after).drop("upto")
    advanced = advance(state, rows)
    late = advanced.where((F.col("month_idx") != month) | (F.col("_before.month") >= F.col("month_idx")))
    if not late.isEmpty():
        raise ValueError(f"rows of other months than {month}, or a state that already knows it")
    write_month(month_features(advanced, rows), f"{root}/features", "month_idx")
    write_month(advanced.select(*PIXEL, "_after.*").withColumn("upto", F.lit(month)), f"{root}/state", "upto")
