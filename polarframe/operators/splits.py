"""Leakage-free splits and resampling. Random choices hash row keys, so retries repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.operators.distribute import keyed_uniform, lookup_join, settle
from polarframe.operators.labels import LABEL

ROW_KEY = ["x", "y", "month_idx"]

# Training Apr 2020 - Dec 2022, validation Jan - Oct 2023, test from Nov 2023.
TRAIN_START, TRAIN_END, VAL_END = 2020 * 12 + 4, 2022 * 12 + 12, 2023 * 12 + 10


def temporal_split(df: DataFrame, train_end: int = TRAIN_END, val_end: int = VAL_END, train_start: int | None = None) -> DataFrame:
    """Column ``split``: train, val or test by month; months before ``train_start`` belong to none."""
    month = F.col("month_idx")
    split = F.when(month <= train_end, "train").when(month <= val_end, "val").otherwise("test")
    if train_start is not None:
        split = F.when(month >= train_start, split)
    return df.withColumn("split", F.when(month.isNotNull(), split))


def undersample(
    df: DataFrame,
    ratio: float = 10.0,
    seed: int = 42,
    label: str = LABEL,
    ratios: dict[str, float] | None = None,
    region: str = "regional_subset_id",
    key: list[str] = ROW_KEY,
) -> DataFrame:
    """Keep every positive and about ``ratio`` negatives per positive.

    With ``ratios`` the target is met inside every region, with ``ratio`` for regions not named; rows
    without a region are one more region. A region without positives keeps no negatives.
    """
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    wanted: Column = F.lit(float(ratio))
    for name, value in (ratios or {}).items():
        wanted = F.when(F.col(region) == name, F.lit(float(value))).otherwise(wanted)
    draw = keyed_uniform(key, seed)
    if ratios is None:
        share = df.agg(F.try_divide(positives * wanted, negatives)).scalar()
        # Draws lie below 1: where every negative is wanted none has to be hashed.
        return df.filter((F.col(label) == 1) | ((F.col(label) == 0) & ((share >= 1.0) | (draw < share))))
    shares = settle(df.groupBy(region).agg(positives.alias("_p"), negatives.alias("_n")))
    # NULL joins NULL: the value and whether there is one.
    named = {"_region": F.coalesce(F.col(region).cast("string"), F.lit("")), "_no_region": F.col(region).isNull()}
    shares = shares.withColumns(named).select(*named, F.try_divide(F.col("_p") * wanted, F.col("_n")).alias("_share"))
    kept = (F.col(label) == 1) | ((F.col(label) == 0) & (draw < F.col("_share")))
    return lookup_join(df.withColumns(named), shares, list(named)).filter(kept).select(*df.columns)


def oof_split(df: DataFrame, seed: int = 42, key: list[str] = ("x", "y")) -> tuple[DataFrame, DataFrame]:
    """Two halves by pixel, so that all months of a pixel are in one fold."""
    first = keyed_uniform(list(key), seed) < F.lit(0.5)
    return df.filter(first), df.filter(~first)


def expanding_folds(df: DataFrame, start: int, end: int, step: int = 3) -> DataFrame:
    """One row per (row, fold, role): train on months up to N, validate on the ``step`` months after.

    N runs from ``start`` in steps of ``step`` while a validation month is left before ``end``.
    For training use ``expanding_fold``, which filters one fold without multiplying rows.
    """
    folds = list(range(start, end, step))
    member = F.array(*[
        F.when(F.col("month_idx") <= n, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role")))
        .when(F.col("month_idx") <= min(n + step, end), F.struct(F.lit(i).alias("fold"), F.lit("val").alias("role")))
        for i, n in enumerate(folds)
    ])
    return df.select("*", F.explode(F.filter(member, lambda m: m.isNotNull())).alias("m")).select(
        *df.columns, "m.fold", "m.role"
    )


def expanding_fold(df: DataFrame, fold: int, start: int, end: int, step: int = 3) -> tuple[DataFrame, DataFrame]:
    """Train and validation months of one fold: two partition-pruned filters."""
    last = start + fold * step
    return df.filter(F.col("month_idx") <= last), df.filter(F.col("month_idx").between(last + 1, min(last + step, end)))


def region_fold(df: DataFrame, held_out: str, region: str = "regional_subset_id") -> tuple[DataFrame, DataFrame]:
    """Train on every other region (rows without a region included), validate on one."""
    inside = F.coalesce(F.col(region) == held_out, F.lit(False))
    return df.filter(~inside), df.filter(inside)


def region_folds(df: DataFrame, region: str = "regional_subset_id") -> DataFrame:
    """Sizes of the leave-one-region-out folds, from one count per region."""
    sizes = settle(df.groupBy(region).agg(F.count(F.lit(1)).alias("n_val")))
    total = sizes.agg(F.sum("n_val")).scalar()
    return sizes.filter(F.col(region).isNotNull()).select(
        F.col(region).alias("held_out"), (total - F.col("n_val")).alias("n_train"), "n_val"
    )
