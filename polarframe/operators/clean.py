"""Row filters, missing-value handling, sampling and simple column transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.functions.missing import is_missing, present
from polarframe.operators.distribute import keyed_uniform
from polarframe.sources.schemas import FLOATING_CLASSES, ICE_CLASSES


def floating_ice(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.filter(F.col(mask).isin(*FLOATING_CLASSES))


def season(df: DataFrame, year: int, months: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """Rows of some months of one year, as a list of month indices so that partitions prune."""
    return df.filter(F.col("month_idx").isin(*[year * 12 + m for m in months]))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows whose columns are neither NULL nor NaN."""
    return df.na.drop(subset=columns)


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Bernoulli sample; with a key the same rows are drawn whatever the partitioning."""
    if key:
        return df.filter(keyed_uniform(key, seed) < F.lit(fraction))
    return df.sample(fraction=fraction, seed=seed)


def drop_years(df: DataFrame, years: list[int]) -> DataFrame:
    """Leave years out of training, as month ranges so that partitions prune; rows without a month stay."""
    inside = [F.col("month_idx").between(y * 12 + 1, y * 12 + 12) for y in years]
    return df.filter(F.col("month_idx").isNull() | ~reduce(lambda a, b: a | b, inside)) if inside else df


def flag_and_fill(
    df: DataFrame, probe: str, columns: list[str], fill: float = 0.0, flag: str = "ocean_valid"
) -> DataFrame:
    """Indicator of a valid probe column, then a constant in place of missing values."""
    flagged = df.withColumn(flag, F.when(is_missing(df, probe), 0).otherwise(1))
    return flagged.withColumns(
        {c: F.coalesce(present(df, c), F.lit(fill).cast(df.schema[c].dataType)) for c in columns}
    )


def log1p_cols(df: DataFrame, columns: list[str]) -> DataFrame:
    """``log(1 + v)`` under ``log_<name>``; NULL where the logarithm does not exist."""
    return df.withColumns({f"log_{c}": F.when(present(df, c) > -1, F.log1p(c)) for c in columns})


def mask_indicators(df: DataFrame, mask: str = "mask") -> DataFrame:
    return df.withColumns(
        {f"is_{name}": F.when(F.col(mask) == value, 1).otherwise(0) for value, name in ICE_CLASSES.items()}
    )


def valid_range(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside the stated range become NULL."""
    return df.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in limits.items()})
