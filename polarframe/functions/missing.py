"""Missing values: NULL and NaN for floating columns, NULL for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (FloatType, DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def is_missing(df: DataFrame, name: str) -> Column:
    absent = F.col(name).isNull()
    return absent | F.isnan(name) if is_floating(df, name) else absent


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that aggregates skip it."""
    if is_floating(df, name):
        return F.nanvl(F.col(name), F.lit(None).cast(df.schema[name].dataType))
    return F.col(name)
