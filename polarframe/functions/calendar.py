"""Time axes: epochs of the source products, month index, cyclic encodings."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Epoch and seconds per unit of the two source time axes.
GRAVITY_EPOCH, SECONDS_PER_DAY = "2002-01-01 00:00:00", 86400
OCEAN_EPOCH, SECONDS_PER_HOUR = "1950-01-01 00:00:00", 3600


def with_date_from_ns(df: DataFrame, name: str = "time") -> DataFrame:
    """Replace an int64 nanosecond epoch by its UTC date."""
    # Whole-number division: nanosecond counts do not fit a double exactly.
    seconds = F.expr(f"(`{name}` - pmod(`{name}`, 1000000000)) div 1000000000")
    return df.withColumn(name, F.to_date(F.timestamp_seconds(seconds)))


def decode_cf_time(df: DataFrame, name: str, unit_seconds: int, epoch: str) -> DataFrame:
    """Replace a count of units since an epoch by ``exact_time`` and ``month_idx``."""
    start = datetime.fromisoformat(epoch).replace(tzinfo=timezone.utc).timestamp()
    moment = F.timestamp_seconds(F.lit(start) + F.col(name).cast("double") * F.lit(unit_seconds))
    return df.withColumn("exact_time", moment).drop(name).withColumn("month_idx", month_index(F.col("exact_time")))


def month_index(moment: Column) -> Column:
    """``year * 12 + month`` as an int; December 2019 is 24240."""
    return (F.year(moment) * 12 + F.month(moment)).cast("int")


def month_idx(df: DataFrame, moment: str) -> DataFrame:
    return df.withColumn("month_idx", month_index(F.col(moment)))


def year_of(index: Column) -> Column:
    return F.floor((index - 1) / 12).cast("int")


def month_of(index: Column) -> Column:
    """Month of year; ``index - 1`` because December would otherwise be month 0."""
    return (F.pmod(index - 1, F.lit(12)) + 1).cast("int")


def with_year_month(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": year_of(F.col("month_idx")), "month_of_year": month_of(F.col("month_idx"))})


def cyclic_month(df: DataFrame) -> DataFrame:
    """Month of year on the unit circle, so that December and January are neighbours."""
    angle = month_of(F.col("month_idx")) * F.lit(2 * math.pi / 12)
    return df.withColumns({"sin_month": F.sin(angle), "cos_month": F.cos(angle)})


def cyclic_doy(df: DataFrame, moment: str = "exact_time") -> DataFrame:
    angle = F.dayofyear(moment) * F.lit(2 * math.pi / 365.25)
    return df.withColumns({"sin_doy": F.sin(angle), "cos_doy": F.cos(angle)})
