"""Joining altimetry, topography, gravity and ocean tables into one pixel-month table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarframe.functions.missing import present
from polarframe.functions.physics import dynamic_surface, freezing_point, ice_geometry, thermal_driving
from polarframe.operators.distribute import lookup_join, settle, with_group_stats
from polarframe.operators.grid import CELL


def join_static(obs: DataFrame, topography: DataFrame, keys_from: DataFrame | None = None) -> DataFrame:
    """Topography onto observations by cell; cells without topography keep NULLs."""
    return lookup_join(obs, topography, CELL, keys_from=keys_from)


def assign_mascon(points: DataFrame, master_map: DataFrame, key: list[str] = CELL) -> DataFrame:
    """Gravity cell of every point from the master map (key columns, mascon_id)."""
    return lookup_join(points, master_map.select(*key, "mascon_id"), list(key))


def assign_region(points: DataFrame, region_map: DataFrame, key: list[str] = ("mascon_id",)) -> DataFrame:
    """Named basin of every point from a map (key columns, regional_subset_id)."""
    return lookup_join(points, region_map.select(*key, "regional_subset_id"), list(key))


def join_monthly(obs: DataFrame, monthly: DataFrame, keys: list[str], keys_from: DataFrame | None = None) -> DataFrame:
    """A monthly product onto observations by key and month."""
    return lookup_join(obs, monthly, [*keys, "month_idx"], keys_from=keys_from)


def clamp_depth(df: DataFrame, ocean: DataFrame, keys: list[str] = CELL, draft: str = "ice_draft") -> DataFrame:
    """Draft limited to the deepest level at which the ocean column has a value."""
    floor = settle(ocean.filter(present(ocean, "value").isNotNull()).groupBy(*keys).agg(F.max("depth").alias("_floor")))
    deepest = F.when(F.col("_floor").isNotNull(), F.least(F.col(draft), F.col("_floor")))
    return lookup_join(df, floor, list(keys)).withColumn("clamped_depth", deepest).drop("_floor")


def sample_at_depth(
    points: DataFrame,
    ocean: DataFrame,
    keys: list[str] = (*CELL, "month_idx"),
    depth: str = "clamped_depth",
    mode: str = "nearest",
    out: str = "value_at_depth",
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """Ocean value at each point's depth: nearest level, or linear between the two around it.

    ``columns`` names the ocean column of every result; without it, ``value`` gives ``out``. The levels
    of a column of water are gathered into one array, with all values of a level side by side, so each
    point is joined once to one row whatever the number of columns. Levels are averaged first, so the
    array is as long as the product's depth axis (tens of levels) however many rows come in. A level without
    a value does not count for that column. Outside the levels the linear mode takes the end value;
    equally near levels resolve to the shallower one.
    """
    if mode not in ("nearest", "linear"):
        raise ValueError(f"unknown mode {mode}")
    columns = columns or {out: "value"}
    means = [F.avg(present(ocean, c)).alias(f"v{i}") for i, c in enumerate(columns.values())]
    level = F.struct(F.col("depth").cast("double").alias("d"), *[f"v{i}" for i in range(len(columns))])
    levels = settle(
        ocean.filter(F.col("depth").isNotNull()).groupBy(*keys, "depth").agg(*means)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("_levels"))
    )
    deepest = levels.agg(F.max(F.size("_levels"))).first()[0] or 0
    joined = lookup_join(points, levels, list(keys), width=len(keys) + (1 + len(columns)) * deepest)
    at = F.col(depth).cast("double")

    def picked(i: int) -> Column:
        known = F.filter("_levels", lambda s: s[f"v{i}"].isNotNull())
        if mode == "nearest":
            away = F.transform(known, lambda s: F.struct(F.abs(s.d - at).alias("gap"), s.d.alias("d"), s[f"v{i}"].alias("v")))
            return F.when(at.isNotNull(), F.array_min(away).v)
        pairs = F.transform(known, lambda s: F.struct(s.d.alias("d"), s[f"v{i}"].alias("v")))
        above = F.array_max(F.filter(pairs, lambda s: s.d <= at))
        below = F.array_min(F.filter(pairs, lambda s: s.d >= at))
        share = F.coalesce(F.try_divide(at - above.d, below.d - above.d), F.lit(0.0))
        return F.coalesce(above.v + (below.v - above.v) * share, above.v, below.v)

    return joined.withColumns({name: picked(i) for i, name in enumerate(columns)}).drop("_levels")


def monthly_ocean(df: DataFrame, columns: list[str] = ("thetao", "so"), keys: list[str] = CELL) -> DataFrame:
    """Monthly mean of ocean columns under ``<name>_mo``."""
    return df.groupBy(*keys, "month_idx").agg(*[F.avg(present(df, c)).alias(f"{c}_mo") for c in columns])


def quarterly_stats(df: DataFrame, columns: list[str], key: list[str] = ("x", "y")) -> DataFrame:
    """Rolling three-month mean and standard deviation, over calendar months, not rows.

    One row per (key, month): a window holds no more rows than there are months.
    """
    window = Window.partitionBy(*key).orderBy("month_idx").rangeBetween(-2, 0)
    names = {c: c.removesuffix("_mo") for c in columns}
    return df.withColumns(
        {f"{n}_quarterly_avg": F.avg(present(df, c)).over(window) for c, n in names.items()}
        | {f"{n}_quarterly_std": F.stddev_samp(present(df, c)).over(window) for c, n in names.items()}
    )


def disaggregate_mass(df: DataFrame, mass: str = "lwe_mo", change: str = "delta_h") -> DataFrame:
    """Spread a gravity cell's monthly mass over its pixels in proportion to |height change|.

    The mean over the pixels of a gravity cell stays the cell's value; no change at all gives NULL.
    """
    size = F.abs(present(df, change))
    weighed = with_group_stats(df, ["mascon_id", "month_idx"], [F.avg(size).alias("_mean_change")])
    fused = F.col(mass) * F.try_divide(F.abs(present(df, change)).cast("double"), F.col("_mean_change"))
    return weighed.withColumn("lwe_fused", fused).drop("_mean_change")


def calendar_gaps(df: DataFrame, key: list[str], start: int, end: int) -> DataFrame:
    """Months in [start, end] a key has no row for.

    The months seen by a key are a set inside a calendar of fixed length, so one aggregation with
    map-side combine replaces building and anti-joining a key x month spine.
    """
    inside = F.when(F.col("month_idx").between(start, end), F.col("month_idx").cast("int"))
    seen = df.groupBy(*key).agg(F.collect_set(inside).alias("seen"))
    calendar = F.sequence(F.lit(start), F.lit(end))
    return seen.select(*key, F.explode(F.array_except(calendar, "seen")).alias("month_idx"))


def height_rate(df: DataFrame, months: int, value: str = "delta_h", key: list[str] = ("x", "y"), out: str | None = None) -> DataFrame:
    """Change against the same pixel exactly ``months`` earlier, per year; NULL if that month is absent.

    A one-month range frame shares the pixel window's shuffle with the other temporal features,
    where a self-join would shuffle both sides again.
    """
    window = Window.partitionBy(*key).orderBy("month_idx").rangeBetween(-months, -months)
    before = F.max(present(df, value)).over(window)
    name = out or {3: "dhdt_lag1", 12: "dhdt_lag4"}.get(months, f"rate_{months}mo")
    return df.withColumn(name, (present(df, value) - before) / F.lit(months / 12.0))


def to_pixel_months(df: DataFrame, measures: list[str], key: list[str] = ("x", "y")) -> DataFrame:
    """Mean of every measure per (pixel, month): the grain all pixel windows rely on.

    Partial aggregation collapses repeated rows before the shuffle, so a pixel that holds a large
    share of the raw rows arrives as one row per month.
    """
    return df.groupBy(*key, "month_idx").agg(*[F.avg(present(df, m)).alias(m) for m in measures])


def fuse(
    altimetry: DataFrame,
    topography: DataFrame,
    gravity: DataFrame,
    ocean: DataFrame,
    mascon_map: DataFrame,
    region_map: DataFrame,
) -> DataFrame:
    """The wide pixel-month table.

    Inputs: altimetry (x, y, cell_x, cell_y, month_idx, delta_h, ...), topography per cell
    (surface, bed, thickness, clamped_depth), gravity per (mascon_id, month_idx) with lwe_mo, ocean per
    (cell, month_idx) with thetao_mo and so_mo, and the two maps.
    """
    # Hot cells are looked for in the altimetry itself, so no join runs again to find them.
    wide = assign_region(assign_mascon(altimetry, mascon_map), region_map)
    wide = join_monthly(wide, gravity, ["mascon_id"])
    wide = join_static(wide, topography, keys_from=altimetry)
    wide = join_monthly(wide, ocean, CELL, keys_from=altimetry)
    wide = thermal_driving(freezing_point(dynamic_surface(ice_geometry(wide))))
    wide = quarterly_stats(wide, ["t_star_mo", "thetao_mo", "lwe_mo"])
    return disaggregate_mass(wide)
