"""From gridded source tables to the wide pixel-month fact table (schema V2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.functions.calendar import cyclic_month
from polarframe.functions.physics import (
    dynamic_surface,
    freezing_point,
    ice_geometry,
    lwe_to_metres,
    physics_features,
    retrograde,
    thermal_driving,
)
from polarframe.functions.projection import cell_of
from polarframe.operators.distribute import require_unique, scratch_path, settle
from polarframe.operators.fusion import (
    assign_mascon,
    assign_region,
    clamp_depth,
    disaggregate_mass,
    join_monthly,
    join_static,
    quarterly_stats,
    sample_at_depth,
)
from polarframe.operators.grid import CELL, nearest_distance, slope
from polarframe.operators.temporal import temporal_features
from polarframe.sources.schemas import FLOATING_CLASSES, V2
from polarframe.sources.sinks import materialize

OCEAN_CELL = ["ocean_x", "ocean_y"]


def with_ocean_cell(df: DataFrame, cell: float, ocean_cell: float) -> DataFrame:
    """Coarse ocean cell under the centre of every fine cell."""
    centre = lambda c: (F.col(c) + F.lit(0.5)) * F.lit(float(cell))
    return df.withColumns({"ocean_x": cell_of(centre("cell_x"), ocean_cell), "ocean_y": cell_of(centre("cell_y"), ocean_cell)})


def static_fields(
    topography: DataFrame, ocean: DataFrame, cell: float = 500.0, ocean_cell: float = 8000.0,
    grounding: Column | None = None, open_ocean: Column | None = None,
) -> DataFrame:
    """Topography per cell with slopes, distances, draft and clamped depth; settled, one row per cell.

    The grounding line is the transient class of the mask, and cells without a class are ocean,
    unless other predicates are given.
    """
    lines = topography.filter(F.col("mask") == 2 if grounding is None else grounding)
    water = topography.filter(F.col("mask").isNull() if open_ocean is None else open_ocean)
    leaning = slope(slope(topography, "bed", cell), "surface", cell).drop("surface_slope")
    land = with_ocean_cell(ice_geometry(retrograde(leaning)), cell, ocean_cell)
    land = clamp_depth(land, ocean.withColumnRenamed("thetao", "value"), OCEAN_CELL)
    land = nearest_distance(settle(land), lines, cell, out="dist_to_grounding_line")
    return settle(nearest_distance(land, water, cell, out="dist_to_ocean"))


def observation_table(
    altimetry: DataFrame, topography: DataFrame, gravity: DataFrame, ocean: DataFrame, mascon_map: DataFrame, region_map: DataFrame,
    cell: float = 500.0, ocean_cell: float = 8000.0, keep: list[str] = (), check_grain: bool = True,
) -> DataFrame:
    """The fused pixel-month table with the columns and types of ``V2``, and the static columns in ``keep``.

    altimetry: cell_x, cell_y, x, y, exact_time, month_idx, delta_h, ice_area; one row per cell and month.
    topography: cell_x, cell_y, surface, bed, thickness, mask. gravity: mascon_id, month_idx,
    lwe_thickness_cm. ocean: ocean_x, ocean_y, month_idx, depth, thetao, so on its coarse grid.
    Ocean values exist under floating ice only and are taken at the clamped depth of the ice base.
    ``check_grain`` counts the keys of every input first: a doubled one would multiply rows in a join or mix two pixels in a window, so it is an error
    (``fusion.to_pixel_months`` makes the grain of the altimetry).
    """
    if check_grain:
        require_unique(altimetry, [*CELL, "month_idx"], "altimetry")
        require_unique(topography, CELL, "topography")
        require_unique(gravity, ["mascon_id", "month_idx"], "gravity")
        require_unique(ocean, [*OCEAN_CELL, "month_idx", "depth"], "ocean")
        require_unique(mascon_map, CELL, "mascon_map")
        require_unique(region_map, ["mascon_id"], "region_map")
    static = static_fields(topography, ocean, cell, ocean_cell)
    kept = [*keep, *CELL, "surface", "bed", "thickness", "mask", "bed_slope", "dist_to_grounding_line", "dist_to_ocean", "ice_draft", "clamped_depth", *OCEAN_CELL]
    wide = assign_region(assign_mascon(altimetry, mascon_map), region_map)
    wide = join_monthly(wide, lwe_to_metres(gravity).drop("lwe_thickness_cm"), ["mascon_id"])
    wide = join_static(wide, static.select(*kept), keys_from=altimetry)
    wide = dynamic_surface(wide)
    afloat = F.col("mask").isin(*FLOATING_CLASSES)
    wide = sample_at_depth(wide, ocean, [*OCEAN_CELL, "month_idx"], columns={"thetao_mo": "thetao", "so_mo": "so"})
    wide = wide.withColumns({name: F.when(afloat, F.col(name)) for name in ("thetao_mo", "so_mo")})
    wide = slope(wide, "h_surface_dynamic", cell, by=["month_idx"], prefix="surface")
    wide = quarterly_stats(thermal_driving(freezing_point(wide)), ["t_star_mo", "thetao_mo", "lwe_mo"])
    # The one full write of the fact table, as Parquet: the group means below read three of its columns.
    wide = materialize(wide, scratch_path(wide.sparkSession, "observations"))
    wide = disaggregate_mass(wide).withColumn("ice_mask", F.col("mask"))
    return wide.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in V2.fields], *keep)


def feature_table(observations: DataFrame) -> DataFrame:
    """All engineered features of a fact table that carries ``retrograde_flag``.

    Pixel windows first: they share one shuffle, and everything after them is joined or computed in place.
    """
    return physics_features(cyclic_month(temporal_features(observations)))
