"""Ice-geometry, ocean and interaction formulas: plain arithmetic inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Freezing-point slopes per PSU and per metre, sea-water density and heat capacity.
FREEZE_PER_PSU, FREEZE_PER_METRE = -0.057, -0.00076
WATER_DENSITY, HEAT_CAPACITY = 1027.0, 3985.0


def ice_geometry(df: DataFrame, surface: str = "surface", thickness: str = "thickness") -> DataFrame:
    """Ice base elevation, and the draft: depth of the base below sea level, never negative."""
    base = F.col(surface) - F.col(thickness)
    return df.withColumns({"ice_base": base, "ice_draft": F.when(base.isNotNull(), F.greatest(-base, F.lit(0.0)))})


def thickness_from_surface(df: DataFrame, surface: str = "surface", bed: str = "bed") -> DataFrame:
    return df.withColumn("thickness_derived", F.col(surface) - F.col(bed))


def dynamic_surface(df: DataFrame) -> DataFrame:
    return df.withColumn("h_surface_dynamic", F.col("surface") + F.col("delta_h"))


def dynamic_thickness(df: DataFrame) -> DataFrame:
    return df.withColumn("thickness_dynamic", F.col("thickness") + F.col("delta_h"))


def freezing_point(
    df: DataFrame,
    salinity: str = "so_mo",
    depth: str = "clamped_depth",
    a: float = FREEZE_PER_PSU,
    b: float = FREEZE_PER_METRE,
    c: float = 0.0,
) -> DataFrame:
    return df.withColumn("t_f_mo", F.lit(a) * F.col(salinity) + F.lit(b) * F.col(depth) + F.lit(c))


def thermal_driving(df: DataFrame, temperature: str = "thetao_mo") -> DataFrame:
    return df.withColumn("t_star_mo", F.col(temperature) - F.col("t_f_mo"))


def lwe_to_metres(df: DataFrame, source: str = "lwe_thickness_cm", target: str = "lwe_mo") -> DataFrame:
    return df.withColumn(target, F.col(source) / F.lit(100.0))


def _nearness(distance: str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.col(distance) / F.lit(1000.0))


def _below_sea(elevation: str) -> Column:
    return F.when(F.col(elevation).isNotNull(), F.greatest(-F.col(elevation), F.lit(0.0)))


def retrograde(df: DataFrame) -> DataFrame:
    """1 where the bed lies below the sea and falls inland; gradient components come from ``grid.slope``.

    The surface rises inland, so such a bed has a gradient opposed to the surface's.
    """
    along = F.col("surface_dx") * F.col("bed_dx") + F.col("surface_dy") * F.col("bed_dy")
    return df.withColumn("retrograde_flag", ((along < 0) & (F.col("bed") < 0)).cast("int"))


def physics_features(df: DataFrame) -> DataFrame:
    """All static-geometry and interaction features, the retrograde flag included unless already there."""
    flagged = df if "retrograde_flag" in df.columns else retrograde(df)
    return flagged.withColumns(
        {
            "thermal_driving_x_draft": F.col("t_star_mo") * F.col("ice_draft"),
            "draft_x_thermal_access": F.col("ice_draft") * _nearness("dist_to_ocean"),
            "grounding_line_vulnerability": _below_sea("bed") * _nearness("dist_to_grounding_line"),
            "ocean_heat_content_proxy": F.lit(WATER_DENSITY * HEAT_CAPACITY)
            * (F.col("thetao_mo") - F.col("t_f_mo"))
            * F.col("clamped_depth"),
            "draft_ratio": F.try_divide(F.col("ice_draft"), F.col("thickness")),
            "thermal_x_gl_proximity": F.col("t_star_mo") * _nearness("dist_to_grounding_line"),
            "freezing_departure": F.col("thetao_mo") - F.col("t_f_mo"),
            "bed_geometry_risk": F.col("retrograde_flag") * F.col("bed_slope") * _below_sea("bed"),
            "mass_flux_proxy": F.col("thickness") * F.col("surface_slope"),
        }
    )
