"""Fixed schemas and packing specifications of the source products and the fact table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(columns: dict[str, type]) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


# First generation of the fact table: nanosecond epoch, mostly float32.
V1 = _schema(
    {
        "time": LongType,
        "x": FloatType,
        "y": FloatType,
        "delta_h": FloatType,
        "misfit_rms": FloatType,
        "data_count": FloatType,
        "dhdt_lag1": FloatType,
        "ice_area": FloatType,
        "lwe_thickness_cm": DoubleType,
        "land_mask": FloatType,
        "ocean_mask": FloatType,
        "dist_to_ocean_km": FloatType,
        "so": DoubleType,
        "thetao": DoubleType,
        "depth": FloatType,
        "mask": FloatType,
        "surface_topography": FloatType,
        "bed_topography": FloatType,
        "ice_thickness": FloatType,
    }
)

STATIC_FIELDS = ["surface", "bed", "thickness", "bed_slope", "dist_to_grounding_line", "clamped_depth", "dist_to_ocean", "ice_draft"]
OCEAN_FIELDS = ["thetao_mo", "t_star_mo", "so_mo", "t_f_mo"]
OCEAN_QUARTERLY = ["t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg", "thetao_quarterly_std"]
MASS_FIELDS = ["lwe_mo", "lwe_quarterly_avg", "lwe_quarterly_std", "lwe_fused"]

# Second generation: the fused pixel-month table, with the two dimension columns at the end.
V2 = _schema(
    {"y": DoubleType, "x": DoubleType, "exact_time": TimestampType, "month_idx": IntegerType, "mascon_id": IntegerType}
    | dict.fromkeys(STATIC_FIELDS, FloatType)
    | dict.fromkeys(["delta_h", "ice_area", "surface_slope", "h_surface_dynamic"], FloatType)
    | dict.fromkeys([*OCEAN_FIELDS, *OCEAN_QUARTERLY, *MASS_FIELDS], FloatType)
    | {"ice_mask": IntegerType, "regional_subset_id": StringType}
)


@dataclass(frozen=True)
class PackSpec:
    """How a packed integer column is decoded; the range is on the packed values."""

    fill: int
    scale: float = 1.0
    offset: float = 0.0
    valid_min: int | None = None
    valid_max: int | None = None


# Packing attributes of the ocean and topography products.
OCEAN_PACKING = {
    "thetao": PackSpec(fill=-32767, scale=0.000732444226741791, offset=21.0, valid_min=-32767, valid_max=22600),
    "so": PackSpec(fill=-32767, scale=0.00152592547237873, offset=-0.00152592547237873, valid_min=1, valid_max=31700),
}
TOPOGRAPHY_PACKING = dict.fromkeys(
    [
        "surface_topography",
        "bed_topography",
        "bed_uncertainty",
        "mask",
        "ice_thickness",
        "thickness_survey_count",
        "thickness_uncertainty",
    ],
    PackSpec(fill=-9999),
)

# The ice classes of the topography mask.
ICE_CLASSES = {1: "grounded", 2: "transient", 3: "floating", 4: "rock"}
FLOATING_CLASSES = (2, 3)
