"""Reading the fact table and decoding long-form source tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polarframe.sources.schemas import V2, PackSpec


def read_observations(spark: SparkSession, path: str, schema: StructType = V2) -> DataFrame:
    """Parquet with an explicit schema: no inference job, and int64 nanoseconds stay readable."""
    return spark.read.schema(schema).parquet(path)


def _decoded(name: str, spec: PackSpec) -> Column:
    raw = F.col(name)
    valid = raw != F.lit(spec.fill)
    if spec.valid_min is not None:
        valid = valid & (raw >= F.lit(spec.valid_min))
    if spec.valid_max is not None:
        valid = valid & (raw <= F.lit(spec.valid_max))
    return F.when(valid, raw * F.lit(spec.scale) + F.lit(spec.offset))


def decode_packed(df: DataFrame, specs: dict[str, PackSpec]) -> DataFrame:
    """Fill sentinel and out-of-range packed values become NULL, the rest is scaled and offset."""
    return df.withColumns({name: _decoded(name, spec) for name, spec in specs.items()})


def union_tiles(tiles: dict[str, DataFrame]) -> DataFrame:
    """Stack the altimetry tiles, keeping the tile name as provenance."""
    tagged = [frame.withColumn("tile", F.lit(name)) for name, frame in tiles.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
