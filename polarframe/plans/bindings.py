"""The given tables as observation, grid, ocean-profile, point and score tables.

Every binding has a DataFrame form and the same thing as a SQL common table expression. Measures
are whole numbers on purpose: sums and means of whole numbers do not depend on the order in which
a cluster adds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.functions.calendar import month_index
from polarframe.operators.distribute import lookup_join

GRID_WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(column: Column) -> Column:
    return F.round(column).cast("bigint")


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier, mascon and region names; Catalyst sizes the scans of nations and regions itself."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("x"), F.col("s_nationkey").alias("y"), F.col("s_nationkey").alias("mascon_id"),
            F.col("r_name").alias("regional_subset_id"), "s_acctbal",
        )
    )


BASINS = """basins as (
  select s_suppkey as x, s_nationkey as y, s_nationkey as mascon_id, r_name as regional_subset_id, s_acctbal
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (pixel, month): aggregated to that grain before the basins are looked up."""
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("x"), month_index(F.col("l_shipdate")).alias("month_idx"))
        .agg(
            F.count(F.lit(1)).alias("n_obs"),
            F.sum(_whole(F.col("l_discount") * 100)).alias("delta_h"),
            F.sum(_whole(F.col("l_tax") * 100)).alias("lwe_mo"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.sum(F.col("l_linenumber").cast("bigint")).alias("surface_slope"),
        )
    )
    wet = F.col("regional_subset_id").isin("ASIA", "EUROPE")
    return lookup_join(monthly, basins(spark, sf_dir), ["x"], how="inner").select(
        "x", "y", "mascon_id", "regional_subset_id", "month_idx", "n_obs", "delta_h", "lwe_mo", "surface_slope",
        F.when(wet, F.col("quantity")).alias("thetao_mo"),
        F.when(wet, F.col("surface_slope") + F.col("n_obs")).alias("so_mo"),
    )


OBS = f"""{BASINS},
monthly as (
  select l_suppkey as x, cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as month_idx, count(*) as n_obs,
    cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as delta_h,
    cast(sum(cast(round(l_tax * 100) as bigint)) as bigint) as lwe_mo,
    cast(sum(cast(l_quantity as bigint)) as bigint) as quantity,
    cast(sum(l_linenumber) as bigint) as surface_slope
  from lineitem group by 1, 2),
obs as (
  select x, y, mascon_id, regional_subset_id, month_idx, n_obs, delta_h, lwe_mo, surface_slope,
    case when regional_subset_id in ('ASIA', 'EUROPE') then quantity end as thetao_mo,
    case when regional_subset_id in ('ASIA', 'EUROPE') then surface_slope + n_obs end as so_mo
  from monthly join basins using (x))"""


def pixel_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static fields of every pixel, from its number and account balance."""
    x = F.col("x")
    surface, thickness = x % 500 + 50, F.floor(F.abs("s_acctbal")).cast("bigint") % 1000 + 100
    return basins(spark, sf_dir).select(
        "x",
        surface.alias("surface"),
        thickness.alias("thickness"),
        (surface - thickness - (x % 3) * 100).alias("bed"),
        (x * 977 % 150000).alias("dist_to_grounding_line"),
        (x * 1409 % 200000).alias("dist_to_ocean"),
        (x % 5 - 2).alias("surface_dx"), (x % 3 - 1).alias("surface_dy"),
        (x % 7 - 3).alias("bed_dx"), (x % 2 - 1).alias("bed_dy"), (x % 4).alias("bed_slope"),
    )


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with geometry, draft, depth and ocean forcing: the columns features start from."""
    joined = lookup_join(obs(spark, sf_dir), pixel_geometry(spark, sf_dir), ["x"])
    draft = F.greatest(F.col("thickness") - F.col("surface"), F.lit(0))
    return (
        joined.withColumns({"ice_draft": draft, "clamped_depth": F.least(draft, F.lit(500))})
        .withColumn("t_f_mo", F.when(F.col("so_mo").isNotNull(), -F.col("so_mo") - F.floor(F.col("clamped_depth") / 100)))
        .withColumn("t_star_mo", F.col("thetao_mo") - F.col("t_f_mo"))
    )


FUSED = f"""{OBS},
geometry as (
  select x, x % 500 + 50 as surface, cast(floor(abs(s_acctbal)) as bigint) % 1000 + 100 as thickness,
    x * 977 % 150000 as dist_to_grounding_line, x * 1409 % 200000 as dist_to_ocean,
    x % 5 - 2 as surface_dx, x % 3 - 1 as surface_dy, x % 7 - 3 as bed_dx, x % 2 - 1 as bed_dy, x % 4 as bed_slope
  from basins),
fused as (
  select *, thetao_mo - t_f_mo as t_star_mo from (
    select *, case when so_mo is not null then -so_mo - cast(floor(clamped_depth / 100) as bigint) end as t_f_mo from (
      select *, least(ice_draft, 500) as clamped_depth from (
        select *, greatest(thickness - surface, 0) as ice_draft, surface - thickness - (x % 3) * 100 as bed
        from obs join geometry using (x)))))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense raster, one cell per part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (key % GRID_WIDTH).alias("cell_x"),
        F.floor(key / GRID_WIDTH).cast("bigint").alias("cell_y"),
        _whole(F.col("p_retailprice") * 100).alias("surface"),
        (F.col("p_size").cast("bigint") * 100 - 2500).alias("bed"),
        (F.col("p_size") % 4 + 1).cast("int").alias("mask"),
    )


GRID = f"""grid as (
  select p_partkey % {GRID_WIDTH} as cell_x, p_partkey // {GRID_WIDTH} as cell_y,
    cast(round(p_retailprice * 100) as bigint) as surface, cast(p_size as bigint) * 100 - 2500 as bed,
    cast(p_size % 4 + 1 as int) as mask
  from part)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular points over the raster's 500 m cells, one per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        (F.col("o_orderkey") * 7919 % 25000).cast("double").alias("x"),
        (F.col("o_custkey") * 13).cast("double").alias("y"),
        month_index(F.col("o_orderdate")).alias("month_idx"),
        _whole(F.col("o_totalprice")).alias("h_li"),
    )


POINTS = """points as (
  select o_orderkey as point_id, cast(o_orderkey * 7919 % 25000 as double) as x, cast(o_custkey * 13 as double) as y,
    cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as month_idx, cast(round(o_totalprice) as bigint) as h_li
  from orders)"""


def ocean_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ocean values by (column, month, depth level)."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("x"),
        month_index(F.col("l_shipdate")).alias("month_idx"),
        (F.col("l_linenumber") * 100).alias("depth"),
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))


OCEAN = """ocean as (
  select l_suppkey as x, cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as month_idx,
    l_linenumber * 100 as depth, cast(sum(cast(l_quantity as bigint)) as bigint) as value
  from lineitem group by 1, 2, 3)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with true and predicted labels, by region."""
    labels = table(spark, sf_dir, "labels")
    return lookup_join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), labels, ["doc_id"], "inner").select(
        "doc_id",
        F.col("lang").alias("regional_subset_id"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("quality").alias("label"),
        (F.col("n_chars") > 1500).cast("int").alias("prediction"),
    )


SCORED = """scored as (
  select doc_id, lang as regional_subset_id, cast(n_chars as double) as score, quality as label,
    case when n_chars > 1500 then 1 else 0 end as prediction
  from documents join labels using (doc_id))"""


def uniform_sql(keys: list[str], seed: int) -> str:
    """SQL twin of ``distribute.keyed_uniform``."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 13))::bigint / {float(1 << 52)!r}::double)"
