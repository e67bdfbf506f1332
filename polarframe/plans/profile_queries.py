"""Exploration operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from polarframe.functions.lattice import Lattice
from polarframe.operators import profile
from polarframe.operators.distribute import settle
from polarframe.plans.bindings import GRID, OBS, grid, obs, table
from polarframe.plans.registry import query


def _stacked(rows: list[str]) -> str:
    return " union all ".join(f"select {row}" for row in rows)


@query(
    "shape",
    "select count(*) as n_rows, cast(4 as bigint) as n_columns, count(*) * 4 as n_values, 'part_id,size,price,brand' as column_names from part",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand")
    )
    return profile.shape(parts)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_orderkey"]
_WHOLE_NUMBERS = {"l_linenumber", "l_orderkey"}


@query(
    "summarize",
    _stacked([
        f"'{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev, "
        f"cast(min({c}) as double) as min_value, cast(max({c}) as double) as max_value, "
        + (f"cast(min({c}) as bigint) as min_whole, cast(max({c}) as bigint) as max_whole" if c in _WHOLE_NUMBERS else "null::bigint as min_whole, null::bigint as max_whole")
        + " from lineitem"
        for c in _NUMBERS
    ]),
)
def _(spark, sf):
    out = profile.summarize(table(spark, sf, "lineitem"), _NUMBERS)
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


_OBS_COLUMNS = ["x", "month_idx", "delta_h", "lwe_mo", "thetao_mo", "so_mo"]
_RATIO = "count(*) filter (where {0} is null) / nullif(count(*), 0) as ratio"


@query("missing_ratios", f"with {OBS} " + _stacked([f"'{c}' as \"column\", {_RATIO.format(c)} from obs" for c in _OBS_COLUMNS]))
def _(spark, sf):
    return profile.missing_ratios(obs(spark, sf).select(*_OBS_COLUMNS))


@query(
    "missing_report",
    f"with {OBS} select * from (" + _stacked([f"'{c}' as \"column\", {_RATIO.format(c)} from obs" for c in _OBS_COLUMNS]) + ") where ratio > 0.01",
)
def _(spark, sf):
    return profile.missing_report(obs(spark, sf).select(*_OBS_COLUMNS), 0.01)


@query(
    "missing_by_region",
    f"with {OBS} " + _stacked([
        f"regional_subset_id, '{c}' as \"column\", {_RATIO.format(c)} from obs group by regional_subset_id" for c in ("delta_h", "thetao_mo", "so_mo")
    ]),
)
def _(spark, sf):
    return profile.missing_by(obs(spark, sf).select("regional_subset_id", "delta_h", "thetao_mo", "so_mo"), ["regional_subset_id"])


@query(
    "histogram",
    """with e as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, (max(l_extendedprice) - min(l_extendedprice)) / 100 as step from lineitem),
       c as (select least(cast(floor((l_extendedprice - lo) / step) as bigint), 99) as bin_id, count(*) as n from lineitem, e group by 1)
       select b.bin_id, lo + b.bin_id * step as lo, lo + (b.bin_id + 1) * step as hi, coalesce(c.n, 0) as n
       from (select unnest(range(100)) as bin_id) b cross join e left join c on b.bin_id = c.bin_id""",
)
def _(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 100)


def rows_of(gridsize: int) -> int:
    return Lattice(0, 1, 0, 1, gridsize).rows


def _hex_sql(source: str, grid_x: int) -> str:
    ny = rows_of(grid_x)
    return f"""
    e as (select min(px) as x0, max(px) as x1, min(py) as y0, max(py) as y1 from {source}),
    uv as (select s.*, (px - x0) / ((x1 - x0) / {grid_x}) as u, (py - y0) / ((y1 - y0) / {ny}) as v, x0, x1, y0, y1 from {source} s, e),
    h as (select *, (u - round_even(u, 0)) * (u - round_even(u, 0)) + 3 * ((v - round_even(v, 0)) * (v - round_even(v, 0)))
        < (u - (floor(u) + 0.5)) * (u - (floor(u) + 0.5)) + 3 * ((v - (floor(v) + 0.5)) * (v - (floor(v) + 0.5))) as corner from uv),
    b as (select *, case when corner then round_even(u, 0) else floor(u) + 0.5 end as hx,
        case when corner then round_even(v, 0) else floor(v) + 0.5 end as hy from h)"""


_LINE_POINTS = """pts as (select cast(l_partkey as double) as px, cast(l_suppkey as double) as py, l_quantity as pz from lineitem)"""


@query(
    "hexbin_mean",
    f"""with {_LINE_POINTS}, {_hex_sql('pts', 200)}
    select hx, hy, round(x0 + hx * ((x1 - x0) / 200), 6) as cx, round(y0 + hy * ((y1 - y0) / {rows_of(200)}), 6) as cy, count(*) as n,
      round(greatest(least(avg(pz), 27), -27), 6) as mean from b group by hx, hy, x0, x1, y0, y1""",
)
def _(spark, sf):
    out = profile.hexbin_mean(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_quantity", clip=27.0)
    return out.withColumns({c: F.round(c, 6) for c in ("cx", "cy", "mean")})


@query(
    "season_compare",
    f"""with {OBS},
    pts as (select cast(x as double) as px, cast(y as double) as py, cast(delta_h as double) as pz,
      month_idx in (1996 * 12 + 6, 1996 * 12 + 7, 1996 * 12 + 8) as early from obs
      where month_idx in (1996 * 12 + 6, 1996 * 12 + 7, 1996 * 12 + 8, 2000 * 12 + 6, 2000 * 12 + 7, 2000 * 12 + 8)),
    {_hex_sql('pts', 150)}
    select hx, hy, count(*) filter (where early) as n_first, count(*) filter (where not early) as n_last,
      round(avg(pz) filter (where early), 6) as mean_first, round(avg(pz) filter (where not early), 6) as mean_last,
      round(avg(pz) filter (where not early) - avg(pz) filter (where early), 6) as difference
    from b group by hx, hy""",
)
def _(spark, sf):
    out = profile.season_compare(settle(obs(spark, sf)), 1996, 2000)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_first", "mean_last", "difference")})


@query("monthly_mean", f"with {OBS} select month_idx, avg(thetao_mo) as mean, count(thetao_mo) as n from obs group by month_idx")
def _(spark, sf):
    return profile.monthly_mean(obs(spark, sf), "thetao_mo")


_CORR = ["delta_h", "lwe_mo", "thetao_mo", "surface_slope"]


@query(
    "correlation_matrix",
    f"with {OBS} " + _stacked([
        f"'{a}' as column_a, '{b}' as column_b, round({f'case when count({a}) > 0 then 1.0 end' if a == b else f'corr({a}, {b})'}, 6)::double as r from obs"
        for a in _CORR for b in _CORR
    ]),
)
def _(spark, sf):
    return profile.correlation_matrix(obs(spark, sf), _CORR).withColumn("r", F.round("r", 6))


_BOX = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "box_stats",
    "with " + ", ".join(
        f"q_{c} as (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from lineitem)" for c in _BOX
    ) + " " + _stacked([
        f"'{c}' as \"column\", count(*) as n, round(any_value(q1), 6) as q1, round(any_value(med), 6) as median, round(any_value(q3), 6) as q3, "
        f"min({c}) filter (where {c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_low, "
        f"max({c}) filter (where {c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_high, "
        f"count(*) filter (where {c} not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers from lineitem, q_{c}"
        for c in _BOX
    ]),
)
def _(spark, sf):
    out = profile.box_stats(table(spark, sf, "lineitem"), _BOX)
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@query(
    "ocean_coverage",
    f"with {OBS} select regional_subset_id, count(*) as n, count(thetao_mo) as n_valid, count(thetao_mo) / count(*) as coverage from obs group by 1",
)
def _(spark, sf):
    return profile.coverage(obs(spark, sf), "thetao_mo", ["regional_subset_id"])


@query(
    "spatial_compare",
    f"""with {OBS} select cast(floor(x / 10) as bigint) as cx, cast(floor(y / 10) as bigint) as cy, avg(delta_h) as mean_a, avg(lwe_mo) as mean_b, count(*) as n
        from obs group by 1, 2""",
)
def _(spark, sf):
    return profile.spatial_compare(obs(spark, sf), "delta_h", "lwe_mo", 10.0)


@query(
    "series_outliers",
    f"""with {OBS}, s as (select month_idx, avg(delta_h) as mean, count(delta_h) as n from obs group by 1),
    a as (select *, mean - (select median(mean) from s) as away from s),
    z as (select *, away / nullif((select median(abs(away)) from a) * 1.4826, 0) as robust_z from a)
    select month_idx, mean, n, round(robust_z, 6) as robust_z, coalesce(abs(robust_z) > 2.5, false) as is_outlier from z""",
)
def _(spark, sf):
    return profile.series_outliers(obs(spark, sf), "delta_h", k=2.5).withColumn("robust_z", F.round("robust_z", 6))


@query(
    "coverage_by_mask",
    f"""with {GRID}, p as (select mask, case when surface % 7 <> 0 then surface end as probe from grid)
    select mask, count(*) as n, count(probe) as n_valid, count(probe) / count(*) as coverage from p group by mask""",
)
def _(spark, sf):
    probed = grid(spark, sf).withColumn("probe", F.when(F.col("surface") % 7 != 0, F.col("surface")))
    return profile.coverage(probed, "probe", ["mask"])
