"""Projection, grid algebra and fusion joins on the given tables."""

from __future__ import annotations



from pyspark.sql import functions as F

from polarframe.functions import physics
from polarframe.functions.calendar import month_idx, month_index
from polarframe.functions.projection import ECC, SCALE, SERIES, snap, to_geographic, to_polar, wrap_longitude
from polarframe.operators import fusion, grid as grids
from polarframe.operators.distribute import settle
from polarframe.plans.bindings import (
    BASINS, FUSED, GRID, OBS, OCEAN, POINTS, basins, fused, grid, obs, ocean_profile, pixel_geometry, points, table,
)
from polarframe.plans.observations import observation_table
from polarframe.plans.registry import query


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


_GEO = """geo as (select o_orderkey as point_id, -60 - (o_orderkey * 37 % 3000) / 100.0::double as lat,
  (o_custkey * 73 % 36000) / 100.0::double as lon from orders)"""


def _geo(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        (-60 - (F.col("o_orderkey") * 37 % 3000) / 100.0).alias("lat"),
        ((F.col("o_custkey") * 73 % 36000) / 100.0).alias("lon"),
    )


@query(
    "to_polar",
    f"""with {_GEO}, t as (select point_id, lon, {SCALE!r} * tan(pi() / 4 + radians(lat) / 2)
      / pow((1 - {ECC!r} * sin(radians(-lat))) / (1 + {ECC!r} * sin(radians(-lat))), {ECC / 2!r}) as rho from geo)
    select point_id, round(rho * sin(radians(lon)), 3) as x, round(rho * cos(radians(lon)), 3) as y from t""",
)
def _(spark, sf):
    out = to_polar(_geo(spark, sf)).select("point_id", "x", "y")
    return out.withColumns({c: F.round(c, 3) + 0.0 for c in ("x", "y")})


@query(
    "to_geographic",
    f"""with {POINTS}, c as (select point_id, x - 12500 as x, y - 10000 as y from points),
    k as (select *, pi() / 2 - 2 * atan(sqrt(x * x + y * y) / {SCALE!r}) as chi from c)
    select point_id, round(-degrees(chi + {' + '.join(f'sin({2 * i} * chi) * {s!r}' for i, s in enumerate(SERIES, 1))}), 6) as lat,
      round(degrees(atan2(x, y)), 6) as lon from k""",
)
def _(spark, sf):
    centred = points(spark, sf).select("point_id", (F.col("x") - 12500).alias("x"), (F.col("y") - 10000).alias("y"))
    return _rounded(to_geographic(centred), 6, "lat", "lon").select("point_id", "lat", "lon")


@query(
    "wrap_longitude",
    f"""with {_GEO} select point_id, round((lon + 180) % 360 - 180, 6) as lon, round(((lon + 180) % 360 - 180 + 360) % 360, 6) as lon_back from geo""",
)
def _(spark, sf):
    signed = wrap_longitude(_geo(spark, sf), "lon", "180").withColumn("lon_back", F.col("lon"))
    return _rounded(wrap_longitude(signed, "lon_back", "360"), 6, "lon", "lon_back").select("point_id", "lon", "lon_back")


@query(
    "master_grid",
    f"""with {POINTS}, b as (select cast(floor(min(x) / 500) as bigint) as x0, cast(floor(min(y) / 500) as bigint) as y0,
      cast(ceil(max(x) / 500) as bigint) as x1, cast(ceil(max(y) / 500) as bigint) as y1 from points),
    cx as (select unnest(range(x0, x1)) as cell_x from b), cy as (select unnest(range(y0, y1)) as cell_y from b)
    select cell_x, cell_y, (cell_x + 0.5::double) * 500 as x, (cell_y + 0.5::double) * 500 as y from cx, cy""",
)
def _(spark, sf):
    box = points(spark, sf).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return grids.master_grid(spark, tuple(box), 500.0)


@query("snap_to_cell", f"with {POINTS} select point_id, cast(floor(x / 500) as bigint) as cell_x, cast(floor(y / 500) as bigint) as cell_y from points")
def _(spark, sf):
    return snap(points(spark, sf)).select("point_id", "cell_x", "cell_y")


@query(
    "refine",
    f"""with {GRID}, k as (select unnest(range(4)) as k)
    select cell_x * 2 + k % 2 as cell_x, cell_y * 2 + k // 2 as cell_y, surface / 4 as surface, mask from grid, k""",
)
def _(spark, sf):
    return grids.refine(grid(spark, sf).drop("bed"), 2, conserve=["surface"])


@query(
    "bilinear",
    f"""with {GRID}, {POINTS}, p as (select point_id, x / 500 - 0.5 as u, y / 500 - 0.5 as v from points),
    c as (select point_id, cast(floor(u) as bigint) as i, cast(floor(v) as bigint) as j, u - floor(u) as wx, v - floor(v) as wy from p)
    select point_id, round((a.surface * (1 - wx) + b.surface * wx) * (1 - wy) + (d.surface * (1 - wx) + e.surface * wx) * wy, 6) as surface
    from c left join grid a on a.cell_x = i and a.cell_y = j left join grid b on b.cell_x = i + 1 and b.cell_y = j
    left join grid d on d.cell_x = i and d.cell_y = j + 1 left join grid e on e.cell_x = i + 1 and e.cell_y = j + 1""",
)
def _(spark, sf):
    out = grids.bilinear(points(spark, sf), grid(spark, sf), "surface", 500.0)
    return out.select("point_id", F.round("surface", 6).alias("surface"))


@query(
    "lookup_coarse",
    f"""with {GRID}, {POINTS} select point_id, bed, mask from points left join grid
        on grid.cell_x = cast(floor(x / 500) as bigint) and grid.cell_y = cast(floor(y / 500) as bigint)""",
)
def _(spark, sf):
    return grids.lookup_coarse(points(spark, sf), grid(spark, sf), 500.0).select("point_id", "bed", "mask")


_LINES = "l_orderkey, l_linenumber, l_partkey"


def _line_pixels(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("x"))


@query("assign_mascon", f"with {BASINS} select {_LINES}, mascon_id from lineitem left join basins on l_suppkey = x")
def _(spark, sf):
    return fusion.assign_mascon(_line_pixels(spark, sf), basins(spark, sf), ["x"]).drop("x")


@query("assign_region", "select c_custkey, r_name as regional_subset_id from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def _(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("mascon_id"))
    regions = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    region_map = regions.select(F.col("n_nationkey").alias("mascon_id"), F.col("r_name").alias("regional_subset_id"))
    return fusion.assign_region(customers, region_map).drop("mascon_id")


@query(
    "join_static",
    f"""with {GRID}, {POINTS}, p as (select point_id, h_li, cast(floor(x / 500) as bigint) as cell_x, cast(floor(y / 500) as bigint) as cell_y from points)
    select point_id, cell_x, cell_y, h_li, surface, bed, mask from p left join grid using (cell_x, cell_y)""",
)
def _(spark, sf):
    return fusion.join_static(snap(points(spark, sf)).drop("x", "y", "month_idx"), grid(spark, sf))


@query(
    "join_monthly",
    f"""with {OBS}, m as (select mascon_id, month_idx + 1 as month_idx, cast(sum(lwe_mo) as bigint) as mascon_lwe from obs group by 1, 2)
    select x, obs.month_idx, obs.mascon_id, mascon_lwe from obs left join m on obs.mascon_id = m.mascon_id and obs.month_idx = m.month_idx""",
)
def _(spark, sf):
    rows = settle(obs(spark, sf))
    # The mass of the month before: the first months have none.
    monthly = settle(rows.groupBy("mascon_id", (F.col("month_idx") + 1).alias("month_idx")).agg(F.sum("lwe_mo").alias("mascon_lwe")))
    return fusion.join_monthly(rows.select("x", "month_idx", "mascon_id"), monthly, ["mascon_id"])


_FUSE_FLOATS = ["t_f_mo", "t_star_mo", "t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg",
                "thetao_quarterly_std", "lwe_quarterly_avg", "lwe_quarterly_std", "lwe_fused"]


@query(
    "fuse",
    f"""with {FUSED}, alt as (select x, y, mascon_id, regional_subset_id, month_idx, delta_h from obs),
    grav as (select mascon_id, month_idx, cast(sum(lwe_mo) as bigint) as lwe_mo from obs group by 1, 2),
    w as (select a.*, g.surface, g.thickness, g.surface + a.delta_h as h_surface_dynamic, m.lwe_mo, f.thetao_mo, f.so_mo, f.clamped_depth,
        cast(f.ice_draft as double) as ice_draft,
        -0.057 * f.so_mo + -0.00076 * f.clamped_depth + 0.0 as t_f_mo,
        f.thetao_mo - (-0.057 * f.so_mo + -0.00076 * f.clamped_depth + 0.0) as t_star_mo
      from alt a join geometry g using (x) join grav m on a.mascon_id = m.mascon_id and a.month_idx = m.month_idx
      join fused f on f.x = a.x and f.month_idx = a.month_idx)
    select x, y, month_idx, mascon_id, regional_subset_id, delta_h, surface, thickness, h_surface_dynamic, ice_draft, lwe_mo, thetao_mo, so_mo,
      round(t_f_mo, 6)::double as t_f_mo, round(t_star_mo, 6)::double as t_star_mo,
      round(avg(t_star_mo) over q, 6)::double as t_star_quarterly_avg, round(stddev_samp(t_star_mo) over q, 6)::double as t_star_quarterly_std,
      round(avg(thetao_mo) over q, 6) as thetao_quarterly_avg, round(stddev_samp(thetao_mo) over q, 6) as thetao_quarterly_std,
      round(avg(lwe_mo) over q, 6) as lwe_quarterly_avg, round(stddev_samp(lwe_mo) over q, 6) as lwe_quarterly_std,
      round(lwe_mo * (abs(delta_h) / nullif(avg(abs(delta_h)) over (partition by mascon_id, month_idx), 0)), 6) as lwe_fused
    from w window q as (partition by x, y order by month_idx range between 2 preceding and current row)""",
)
def _(spark, sf):
    seen = settle(obs(spark, sf))
    cells = lambda d: d.withColumns({"cell_x": F.col("x"), "cell_y": F.lit(0)})
    geometry = pixel_geometry(spark, sf)
    depth = F.least(F.greatest(F.col("thickness") - F.col("surface"), F.lit(0)), F.lit(500))
    topography = cells(geometry.select("x", "surface", "thickness", depth.alias("clamped_depth"))).drop("x")
    gravity = settle(seen.groupBy("mascon_id", "month_idx").agg(F.sum("lwe_mo").alias("lwe_mo")))
    ocean = cells(seen.filter("thetao_mo is not null").select("x", "month_idx", "thetao_mo", "so_mo")).drop("x")
    mascons = cells(basins(spark, sf).select("x", "mascon_id")).drop("x")
    regions = settle(basins(spark, sf).select("mascon_id", "regional_subset_id").distinct())
    wide = fusion.fuse(cells(seen.select("x", "y", "month_idx", "delta_h")), topography, gravity, ocean, mascons, regions)
    return _rounded(wide, 6, *_FUSE_FLOATS).drop("cell_x", "cell_y", "clamped_depth", "ice_base")


@query("ice_geometry", f"with {FUSED} select x, surface - thickness as ice_base, greatest(thickness - surface, 0)::double as ice_draft from geometry")
def _(spark, sf):
    return physics.ice_geometry(pixel_geometry(spark, sf)).select("x", "ice_base", "ice_draft")


@query("dynamic_surface", f"with {FUSED} select x, month_idx, surface + delta_h as h_surface_dynamic from fused")
def _(spark, sf):
    return physics.dynamic_surface(fused(spark, sf)).select("x", "month_idx", "h_surface_dynamic")


@query("dynamic_thickness", f"with {FUSED} select x, month_idx, thickness + delta_h as thickness_dynamic from fused")
def _(spark, sf):
    return physics.dynamic_thickness(fused(spark, sf)).select("x", "month_idx", "thickness_dynamic")


@query("thickness_from_surface", f"with {GRID} select cell_x, cell_y, surface - bed as thickness_derived from grid")
def _(spark, sf):
    return physics.thickness_from_surface(grid(spark, sf)).select("cell_x", "cell_y", "thickness_derived")


@query("lwe_to_metres", f"with {OBS} select x, month_idx, lwe_mo / 100 as lwe_metres from obs")
def _(spark, sf):
    return physics.lwe_to_metres(obs(spark, sf), "lwe_mo", "lwe_metres").select("x", "month_idx", "lwe_metres")


@query("freezing_point", f"with {FUSED} select x, month_idx, round(-0.057 * so_mo - 0.00076 * clamped_depth, 6)::double as t_f_mo from fused")
def _(spark, sf):
    return _rounded(physics.freezing_point(fused(spark, sf)), 6, "t_f_mo").select("x", "month_idx", "t_f_mo")


@query("thermal_driving", f"with {FUSED} select x, month_idx, round(thetao_mo - (-0.057 * so_mo - 0.00076 * clamped_depth), 6)::double as t_star_mo from fused")
def _(spark, sf):
    driven = physics.thermal_driving(physics.freezing_point(fused(spark, sf)))
    return _rounded(driven, 6, "t_star_mo").select("x", "month_idx", "t_star_mo")


@query(
    "clamp_depth",
    f"""with {FUSED}, {OCEAN}, d as (select x * 2 as x, max(depth) as deepest from ocean group by x)
    select x, ice_draft, case when deepest is not null then least(ice_draft, deepest) end as clamped_depth
    from (select x, greatest(thickness - surface, 0) as ice_draft from geometry) left join d using (x)""",
)
def _(spark, sf):
    drafts = physics.ice_geometry(pixel_geometry(spark, sf)).select("x", F.col("ice_draft").cast("bigint").alias("ice_draft"))
    # Profiles at every other place: the pixels between have none.
    return fusion.clamp_depth(drafts, ocean_profile(spark, sf).withColumn("x", F.col("x") * 2), ["x"])


_DEPTHS = f"{FUSED}, {OCEAN}, pairs as (select f.x, f.month_idx, clamped_depth as d, depth, value from fused f left join ocean o on o.x = f.x and o.month_idx = f.month_idx)"


@query(
    "sample_nearest_depth",
    f"with {_DEPTHS} select x, month_idx, arg_min(value, abs(depth - d) * 100000 + depth)::double as value_at_depth from pairs group by x, month_idx, d",
)
def _(spark, sf):
    return fusion.sample_at_depth(fused(spark, sf), ocean_profile(spark, sf), ["x", "month_idx"]).select("x", "month_idx", "value_at_depth")


@query(
    "sample_linear_depth",
    f"""with {_DEPTHS}, b as (select x, month_idx, d, max(depth) filter (where depth <= d) as d0, min(depth) filter (where depth >= d) as d1,
      arg_max(value, depth) filter (where depth <= d) as v0, arg_min(value, depth) filter (where depth >= d) as v1 from pairs group by x, month_idx, d)
    select x, month_idx, round(coalesce(v0 + (v1 - v0) * coalesce((d - d0) / nullif(d1 - d0, 0), 0), v0, v1), 6)::double as value_at_depth from b""",
)
def _(spark, sf):
    out = fusion.sample_at_depth(fused(spark, sf), ocean_profile(spark, sf), ["x", "month_idx"], mode="linear")
    return _rounded(out, 6, "value_at_depth").select("x", "month_idx", "value_at_depth")


@query("monthly_ocean", f"with {OCEAN} select x, month_idx, avg(value) as thetao_mo, avg(depth) as so_mo from ocean group by 1, 2")
def _(spark, sf):
    levels = ocean_profile(spark, sf).withColumnsRenamed({"value": "thetao", "depth": "so"})
    return fusion.monthly_ocean(levels, ["thetao", "so"], ["x"])


@query(
    "quarterly_stats",
    f"""with {OBS} select x, month_idx, avg(thetao_mo) over q as thetao_quarterly_avg, round(stddev_samp(thetao_mo) over q, 6) as thetao_quarterly_std,
      avg(lwe_mo) over q as lwe_quarterly_avg, round(stddev_samp(lwe_mo) over q, 6) as lwe_quarterly_std
    from obs window q as (partition by x, y order by month_idx range between 2 preceding and current row)""",
)
def _(spark, sf):
    out = fusion.quarterly_stats(obs(spark, sf), ["thetao_mo", "lwe_mo"])
    names = ["thetao_quarterly_avg", "thetao_quarterly_std", "lwe_quarterly_avg", "lwe_quarterly_std"]
    return _rounded(out, 6, names[1], names[3]).select("x", "month_idx", *names)


@query(
    "slope",
    f"""with {GRID}, n as (select g.cell_x, g.cell_y, g.bed as c, w.bed as w, e.bed as e, s.bed as s, n.bed as n from grid g
      left join grid w on w.cell_x = g.cell_x - 1 and w.cell_y = g.cell_y left join grid e on e.cell_x = g.cell_x + 1 and e.cell_y = g.cell_y
      left join grid s on s.cell_x = g.cell_x and s.cell_y = g.cell_y - 1 left join grid n on n.cell_x = g.cell_x and n.cell_y = g.cell_y + 1),
    d as (select cell_x, cell_y, coalesce((e - w) / 1000.0::double, (e - c) / 500.0::double, (c - w) / 500.0::double) as dx,
      coalesce((n - s) / 1000.0::double, (n - c) / 500.0::double, (c - s) / 500.0::double) as dy from n)
    select cell_x, cell_y, round(dx, 9) as bed_dx, round(dy, 9) as bed_dy, round(sqrt(dx * dx + dy * dy), 9) as bed_slope from d""",
)
def _(spark, sf):
    out = grids.slope(grid(spark, sf), "bed")
    return _rounded(out, 9, "bed_dx", "bed_dy", "bed_slope").select("cell_x", "cell_y", "bed_dx", "bed_dy", "bed_slope")


@query(
    "nearest_distance",
    f"""with {GRID}, {POINTS}, p as (select point_id, cast(floor(x / 500) as bigint) as cell_x, cast(floor(y / 500) as bigint) as cell_y from points),
    t as (select cell_x, cell_y from grid where bed >= 2000),
    c as (select a.cell_x, a.cell_y, min((a.cell_x - t.cell_x) * (a.cell_x - t.cell_x) + (a.cell_y - t.cell_y) * (a.cell_y - t.cell_y)) as d2
      from (select distinct cell_x, cell_y from p) a, t group by 1, 2)
    select point_id, sqrt(d2::double) * 500 as distance from p left join c using (cell_x, cell_y)""",
)
def _(spark, sf):
    found = grids.nearest_distance(snap(points(spark, sf)), grid(spark, sf).filter("bed >= 2000"))
    return found.select("point_id", "distance")


@query(
    "neighbourhood_fraction",
    f"""with {GRID} select a.cell_x, a.cell_y, count(*) filter (where b.mask in (2, 3)) / count(*) as fraction from grid a join grid b
      on b.cell_x between a.cell_x - 20 and a.cell_x + 20 and b.cell_y between a.cell_y - 20 and a.cell_y + 20
      and (a.cell_x - b.cell_x) * (a.cell_x - b.cell_x) + (a.cell_y - b.cell_y) * (a.cell_y - b.cell_y) <= 400 group by 1, 2""",
)
def _(spark, sf):
    flagged = grid(spark, sf).withColumn("floating", F.col("mask").isin(2, 3))
    return grids.neighbourhood_fraction(flagged, "floating").select("cell_x", "cell_y", "fraction")


@query(
    "disaggregate_mass",
    f"""with {OBS} select x, month_idx, round(lwe_mo * (abs(delta_h) / nullif(avg(abs(delta_h)) over (partition by mascon_id, month_idx), 0)), 6) as lwe_fused from obs""",
)
def _(spark, sf):
    return _rounded(fusion.disaggregate_mass(obs(spark, sf)), 6, "lwe_fused").select("x", "month_idx", "lwe_fused")


@query(
    "calendar_gaps",
    """with months as (select distinct l_partkey, cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as month_idx from lineitem),
    spine as (select l_partkey, cast(unnest(range((select min(month_idx) from months), (select max(month_idx) + 1 from months))) as int) as month_idx
      from (select distinct l_partkey from months))
    select s.l_partkey, s.month_idx from spine s left join months m on m.l_partkey = s.l_partkey and m.month_idx = s.month_idx where m.month_idx is null""",
)
def _(spark, sf):
    """Over all months of the data."""
    shipped = month_idx(table(spark, sf, "lineitem"), "l_shipdate").select("l_partkey", "month_idx")
    ends = shipped.agg(F.min("month_idx").alias("a"), F.max("month_idx").alias("b")).first()
    return fusion.calendar_gaps(shipped, ["l_partkey"], ends.a, ends.b)


@query(
    "height_rate",
    f"""with {OBS} select o.x, o.month_idx, (o.delta_h - a.delta_h) / 0.25::double as dhdt_lag1, (o.delta_h - b.delta_h) / 1.0::double as dhdt_lag4
      from obs o left join obs a on a.x = o.x and a.month_idx = o.month_idx - 3 left join obs b on b.x = o.x and b.month_idx = o.month_idx - 12""",
)
def _(spark, sf):
    rates = fusion.height_rate(fusion.height_rate(obs(spark, sf), 3), 12)
    return rates.select("x", "month_idx", "dhdt_lag1", "dhdt_lag4")


@query(
    "grid_points",
    f"""with {POINTS} select cast(floor(x / 500) as bigint) as cell_x, cast(floor(y / 500) as bigint) as cell_y, month_idx,
      avg(h_li) as mean_h_li, round(stddev_samp(h_li), 6) as std_h_li, count(h_li) as n from points group by 1, 2, 3""",
)
def _(spark, sf):
    return _rounded(grids.grid_points(points(spark, sf), "h_li"), 6, "std_h_li")


@query(
    "pixel_months",
    """select l_suppkey as x, cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as month_idx, avg(l_quantity) as l_quantity from lineitem group by 1, 2""",
)
def _(spark, sf):
    lines = month_idx(table(spark, sf, "lineitem").withColumn("x", F.col("l_suppkey")), "l_shipdate")
    return fusion.to_pixel_months(lines, ["l_quantity"], ["x"])


# ---- the whole fact table, from the raster, the points and the line items as source products

_SOURCES = f"""{GRID}, {POINTS},
  topo as (select cell_x, cell_y, surface // 100 - 800 as surface, bed // 10 as bed, surface // 100 - 800 - bed // 10 + mask * 50 as thickness,
    case when bed < 2400 then mask end as mask from grid),
  alt as (select cast(floor(x / 500) as bigint) as cell_x, cast(floor(y / 500) as bigint) as cell_y, month_idx, cast(sum(h_li) % 97 as bigint) as delta_h from points group by 1, 2, 3),
  grav as (select cell_x // 10 as mascon_id, month_idx, cast(count(*) * 100 as bigint) as lwe_cm from alt group by 1, 2),
  sea as (select l_suppkey % 7 as ocean_x, l_suppkey // 7 as ocean_y, cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as month_idx, l_linenumber * 100 as depth,
    cast(sum(cast(l_quantity as bigint)) as bigint) as thetao, cast(sum(l_linenumber) as bigint) as so from lineitem group by 1, 2, 3, 4)"""


def _source_tables(spark, sf):
    raster = grid(spark, sf)
    whole = lambda c, by: F.floor(F.col(c) / by).cast("bigint")
    surface, bed = whole("surface", 100) - 800, whole("bed", 10)
    topography = raster.select(
        "cell_x", "cell_y", surface.alias("surface"), bed.alias("bed"), (surface - bed + F.col("mask") * 50).alias("thickness"),
        F.when(F.col("bed") < 2400, F.col("mask")).alias("mask"),
    )
    cells = snap(points(spark, sf)).groupBy("cell_x", "cell_y", "month_idx").agg((F.sum("h_li") % 97).alias("delta_h"))
    altimetry = settle(cells).withColumns({
        "x": F.col("cell_x") * 500.0, "y": F.col("cell_y") * 500.0, "ice_area": F.lit(1.0),
        "exact_time": F.make_timestamp(F.floor((F.col("month_idx") - 1) / 12).cast("int"), F.pmod(F.col("month_idx") - 1, F.lit(12)) + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
    })
    mascon = whole("cell_x", 10)
    gravity = settle(altimetry.groupBy(mascon.alias("mascon_id"), "month_idx").agg((F.count(F.lit(1)) * 100).alias("lwe_thickness_cm")))
    ocean = settle(
        table(spark, sf, "lineitem").groupBy(
            (F.col("l_suppkey") % 7).alias("ocean_x"), whole("l_suppkey", 7).alias("ocean_y"),
            month_index(F.col("l_shipdate")).alias("month_idx"), (F.col("l_linenumber") * 100).alias("depth"),
        ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("thetao"), F.sum(F.col("l_linenumber").cast("bigint")).alias("so"))
    )
    mascon_map = raster.select("cell_x", "cell_y", mascon.alias("mascon_id"))
    region_map = settle(mascon_map.select("mascon_id").distinct().withColumn("regional_subset_id", F.concat(F.lit("basin "), F.col("mascon_id"))))
    return altimetry, topography, gravity, ocean, mascon_map, region_map


@query(
    "observation_table",
    f"""with {_SOURCES},
    lines as (select cell_x, cell_y from topo where mask = 2), water as (select cell_x, cell_y from topo where mask is null),
    static as (select t.*, greatest(thickness - surface, 0) as draft, cast(floor((cell_x + 0.5::double) * 500 / 4000) as bigint) as ocean_x,
      cast(floor((cell_y + 0.5::double) * 500 / 4000) as bigint) as ocean_y from topo t),
    bottom as (select ocean_x, ocean_y, max(depth) as deepest from sea group by 1, 2),
    wide as (select a.*, s.surface, s.mask, s.ocean_x, s.ocean_y, a.cell_x // 10 as mascon_id, s.surface + delta_h as h,
      case when deepest is not null then least(draft, deepest) end as d, lwe_cm / 100 as lwe_mo
      from alt a left join static s using (cell_x, cell_y) left join bottom b on b.ocean_x = s.ocean_x and b.ocean_y = s.ocean_y
      left join grav g on g.mascon_id = a.cell_x // 10 and g.month_idx = a.month_idx),
    near as (select w.cell_x, w.cell_y, w.month_idx, arg_min(thetao, abs(depth - d) * 100000 + depth) as thetao_mo, arg_min(so, abs(depth - d) * 100000 + depth) as so_mo
      from wide w join sea o on o.ocean_x = w.ocean_x and o.ocean_y = w.ocean_y and o.month_idx = w.month_idx where mask in (2, 3) and d is not null group by 1, 2, 3),
    hot as (select w.*, thetao_mo, so_mo, thetao_mo - (-0.057 * so_mo - 0.00076 * d) as t_star_mo from wide w left join near using (cell_x, cell_y, month_idx)),
    sides as (select c.cell_x, c.cell_y, c.month_idx, c.h as c, w.h as w, e.h as e, s.h as s, n.h as n from wide c
      left join wide w on w.month_idx = c.month_idx and w.cell_x = c.cell_x - 1 and w.cell_y = c.cell_y left join wide e on e.month_idx = c.month_idx and e.cell_x = c.cell_x + 1 and e.cell_y = c.cell_y
      left join wide s on s.month_idx = c.month_idx and s.cell_x = c.cell_x and s.cell_y = c.cell_y - 1 left join wide n on n.month_idx = c.month_idx and n.cell_x = c.cell_x and n.cell_y = c.cell_y + 1),
    grad as (select cell_x, cell_y, month_idx, coalesce((e - w) / 1000.0::double, (e - c) / 500.0::double, (c - w) / 500.0::double) as dx,
      coalesce((n - s) / 1000.0::double, (n - c) / 500.0::double, (c - s) / 500.0::double) as dy from sides),
    far as (select a.cell_x, a.cell_y, (select min((a.cell_x - t.cell_x) ** 2 + (a.cell_y - t.cell_y) ** 2) from lines t) as gl2,
      (select min((a.cell_x - t.cell_x) ** 2 + (a.cell_y - t.cell_y) ** 2) from water t) as oc2 from (select distinct cell_x, cell_y from alt) a)
    select h.cell_x * 500.0::double as x, h.cell_y * 500.0::double as y, h.month_idx, cast(h.mascon_id as int) as mascon_id, 'basin ' || h.mascon_id as regional_subset_id, mask as ice_mask,
      h::float as h_surface_dynamic, round(sqrt(dx * dx + dy * dy)::float::double, 4) as surface_slope, round((case when surface is not null then sqrt(gl2::double) * 500 end)::float::double, 1) as dist_to_grounding_line,
      round((case when surface is not null then sqrt(oc2::double) * 500 end)::float::double, 1) as dist_to_ocean, d::float as clamped_depth, thetao_mo::float as thetao_mo, round(t_star_mo::float::double, 3) as t_star_mo, lwe_mo::float as lwe_mo,
      round((avg(t_star_mo::double) over (partition by h.cell_x, h.cell_y order by h.month_idx range between 2 preceding and current row))::float::double, 3) as t_star_quarterly_avg,
      round((lwe_mo * (abs(delta_h) / nullif(avg(abs(delta_h)) over (partition by h.mascon_id, h.month_idx), 0)))::float::double, 3) as lwe_fused
    from hot h join grad using (cell_x, cell_y, month_idx) join far on far.cell_x = h.cell_x and far.cell_y = h.cell_y""",
)
def _(spark, sf):
    full = observation_table(*_source_tables(spark, sf), ocean_cell=4000.0)
    digits = {"surface_slope": 4, "dist_to_grounding_line": 1, "dist_to_ocean": 1, "t_star_mo": 3, "t_star_quarterly_avg": 3, "lwe_fused": 3}
    exact = ["x", "y", "month_idx", "mascon_id", "regional_subset_id", "ice_mask", "h_surface_dynamic", "clamped_depth", "thetao_mo", "lwe_mo"]
    return full.select(*exact, *[F.round(F.col(c).cast("double"), d).alias(c) for c, d in digits.items()])
