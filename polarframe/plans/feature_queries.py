"""Temporal, context, physics, label, split and weight operators on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polarframe.functions.calendar import month_index
from polarframe.functions.physics import physics_features
from polarframe.operators import labels, splits, temporal
from polarframe.operators.distribute import scratch_path, settle
from polarframe.operators.fusion import quarterly_stats
from polarframe.operators.stored import add_month, start, write_bucketed
from polarframe.plans.bindings import FUSED, OBS, fused, obs, table, uniform_sql
from polarframe.plans.registry import query

_W = "window w as (partition by x, y order by month_idx), r as (partition by x, y order by month_idx rows unbounded preceding)"


@query("expanding_mean", f"with {OBS} select x, y, month_idx, avg(delta_h) over r as pixel_mean_delta_h from obs {_W}")
def _(spark, sf):
    return temporal.expanding_mean(obs(spark, sf), "delta_h").select("x", "y", "month_idx", "pixel_mean_delta_h")


@query("delta_h_deviation", f"with {OBS} select x, month_idx, delta_h - avg(delta_h) over r as delta_h_deviation from obs {_W}")
def _(spark, sf):
    return temporal.deviation(obs(spark, sf), "delta_h").select("x", "month_idx", "delta_h_deviation")


@query("surface_slope_change", f"with {OBS} select x, month_idx, surface_slope - lag(surface_slope) over w as surface_slope_change from obs {_W}")
def _(spark, sf):
    return temporal.lag_diff(obs(spark, sf), "surface_slope").select("x", "month_idx", "surface_slope_change")


# The pixel is a part here: its months have gaps, which the gap rules need.
_SPARSE = """sparse as (select l_partkey as x, 0 as y, cast(year(l_shipdate) * 12 + month(l_shipdate) as int) as month_idx,
  cast(sum(cast(l_quantity as bigint)) as bigint) as delta_h from lineitem group by 1, 2, 3)"""
_MOMENTUM = f"""{_SPARSE}, m as (select *, month_idx - lag(month_idx) over w as gap, delta_h - lag(delta_h) over w as step from sparse {_W}),
  k as (select *, case when gap = 1 then step end as momentum from m)"""


def _sparse(spark, sf):
    keys = [F.col("l_partkey").alias("x"), F.lit(0).alias("y"), month_index(F.col("l_shipdate")).alias("month_idx")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("delta_h"))


@query("delta_h_momentum", f"with {_MOMENTUM} select x, month_idx, momentum as delta_h_momentum from k")
def _(spark, sf):
    return temporal.momentum(_sparse(spark, sf), "delta_h").select("x", "month_idx", "delta_h_momentum")


@query("delta_h_rate", f"with {_MOMENTUM} select x, month_idx, step / nullif(gap / 12.0::double, 0) as delta_h_rate from k")
def _(spark, sf):
    return temporal.rate(_sparse(spark, sf), "delta_h").select("x", "month_idx", "delta_h_rate")


@query(
    "delta_h_acceleration",
    f"with {_MOMENTUM} select x, month_idx, case when gap = 1 then momentum - lag(momentum) over w end as delta_h_acceleration from k {_W}",
)
def _(spark, sf):
    return temporal.acceleration(_sparse(spark, sf), "delta_h").select("x", "month_idx", "delta_h_acceleration")


@query(
    "trailing_mean",
    f"with {FUSED} select x, month_idx, avg(t_star_mo) over (partition by x, y order by month_idx range between 5 preceding and current row) as t_star_6mo_avg from fused",
)
def _(spark, sf):
    return temporal.trailing_mean(fused(spark, sf), "t_star_mo", 6).select("x", "month_idx", "t_star_6mo_avg")


@query("thermal_anomaly", f"with {FUSED} select x, month_idx, t_star_mo - avg(t_star_mo) over r as thermal_anomaly from fused {_W}")
def _(spark, sf):
    return temporal.deviation(fused(spark, sf), "t_star_mo", out="thermal_anomaly").select("x", "month_idx", "thermal_anomaly")


@query("salinity_stratification", f"with {OBS} select x, month_idx, so_mo - avg(so_mo) over r as salinity_stratification_proxy from obs {_W}")
def _(spark, sf):
    out = temporal.deviation(obs(spark, sf), "so_mo", out="salinity_stratification_proxy")
    return out.select("x", "month_idx", "salinity_stratification_proxy")


@query(
    "lwe_trend",
    f"with {OBS} select x, month_idx, lwe_mo - avg(lwe_mo) over (partition by x, y order by month_idx range between 2 preceding and current row) as lwe_trend from obs",
)
def _(spark, sf):
    return temporal.lwe_trend(quarterly_stats(obs(spark, sf), ["lwe_mo"])).select("x", "month_idx", "lwe_trend")


@query("mascon_mean", f"with {OBS} select x, month_idx, avg(delta_h) over (partition by mascon_id, month_idx) as mascon_mean_delta_h from obs")
def _(spark, sf):
    return temporal.group_mean(obs(spark, sf), ["mascon_id", "month_idx"], "delta_h").select("x", "month_idx", "mascon_mean_delta_h")


@query(
    "regional_zscore",
    f"""with {OBS} select x, month_idx, round((delta_h - avg(delta_h) over g) / nullif(stddev_samp(delta_h) over g, 0), 6) as regional_delta_h_percentile
      from obs window g as (partition by regional_subset_id, month_idx)""",
)
def _(spark, sf):
    out = temporal.group_zscore(obs(spark, sf), ["regional_subset_id", "month_idx"], "delta_h")
    return out.select("x", "month_idx", F.round("regional_delta_h_percentile", 6).alias("regional_delta_h_percentile"))


@query(
    "seasonal_metrics",
    f"""with {OBS}, p as (select x, y, cast((month_idx - 1) // 12 as int) as year, (month_idx - 1) % 12 + 1 as moy, delta_h from obs),
    a as (select x, y, max(m) - min(m) as seasonal_amplitude from (select x, y, moy, sum(delta_h)::double / count(*) as m from p group by 1, 2, 3) group by 1, 2),
    o as (select x, y, sum(delta_h)::double / count(*) as overall from p group by 1, 2)
    select x, y, year, sum(delta_h)::double / count(*) - any_value(overall) as interannual_anomaly, any_value(seasonal_amplitude) as seasonal_amplitude
    from p join a using (x, y) join o using (x, y) group by x, y, year""",
)
def _(spark, sf):
    return temporal.seasonal_metrics(obs(spark, sf), "delta_h")


_FEATURES_SQL = f"""with {FUSED}, q as (select *, avg(lwe_mo) over (partition by x, y order by month_idx range between 2 preceding and current row) as lwe_quarterly_avg from fused),
    s as (select *, avg(delta_h) over r as pixel_mean_delta_h, delta_h - lag(delta_h) over w as step, month_idx - lag(month_idx) over w as gap,
      surface_slope - lag(surface_slope) over w as surface_slope_change, t_star_mo - avg(t_star_mo) over r as thermal_anomaly,
      so_mo - avg(so_mo) over r as salinity_stratification_proxy,
      avg(t_star_mo) over (partition by x, y order by month_idx range between 5 preceding and current row) as t_star_6mo_avg,
      avg(delta_h) over (partition by mascon_id, month_idx) as mascon_mean_delta_h from q {_W}),
    m as (select *, case when gap = 1 then step end as delta_h_momentum from s)
    select x, month_idx, pixel_mean_delta_h, delta_h - pixel_mean_delta_h as delta_h_deviation, surface_slope_change, delta_h_momentum,
      step / nullif(gap / 12.0::double, 0) as delta_h_rate,
      case when gap = 1 then delta_h_momentum - lag(delta_h_momentum) over (partition by x, y order by month_idx) end as delta_h_acceleration,
      t_star_6mo_avg, thermal_anomaly, salinity_stratification_proxy, lwe_mo - lwe_quarterly_avg as lwe_trend, mascon_mean_delta_h,
      round((delta_h - avg(delta_h) over g) / nullif(stddev_samp(delta_h) over g, 0), 6) as regional_delta_h_percentile
    from m window g as (partition by regional_subset_id, month_idx)"""
_FEATURES = [
    "x", "month_idx", "pixel_mean_delta_h", "delta_h_deviation", "surface_slope_change", "delta_h_momentum", "delta_h_rate",
    "delta_h_acceleration", "t_star_6mo_avg", "thermal_anomaly", "salinity_stratification_proxy", "lwe_trend",
    "mascon_mean_delta_h", "regional_delta_h_percentile",
]


def _features(df):
    return df.withColumn("regional_delta_h_percentile", F.round("regional_delta_h_percentile", 6)).select(*_FEATURES)


@query("temporal_features", _FEATURES_SQL)
def _(spark, sf):
    return _features(temporal.temporal_features(settle(quarterly_stats(fused(spark, sf), ["lwe_mo"]))))


@query("temporal_features_bucketed", _FEATURES_SQL)
def _(spark, sf):
    """From the stored table, whose buckets the pixel windows use as they are."""
    name = f"facts_{uuid.uuid4().hex}"
    stored = write_bucketed(quarterly_stats(fused(spark, sf), ["lwe_mo"]), name, scratch_path(spark, "facts"), 16)
    return _features(temporal.temporal_features(stored))


@query("temporal_features_by_month", _FEATURES_SQL)
def _(spark, sf):
    """All but the last twelve months in one run, those added one by one from the pixels' state."""
    base, root = settle(quarterly_stats(fused(spark, sf), ["lwe_mo"])), scratch_path(spark, "monthly")
    months = [r.month_idx for r in base.select("month_idx").distinct().orderBy("month_idx").collect()]  # one row per month
    old, last = months[:-12], F.lit(months[-13])
    history = base.where(F.col("month_idx") <= last)
    start(temporal.temporal_features(history), history, root, old[-1])
    for before, month in zip(months[-13:], months[-12:]):
        add_month(base.where(F.col("month_idx") == month), root, month, before)
    return _features(spark.read.parquet(f"{root}/features"))


_NEAR = "(1.0::double / (1.0::double + {0} / 1000.0::double))"
_RETRO = "cast(surface_dx * bed_dx + surface_dy * bed_dy < 0 and bed < 0 as int)"
_PHYSICS = {
    "thermal_driving_x_draft": "t_star_mo * ice_draft",
    "draft_x_thermal_access": f"round(ice_draft * {_NEAR.format('dist_to_ocean')}, 6)",
    "grounding_line_vulnerability": f"round(greatest(-bed, 0)::double * {_NEAR.format('dist_to_grounding_line')}, 6)",
    "retrograde_flag": _RETRO,
    "ocean_heat_content_proxy": "1027.0::double * 3985.0::double * (thetao_mo - t_f_mo) * clamped_depth",
    "draft_ratio": "ice_draft / nullif(thickness, 0)",
    "thermal_x_gl_proximity": f"round(t_star_mo * {_NEAR.format('dist_to_grounding_line')}, 6)",
    "freezing_departure": "thetao_mo - t_f_mo",
    "bed_geometry_risk": f"({_RETRO} * bed_slope * greatest(-bed, 0))::double",
    "mass_flux_proxy": "thickness * surface_slope",
}
_INEXACT = ("draft_x_thermal_access", "grounding_line_vulnerability", "thermal_x_gl_proximity")


def _physics(name):
    def plan(spark, sf):
        out = physics_features(fused(spark, sf))
        return out.select("x", "month_idx", (F.round(name, 6) if name in _INEXACT else F.col(name)).alias(name))

    return plan


# One query per feature; all come from the same stage.
for _name, _sql in _PHYSICS.items():
    query(_name, f"with {FUSED} select x, month_idx, {_sql} as {_name} from fused")(_physics(_name))

# Label, splits, weights. The observations run from 1995 to 2001.
_TRAIN_END, _VAL_END = 1999 * 12 + 12, 2000 * 12 + 12
_QUARTER = f"""{OBS}, q as (select *, avg(lwe_mo) over (partition by x, y order by month_idx range between 2 preceding and current row) as lwe_quarterly_avg from obs)"""
LABELLED = f"""{_QUARTER},
  lm as (select mascon_id, avg(lwe_quarterly_avg) - 0.5 * stddev_samp(lwe_quarterly_avg) as lim from q where month_idx <= {_TRAIN_END} group by 1),
  lr as (select regional_subset_id, avg(delta_h) - 0.5 * stddev_samp(delta_h) as lim from q where month_idx <= {_TRAIN_END} group by 1),
  labelled as (select q.*, case when lwe_quarterly_avg is not null and delta_h is not null and lm.lim is not null and lr.lim is not null
    then cast(lwe_quarterly_avg < lm.lim and delta_h < lr.lim as int) end as basal_loss_agreement
    from q left join lm using (mascon_id) left join lr using (regional_subset_id))"""


def labelled(spark, sf):
    rows = settle(quarterly_stats(obs(spark, sf), ["lwe_mo"]))
    return labels.agreement_label(rows, 0.5, stats_from=rows.filter(F.col("month_idx") <= _TRAIN_END))


@query("agreement_label", f"with {LABELLED} select x, month_idx, basal_loss_agreement from labelled")
def _(spark, sf):
    return labelled(spark, sf).select("x", "month_idx", "basal_loss_agreement")


@query(
    "temporal_split",
    f"with {OBS} select x, month_idx, case when month_idx <= {_TRAIN_END} then 'train' when month_idx <= {_VAL_END} then 'val' else 'test' end as split from obs",
)
def _(spark, sf):
    return splits.temporal_split(obs(spark, sf), _TRAIN_END, _VAL_END).select("x", "month_idx", "split")


_DRAW = uniform_sql(["x", "y", "month_idx"], 42)


@query(
    "undersample",
    f"""with {LABELLED} select x, month_idx, basal_loss_agreement from labelled where basal_loss_agreement = 1 or (basal_loss_agreement = 0 and {_DRAW} <
      (select count(*) filter (where basal_loss_agreement = 1) * 10.0::double / nullif(count(*) filter (where basal_loss_agreement = 0), 0) from labelled))""",
)
def _(spark, sf):
    rows = settle(labelled(spark, sf))
    return splits.undersample(rows).select("x", "month_idx", "basal_loss_agreement")


@query(
    "undersample_by_region",
    f"""with {LABELLED}, s as (select regional_subset_id, count(*) filter (where basal_loss_agreement = 1)
      * case regional_subset_id when 'ASIA' then 5.0::double when 'EUROPE' then 2.0::double else 10.0::double end
      / nullif(count(*) filter (where basal_loss_agreement = 0), 0) as share from labelled group by 1)
    select x, month_idx, labelled.regional_subset_id, basal_loss_agreement from labelled left join s on labelled.regional_subset_id is not distinct from s.regional_subset_id
    where basal_loss_agreement = 1 or (basal_loss_agreement = 0 and {_DRAW} < share)""",
)
def _(spark, sf):
    rows = settle(labelled(spark, sf))
    return splits.undersample(rows, ratio=10.0, ratios={"ASIA": 5.0, "EUROPE": 2.0}).select("x", "month_idx", "regional_subset_id", "basal_loss_agreement")


@query(
    "sample_weights",
    f"""with {LABELLED}, k as (select * from labelled where basal_loss_agreement is not null and regional_subset_id is not null),
    c as (select basal_loss_agreement, count(*) as n from k group by 1),
    r as (select regional_subset_id, count(*) as n from k group by 1), t as (select count(*) as n from k)
    select x, month_idx, round(t.n / ((select count(*) from c) * c.n) * (t.n / ((select count(*) from r) * r.n)), 6) as weight
    from labelled l left join c on c.basal_loss_agreement = l.basal_loss_agreement left join r on r.regional_subset_id = l.regional_subset_id, t""",
)
def _(spark, sf):
    return labels.sample_weights(settle(labelled(spark, sf))).select("x", "month_idx", F.round("weight", 6).alias("weight"))


@query(
    "quality_weights",
    """select l_orderkey, l_linenumber, l_partkey, round(1 / (l_tax * l_tax + 0.000001::double), 6) as precision_weight,
       round(l_quantity / (1 + l_discount), 6) as density_weight from lineitem""",
)
def _(spark, sf):
    lines = labels.quality_weights(table(spark, sf, "lineitem"), "l_tax", "l_quantity", "l_discount")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(c) for c in ("precision_weight", "density_weight")])


@query(
    "oof_split",
    f"""with {OBS} select case when {uniform_sql(["x", "y"], 42)} < 0.5 then 'a' else 'b' end as fold, count(*) as n, count(distinct x) as n_pixels from obs group by 1""",
)
def _(spark, sf):
    first, second = splits.oof_split(settle(obs(spark, sf)))
    tagged = first.withColumn("fold", F.lit("a")).unionByName(second.withColumn("fold", F.lit("b")))
    return tagged.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("n_pixels"))


_CV_START, _CV_END = 1999 * 12 + 1, 2000 * 12 + 12


@query(
    "expanding_folds",
    f"""with {OBS}, f as (select unnest(range({_CV_START}, {_CV_END}, 3)) as last),
    g as (select last, cast((last - {_CV_START}) // 3 as int) as fold from f)
    select fold, case when month_idx <= last then 'train' else 'val' end as role, count(*) as n, min(month_idx) as first_month, max(month_idx) as last_month
    from obs, g where month_idx <= least(last + 3, {_CV_END}) group by 1, 2""",
)
def _(spark, sf):
    # Counted per month first, so the fold memberships multiply a handful of rows.
    months = obs(spark, sf).groupBy("month_idx").agg(F.count(F.lit(1)).alias("rows"))
    return splits.expanding_folds(months, _CV_START, _CV_END).groupBy("fold", "role").agg(
        F.sum("rows").alias("n"), F.min("month_idx").alias("first_month"), F.max("month_idx").alias("last_month")
    )


@query(
    "region_folds",
    f"with {OBS} select regional_subset_id as held_out, cast((select count(*) from obs) - count(*) as bigint) as n_train, count(*) as n_val from obs group by 1",
)
def _(spark, sf):
    return splits.region_folds(obs(spark, sf))
