"""Preprocessing, models and evaluation on the given tables.

Models are trained with their presets, on all their rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from polarframe.ml import evaluate as ev
from polarframe.ml import clusters, compare, models, prep, stages, studies, trees
from polarframe.operators import labels, splits, temporal
from polarframe.operators.distribute import even, scratch_path, settle
from polarframe.operators.fusion import quarterly_stats
from polarframe.plans.bindings import FUSED, OBS, SCORED, fused, obs, pixel_geometry, scored, table, uniform_sql
from polarframe.plans.feature_queries import LABELLED
from polarframe.plans.registry import query

TRAIN_END, VAL_END = 1999 * 12 + 12, 2000 * 12 + 12
LABEL = labels.LABEL
NUMERIC = [
    "t_star_mo", "ice_draft", "dist_to_grounding_line", "delta_h_momentum", "lwe_trend", "thetao_mo", "so_mo", "t_f_mo",
    "thickness", "surface_slope", "t_star_6mo_avg", "pixel_mean_delta_h",
]


_KEPT: dict[tuple, object] = {}


def _once(spark, sf, name, make):
    """What ``make`` returns, made once per application and directory: queries about one model share its table and its fit."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def ml_table(spark, sf):
    """Features, label, split and weight; written because labels, weights and models read it many times."""
    return _once(spark, sf, "ml_table", lambda: _ml_table(spark, sf))


def _ml_table(spark, sf):
    pixels = even(fused(spark, sf), temporal.PIXEL, table(spark, sf, "lineitem").count())
    base = quarterly_stats(pixels, ["lwe_mo"])
    features = temporal.lwe_trend(temporal.trailing_mean(temporal.momentum(temporal.expanding_mean(base, "delta_h"), "delta_h"), "t_star_mo", 6))
    rows = settle(splits.temporal_split(features, TRAIN_END, VAL_END))
    labelled = labels.agreement_label(rows, stats_from=rows.filter("split = 'train'")).filter(F.col(LABEL).isNotNull())
    weighted = labels.sample_weights(labelled)
    doubles = {c: F.col(c).cast("double") for c in NUMERIC}
    return settle(weighted.withColumns(doubles).select("x", "y", "month_idx", "mascon_id", "regional_subset_id", "split", "weight", LABEL, "delta_h", *NUMERIC))


def _split(df):
    return [df.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


def _fit_rows(prepared, rows):
    """The undersampled rows with what a learner reads, written once; nothing is skipped after imputation, so they are drawn before it."""
    return settle(prepared.transform(splits.undersample(rows)).select("features", "weight", LABEL))


def _columns(df, vector, names, digits=6):
    """Entries of a vector column as plain columns."""
    array = vector_to_array(F.col(vector))
    return df.withColumns({n: F.round(array.getItem(i), digits) + 0.0 for i, n in enumerate(names)})


# ---- preprocessing


@query(
    "impute_median",
    f"""with {OBS} select x, month_idx, coalesce(thetao_mo, (select quantile_disc(thetao_mo, 0.5) from obs))::double as thetao_mo_imputed,
      coalesce(so_mo, (select quantile_disc(so_mo, 0.5) from obs))::double as so_mo_imputed from obs""",
)
def _(spark, sf):
    out = prep.fill_median(obs(spark, sf), ["thetao_mo", "so_mo"])
    return out.select("x", "month_idx", "thetao_mo_imputed", "so_mo_imputed")


@query(
    "impute_median_stage",
    f"""with {OBS} select x, month_idx, coalesce(thetao_mo, (select quantile_disc(thetao_mo, 0.5) from obs))::double as thetao_mo_imputed from obs""",
)
def _(spark, sf):
    rows = settle(obs(spark, sf).withColumn("thetao_mo", F.col("thetao_mo").cast("double")))
    return prep.impute_median(["thetao_mo"]).fit(rows).transform(rows).select("x", "month_idx", "thetao_mo_imputed")


@query(
    "gl_buckets",
    f"""with {FUSED} select x, case when dist_to_grounding_line < 5000 then 0 when dist_to_grounding_line < 20000 then 1
      when dist_to_grounding_line < 50000 then 2 when dist_to_grounding_line < 100000 then 3 else 4 end::double as gl_bucket_idx from geometry""",
)
def _(spark, sf):
    pixels = pixel_geometry(spark, sf).withColumn("dist_to_grounding_line", F.col("dist_to_grounding_line").cast("double"))
    return prep.gl_buckets().transform(pixels).select("x", "gl_bucket_idx")


_INDEX = "i as (select regional_subset_id, (row_number() over (order by count(*) desc, regional_subset_id) - 1)::double as region_index from obs group by 1)"


@query("index_region", f"with {OBS}, {_INDEX} select x, month_idx, region_index from obs join i using (regional_subset_id)")
def _(spark, sf):
    rows = settle(obs(spark, sf).select("x", "month_idx", "regional_subset_id"))
    return prep.index_region().fit(rows).transform(rows).select("x", "month_idx", "region_index")


@query(
    "one_hot",
    f"with {OBS}, {_INDEX} select x, month_idx, " + ", ".join(f"(region_index = {i})::int::double as r{i}" for i in range(5)) + " from obs join i using (regional_subset_id)",
)
def _(spark, sf):
    rows = settle(obs(spark, sf).select("x", "month_idx", "regional_subset_id"))
    stages = [prep.index_region(), prep.one_hot({"region_index": "region_ohe"})]
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    return _columns(out, "region_ohe", [f"r{i}" for i in range(5)]).select("x", "month_idx", *[f"r{i}" for i in range(5)])


@query("assemble", f"with {OBS} select regional_subset_id, count(*) as n from obs where thetao_mo is not null and so_mo is not null group by 1")
def _(spark, sf):
    out = prep.assemble(["delta_h", "thetao_mo", "so_mo"]).transform(obs(spark, sf))
    return out.groupBy("regional_subset_id").agg(F.count("raw_features").alias("n"))


_SCALED = ["delta_h", "lwe_mo", "surface_slope"]


def _scaled(spark, sf, stage):
    raw = prep.assemble(_SCALED).transform(obs(spark, sf).select("x", "month_idx", *_SCALED))
    rows = settle(raw)
    fitted = stage.fit(rows) if hasattr(stage, "fit") else stage
    return _columns(fitted.transform(rows), "features", _SCALED).select("x", "month_idx", *_SCALED)


@query(
    "minmax",
    f"with {OBS}, e as (select " + ", ".join(f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _SCALED) + " from obs) select x, month_idx, "
    + ", ".join(f"round(case when hi_{c} = lo_{c} then 0.5 else ({c} - lo_{c}) / (hi_{c} - lo_{c}) end, 6)::double as {c}" for c in _SCALED) + " from obs, e",
)
def _(spark, sf):
    return _scaled(spark, sf, prep.minmax())


@query(
    "standardize",
    f"with {OBS}, e as (select " + ", ".join(f"avg({c}) as mu_{c}, stddev_samp({c}) as sd_{c}" for c in _SCALED) + " from obs) select x, month_idx, "
    + ", ".join(f"round(coalesce(({c} - mu_{c}) / nullif(sd_{c}, 0), 0), 6) as {c}" for c in _SCALED) + " from obs, e",
)
def _(spark, sf):
    return _scaled(spark, sf, prep.standardize())


_NORM = "sqrt((" + " + ".join(f"{c} * {c}" for c in _SCALED) + ")::double)"


@query("l2_normalize", f"with {OBS} select x, month_idx, " + ", ".join(f"round(coalesce({c} / nullif({_NORM}, 0), 0), 6) as {c}" for c in _SCALED) + " from obs")
def _(spark, sf):
    return _scaled(spark, sf, prep.l2_normalize())


# Order of the expansion's terms for inputs a, b, c.
_TERMS = ["a", "a * a", "b", "a * b", "b * b", "c", "a * c", "b * c", "c * c"]


@query(
    "poly_triple",
    f"with {FUSED}, t as (select x, month_idx, t_star_mo::double as a, ice_draft::double as b, dist_to_grounding_line::double as c from fused where t_star_mo is not null) "
    "select x, month_idx, " + ", ".join(f"{t} as t{i}" for i, t in enumerate(_TERMS)) + " from t",
)
def _(spark, sf):
    rows = prep.assemble(prep.POLY_TRIPLE, "poly_input").transform(fused(spark, sf))
    out = prep.poly_triple().transform(rows)
    array = vector_to_array(F.col("poly_features"))
    return out.select("x", "month_idx", *[array.getItem(i).alias(f"t{i}") for i in range(len(_TERMS))])


def _ocean(spark, sf):
    wet = quarterly_stats(fused(spark, sf).filter("thetao_mo is not null"), ["t_star_mo", "thetao_mo"])
    return settle(prep.assemble(prep.OCEAN_EIGHT, "ocean_vec").transform(wet).select("x", "month_idx", "ocean_vec"))


_EIGHT_SQL = " + ".join(f"{c} * {c}" for c in prep.OCEAN_EIGHT)


@query(
    "ocean_pca_norms",
    f"""with {FUSED}, q as (select *, avg(t_star_mo) over w as t_star_quarterly_avg, stddev_samp(t_star_mo) over w as t_star_quarterly_std,
      avg(thetao_mo) over w as thetao_quarterly_avg, stddev_samp(thetao_mo) over w as thetao_quarterly_std from fused where thetao_mo is not null
      window w as (partition by x, y order by month_idx range between 2 preceding and current row))
    select x, month_idx, round(sqrt({_EIGHT_SQL}), 6) as norm from q where t_star_quarterly_std is not null""",
)
def _(spark, sf):
    # All eight components together only rotate a row.
    rows = _ocean(spark, sf)
    rotated = prep.ocean_pca(k=8).fit(rows).transform(rows)
    squares = F.transform(vector_to_array(F.col("ocean_pca")), lambda v: v * v)
    return rotated.select("x", "month_idx", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)), 6).alias("norm"))


@query("ocean_pca")
def _(spark, sf):
    rows = _ocean(spark, sf)
    model = prep.ocean_pca().fit(rows)
    return _columns(model.transform(rows), "ocean_pca", ["pc1", "pc2", "pc3", "pc4"]).select("x", "month_idx", "pc1", "pc2", "pc3", "pc4")


def _vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") == 0).cast("int").alias("label"), F.col("label").alias("class")
    )
    return settle(rows)


@query("svd_project")
def _(spark, sf):
    out = prep.svd_project(_vectors(spark, sf), k=20)
    return out.select("vec_id", F.transform(vector_to_array(F.col("svd_features")), lambda v: F.round(v, 6)).alias("z"))


@query("svd_row_norms", "select vec_id, round(sqrt(sum(v * v)), 6) as norm from (select vec_id, unnest(embedding)::double as v from embeddings) group by vec_id")
def _(spark, sf):
    # All components together only rotate a row.
    out = prep.svd_project(_vectors(spark, sf), k=64)
    squares = F.transform(vector_to_array(F.col("svd_features")), lambda v: v * v)
    return out.select("vec_id", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)), 6).alias("norm"))


@query(
    "svd_stage_norms",
    "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 5) as norm from embeddings where embedding is not null",
)
def _(spark, sf):
    """The projection onto all components keeps every length, also by a pipeline that was saved and loaded again."""
    rows, path = _vectors(spark, sf), scratch_path(spark, "pipeline")
    Pipeline(stages=[stages.Svd(k=1 << 20)]).fit(rows).write().save(path)
    out = PipelineModel.load(path).transform(rows).select("vec_id", vector_to_array("svd_features").alias("z"))
    return out.select("vec_id", F.round(F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)), 5).alias("norm"))


@query("svd_explained_variance")
def _(spark, sf):
    rows = _vectors(spark, sf)
    out = prep.fit_svd(rows, k=20).explained_variance(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("singular_value", "cumulative")})


@query(
    "svd_energy",
    """select count(*) as n_components, round(sum(e), 3) as energy, 1.0::double as cumulative
       from (select i, sum(v * v) as e from (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) group by i)""",
)
def _(spark, sf):
    """All singular values together hold the square sum of the data."""
    rows = _vectors(spark, sf)
    parts = prep.fit_svd(rows, k=1 << 20).explained_variance(rows)
    return parts.agg(
        F.count(F.lit(1)).alias("n_components"), F.round(F.sum(F.col("singular_value") * F.col("singular_value")), 3).alias("energy"),
        F.round(F.max("cumulative"), 6).alias("cumulative"),
    )


def _prepared(kind):
    def plan(spark, sf):
        train, _, test = _split(ml_table(spark, sf))
        numeric = NUMERIC if kind != "classic" else NUMERIC + ["lwe_x_draft"]
        add = lambda d: d.withColumn("lwe_x_draft", F.col("lwe_trend") * F.col("ice_draft"))
        model = prep.build_pipeline(kind, numeric).fit(add(train))
        return model.transform(add(test)).select("x", "month_idx", F.size(vector_to_array(F.col("features"))).alias("width"))

    return plan


def _test_rows_sql(width: str) -> str:
    """Every labelled test row has a feature vector of one width: nothing is skipped after imputation."""
    return f"with {LABELLED} select x, month_idx, cast({width} as int) as width from labelled where month_idx > {VAL_END} and {LABEL} is not null"


_REGIONS = f"(select count(distinct regional_subset_id) from labelled where month_idx <= {TRAIN_END} and {LABEL} is not null)"


# Width: numeric columns, five distance classes, the regions and one place for an unseen one; classic has one more
# column, nine polynomial terms and four ocean components.
_WIDTHS = {"xgb": len(NUMERIC) + 6, "classic": len(NUMERIC) + 1 + 6 + 9 + 4, "stack": len(NUMERIC) + 6}

for _kind in ("xgb", "classic", "stack"):
    query(f"preprocess_{_kind}", _test_rows_sql(f"{_WIDTHS[_kind]} + {_REGIONS}"))(_prepared(_kind))


def _stacked(spark, sf, **extra):
    train, val, test = _split(ml_table(spark, sf))
    base = {"Base_RF": models.base_rf(), "Base_GBT": models.base_gbt()}
    return models.train_stack(train, val, test, NUMERIC, base=base, **extra)


def _meta_rows(spark, sf):
    """The training rows' meta-features by base learners that were fitted on all of them."""

    def make():
        train, _, _ = _split(ml_table(spark, sf))
        context = [prep.imputed(c) for c in prep.META_CONTEXT]
        prepared = settle(prep.build_pipeline("stack", NUMERIC).fit(train).transform(train).select("x", "month_idx", "features", "weight", LABEL, *context))
        base = Pipeline(stages=[models.base_rf(), models.base_gbt()]).fit(prepared)
        return settle(prep.meta_features(base.transform(prepared)).select("x", "month_idx", "meta_features", "weight", LABEL))

    return _once(spark, sf, "meta-rows", make)


@query("meta_features")
def _(spark, sf):
    return _columns(_meta_rows(spark, sf), "meta_features", prep.META_NAMES).select("x", "month_idx", *prep.META_NAMES)


# ---- models


def _rounded_metrics(df):
    return df.withColumns({m: F.round(m, 6) for m in ev.METRICS})


def _boosted_metrics(spark, sf, presets):
    train, val, test = _split(ml_table(spark, sf))
    prepared = prep.build_pipeline("xgb", NUMERIC).fit(train)
    sides = {n: settle(prepared.transform(d).select(*splits.ROW_KEY, "features", "weight", LABEL)) for n, d in (("train", train), ("val", val), ("test", test))}
    fit_rows = settle(splits.undersample(sides["train"]))
    rows = []
    for name, preset in presets.items():
        model = models.boosted(preset).fit(fit_rows)
        rows += [ev.to_scores(model.transform(d), name, n, LABEL) for n, d in sides.items()]
    return ev.evaluate_all(rows)


@query("boosted_baseline")
def _(spark, sf):
    return _rounded_metrics(_boosted_metrics(spark, sf, {"baseline": "baseline"}))


@query("boosted_tuned")
def _(spark, sf):
    return _rounded_metrics(_boosted_metrics(spark, sf, {"baseline": "baseline", "tuned": "tuned_code"}))


def _base_learner(spark, sf, stage):
    train, _, test = _split(ml_table(spark, sf))
    prepared = prep.build_pipeline("stack", NUMERIC).fit(train)
    fitted = stage.fit(_fit_rows(prepared, train))
    prefix = stage.getPredictionCol().split("_")[0]
    scored = fitted.transform(prepared.transform(test)).withColumn("score", ev.positive_probability(f"{prefix}_probability"))
    return scored.select("x", "month_idx", F.round("score", 6).alias("score"), F.col(stage.getPredictionCol()).alias("prediction"))


@query("base_rf")
def _(spark, sf):
    return _base_learner(spark, sf, models.base_rf())


@query("base_gbt")
def _(spark, sf):
    return _base_learner(spark, sf, models.base_gbt())


# ---- tree models as tables of nodes

_ID = ["x", "y", "month_idx"]


def _audit_sql(n_trees: int) -> str:
    """Every labelled test row has a stored score, and the walk through the table of nodes gives the same one."""
    return f"""with {LABELLED} select regional_subset_id, count(*) as n, count(*) as n_equal, {n_trees}::bigint as trees
      from labelled where month_idx > {VAL_END} and {LABEL} is not null group by 1"""


def _fitted(spark, sf, name, kind, stage):
    """(model, scored test rows) of one learner with its pipeline."""

    def make():
        train, _, test = _split(ml_table(spark, sf))
        prepared = prep.build_pipeline(kind, NUMERIC).fit(train)
        model = stage.fit(_fit_rows(prepared, train))
        kept = [*_ID, "regional_subset_id", "features", model.getProbabilityCol()]
        return model, settle(model.transform(prepared.transform(test)).select(*kept))

    return _once(spark, sf, name, make)


def _audit(spark, sf, name, kind, stage):
    model, rows = _fitted(spark, sf, name, kind, stage)
    audit = trees.audited(model, rows, [*_ID, "regional_subset_id"], "features", vector_to_array(model.getProbabilityCol())[1])
    return trees.agreement(audit, ["regional_subset_id"])


_AUDITED = {
    "boosted_baseline": ("xgb", lambda: models.boosted("baseline"), models.PRESETS["baseline"]["n_estimators"]),
    "boosted_tuned": ("xgb", lambda: models.boosted("tuned_code"), models.PRESETS["tuned_code"]["n_estimators"]),
    "base_rf": ("stack", models.base_rf, 100),
    "base_gbt": ("stack", models.base_gbt, 50),
}

for _name, (_kind, _stage, _n) in _AUDITED.items():
    query(f"{_name}_nodes", _audit_sql(_n))(lambda spark, sf, a=(_name, _kind, _stage): _audit(spark, sf, a[0], a[1], a[2]()))


def _stack_test(spark, sf):
    """The test rows with what the stack's base learners say of them, without intermediate columns."""

    def make():
        result = _stack(spark, sf)
        rows = result.preprocess.transform(_split(ml_table(spark, sf))[2])
        for base in result.base:
            rows = base.transform(rows)
        scores = [f"{m}_{c}" for m in ("rf", "gbt") for c in ("rawPrediction", "probability", "prediction")]
        return settle(rows.select(*_ID, "features", *[prep.imputed(c) for c in prep.META_CONTEXT], *scores))

    return _once(spark, sf, "stack-test", make)


@query("stack_nodes", f"select name as model, n, n as n_equal, t::bigint as trees from (values ('Base_RF', 100), ('Base_GBT', 50), ('Stack_LR_Baseline', 0), ('Stack_Boosted', 100)) v(name, t),"
       f" (with {LABELLED} select count(*) as n from labelled where month_idx > {VAL_END} and {LABEL} is not null) c")
def _(spark, sf):
    """A whole stack scored again from tables: base learners and a boosted meta-learner from nodes, a linear one from its coefficients."""
    result = _stack(spark, sf)
    rows = _stack_test(spark, sf)
    joined = settle(prep.meta_features(rows).select(*_ID, "meta_features"))
    checked = []
    for name, base, column in zip(("Base_RF", "Base_GBT"), result.base, ("rf_probability", "gbt_probability")):
        checked.append(trees.audited(base.stages[-1], rows, _ID, "features", vector_to_array(column)[1]).withColumn("model", F.lit(name)))
    for name, meta in result.meta.items():
        scored, model = settle(meta.transform(joined)), meta.stages[-1]
        stored = vector_to_array("probability")[1]
        if hasattr(model, "coefficients"):
            terms = F.zip_with(vector_to_array("meta_features"), F.lit([float(c) for c in model.coefficients]), lambda x, w: x * w)
            margin = F.aggregate(terms, F.lit(float(model.intercept)), lambda a, b: a + b)
            again = scored.select(*_ID, stored.alias("stored"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("walked"), F.lit(0).cast("bigint").alias("trees"))
        else:
            again = trees.audited(model, scored, _ID, "meta_features", stored)
        checked.append(again.withColumn("model", F.lit(name)))
    return trees.agreement(ev.results_table(checked), ["model"])


_MASS_ROWS = f"""{OBS}, b as (select mascon_id, month_idx, avg(delta_h) as d, avg(lwe_mo) as l from obs group by 1, 2),
  f as (select a.mascon_id, a.month_idx, a.l - p.l as mass_change from b a join b p on p.mascon_id = a.mascon_id and p.month_idx = a.month_idx - 1
    join b q on q.mascon_id = a.mascon_id and q.month_idx = a.month_idx - 2 join b r on r.mascon_id = a.mascon_id and r.month_idx = a.month_idx - 3
    where a.d is not null and p.d is not null and q.d is not null and r.d is not null)"""


def _mass(spark, sf, algo):
    return _once(spark, sf, f"mass_{algo}", lambda: _mass_fit(spark, sf, algo))


def _mass_fit(spark, sf, algo):
    model, predicted = studies.mass_regression(settle(obs(spark, sf)), algo, TRAIN_END)
    rows = settle(predicted.where("prediction is not null").select("mascon_id", "month_idx", "features", "prediction", "mass_change"))
    keys = ["mascon_id", "month_idx"]
    return rows, settle(trees.audited(model.stages[-1], rows, keys, "features", F.col("prediction")))


@query("mass_regression_nodes", f"with {_MASS_ROWS} select mascon_id, count(*) as n, count(*) as n_equal, 20::bigint as trees from f group by 1")
def _(spark, sf):
    return trees.agreement(_mass(spark, sf, "gbt")[1], ["mascon_id"])


@query("mass_skill_nodes", f"with {_MASS_ROWS} select mascon_id, count(*) as n, true as same_r2, 20::bigint as trees from f where mass_change is not null group by 1")
def _(spark, sf):
    """The explained share per mascon from stored predictions, and the same from predictions walked through the forest's nodes."""
    rows, audit = _mass(spark, sf, "rf")
    both = rows.join(audit, ["mascon_id", "month_idx"])
    r2 = lambda p: studies.grouped_r2(both, ["mascon_id"], "mass_change", p)
    n_trees = audit.groupBy("mascon_id").agg(F.max("trees").alias("trees"))
    pair = r2("prediction").join(r2("walked").select("mascon_id", F.col("r2").alias("again")), "mascon_id").join(n_trees, "mascon_id")
    same = F.col("r2").eqNullSafe(F.col("again")) | (F.abs(F.col("r2") - F.col("again")) <= 1e-6 * F.greatest(F.abs("r2"), F.lit(1.0)))
    return pair.select("mascon_id", "n", same.alias("same_r2"), "trees")


def _default_stack(spark, sf):
    return _once(spark, sf, "default-stack", lambda: _stacked(spark, sf))


def _stack(spark, sf):
    return _once(spark, sf, "stack", lambda: _stacked(spark, sf, meta={"Stack_LR_Baseline": models.meta_lr("baseline"), "Stack_Boosted": models.meta_boosted()}))


@query("meta_features_nodes", f"with {LABELLED} select count(*) as n, count(*) as n_equal from labelled where month_idx > {VAL_END} and {LABEL} is not null")
def _(spark, sf):
    """The three base entries of every meta-feature vector, made again from scores that the tables of nodes give."""
    result = _stack(spark, sf)
    rows = _stack_test(spark, sf)
    named = _columns(prep.meta_features(rows), "meta_features", prep.META_NAMES[:3], 9).select(*_ID, *prep.META_NAMES[:3])
    for base, column, name in zip(result.base, ("rf_probability", "gbt_probability"), ("a", "b")):
        walked = trees.audited(base.stages[-1], rows, _ID, "features", vector_to_array(column)[1]).select(*_ID, F.col("walked").alias(name))
        named = named.join(walked, _ID)
    agree = ((F.col("a") > 0.5) == (F.col("b") > 0.5)).cast("double")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 1e-8
    same = near(prep.META_NAMES[0], "a") & near(prep.META_NAMES[1], "b") & (F.col(prep.META_NAMES[2]) == agree)
    return named.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"))


@query(
    "meta_coefficients_gradient",
    "select unnest(['intercept', " + ", ".join(f"'{n}'" for n in prep.META_NAMES) + "]) as name, 0.0::double as gradient",
)
def _(spark, sf):
    """The coefficients of a linear meta-learner are its optimum: the loss has no slope there. Fitted on the training rows' meta-features."""
    result = _stack(spark, sf)
    rows = result.preprocess.transform(_split(ml_table(spark, sf))[0])
    for base in result.base:
        rows = base.transform(rows)
    rows = settle(prep.meta_features(rows).select("meta_features", "weight", LABEL))
    model = models.meta_lr("baseline").fit(rows)
    return ev.gradient(model.transform(rows), model, LABEL, "weight", prep.META_NAMES).withColumn("gradient", F.round(F.abs("gradient"), 3))


@query("svd_logistic_gradient", "select unnest(range(21)) as i, 0.0::double as gradient")
def _(spark, sf):
    rows = _vectors(spark, sf)
    svd, model = models.train_svd_lr(rows, k=20, label="label", weight=None)
    projected = svd.transform(rows)
    out = ev.gradient(model.transform(projected), model.stages[-1], "label")
    place = F.when(F.col("name") == "intercept", F.lit(0)).otherwise(F.substring("name", 2, 9).try_cast("int") + 1)
    return out.select(place.cast("bigint").alias("i"), F.round(F.abs("gradient"), 3).alias("gradient"))


_SPLITS_SQL = f"""{LABELLED}, r as (select case when month_idx <= {TRAIN_END} then 'train' when month_idx <= {VAL_END} then 'val' else 'test' end as split, {LABEL} as y, regional_subset_id
  from labelled where {LABEL} is not null)"""


def _comparison(spark, sf):
    def make():
        sides = dict(zip(("train", "val", "test"), _split(ml_table(spark, sf))))
        return compare.compare_models(sides, NUMERIC, {"boosted": ("xgb", models.boosted("baseline")), "forest": ("stack", models.base_rf()), "gbt": ("stack", models.base_gbt())})

    return _once(spark, sf, "comparison", make)


@query(
    "model_comparison",
    f"""with {_SPLITS_SQL}, m as (select unnest(['boosted', 'forest', 'gbt']) as model)
    select model, split, true as in_range from m cross join (select distinct split from r)""",
)
def _(spark, sf):
    """One row per model and split; metrics lie in [0, 1]. The values themselves are in ``Comparison.metrics``."""
    inside = F.lit(True)
    for name in ev.METRICS:
        inside = inside & (F.col(name).isNull() | F.col(name).between(0.0, 1.0))
    return _comparison(spark, sf).metrics.select("model", "split", inside.alias("in_range"))


@query(
    "model_comparison_regions",
    f"""with {_SPLITS_SQL}, m as (select unnest(['boosted', 'forest', 'gbt']) as model)
    select model, regional_subset_id, round(avg(y::double), 9) as true_rate, count(*) as n from m cross join r where split = 'test' group by 1, 2""",
)
def _(spark, sf):
    return _comparison(spark, sf).regional.select("model", "regional_subset_id", F.round("true_rate", 9).alias("true_rate"), "n")


@query("meta_lr")
def _(spark, sf):
    rows = _meta_rows(spark, sf)
    fitted = {p: models.meta_lr(p).fit(rows) for p in ("baseline", "tuned")}
    return _rounded_metrics(ev.evaluate_all([ev.to_scores(m.transform(rows), f"lr_{p}", "train", LABEL) for p, m in fitted.items()]))


@query(
    "meta_lr_balance",
    f"with {LABELLED} select count(*) as n, 0.0::double as gap from labelled where month_idx <= {TRAIN_END} and {LABEL} is not null",
)
def _(spark, sf):
    """A fitted logistic regression with a free intercept predicts the weighted rate of the label on its own rows."""
    rows = _meta_rows(spark, sf)
    scored = models.meta_lr("baseline").fit(rows).transform(rows).withColumn("p", vector_to_array("probability")[1])
    gap = F.sum(F.col("weight") * (F.col("p") - F.col(LABEL))) / F.sum("weight")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.abs(gap), 3).alias("gap"))


@query("train_stack")
def _(spark, sf):
    return _rounded_metrics(_default_stack(spark, sf).metrics)


@query("meta_coefficients")
def _(spark, sf):
    return _default_stack(spark, sf).coefficients.withColumn("value", F.round("value", 6))


@query("stack_boosted_meta")
def _(spark, sf):
    meta = {"Stack_Boosted": models.meta_boosted()}
    return _rounded_metrics(_stacked(spark, sf, meta=meta).metrics)


@query("svd_kmeans_gbt")
def _(spark, sf):
    rows = _vectors(spark, sf)
    model, _ = models.train_svd_kmeans_gbt(rows, k=20, clusters=6, label="label", weight=None)
    return model.transform(rows).select("vec_id", "cluster", "prediction")


@query("silhouette")
def _(spark, sf):
    _, quality = models.train_svd_kmeans_gbt(_vectors(spark, sf), k=20, clusters=6, label="label", weight=None)
    return quality.withColumn("silhouette", F.round("silhouette", 6))


def _cluster_audit(rows, features, cluster):
    """Settled clusters, their centres from their moments, and the silhouette by the moments against the library's."""
    placed = settle(clusters.settled(rows, features, cluster))
    names, centres = clusters.centres_of(clusters.moments(placed, features, cluster), cluster)
    checked = clusters.audit(placed, features, cluster, dict(zip(names, centres)))
    library = ev.silhouette(placed, features, cluster).withColumnRenamed("silhouette", "again")
    same = F.abs(F.col("silhouette") - F.col("again")) <= 1e-6
    return checked.join(F.broadcast(library), F.lit(True)).select("n", "n_nearest", F.round("centre_gap", 9).alias("centre_gap"), same.alias("same_silhouette"))


@query("svd_kmeans_moments", "select count(*) as n, count(*) as n_nearest, 0.0::double as centre_gap, true as same_silhouette from embeddings where embedding is not null")
def _(spark, sf):
    rows = _vectors(spark, sf)
    svd = prep.fit_svd(rows, 20)
    projected = settle(svd.transform(rows).select("vec_id", "svd_features"))
    placed = KMeans(k=6, seed=42, featuresCol="svd_features", predictionCol="cluster").fit(projected).transform(projected)
    return _cluster_audit(placed, "svd_features", "cluster")


@query(
    "regimes_moments",
    f"""with {OBS}, s as (select x, y, max(m) - min(m) as amplitude from (select x, y, (month_idx - 1) % 12 + 1 as moy, avg(delta_h) as m from obs group by 1, 2, 3) group by 1, 2),
    p as (select x, y, regr_slope(delta_h, month_idx) as trend, avg(surface_slope) as slope from obs group by 1, 2)
    select count(*) as n, count(*) as n_nearest, 0.0::double as centre_gap, true as same_silhouette from p join s using (x, y)
    where trend is not null and slope is not null and amplitude is not null""",
)
def _(spark, sf):
    found = studies.regimes(settle(obs(spark, sf)))
    raw = settle(found.where("regime is not null").select("x", "y", "regime", "features"))
    return _cluster_audit(raw, "features", "regime")


@query("svd_logistic")
def _(spark, sf):
    rows = _vectors(spark, sf)
    svd, model = models.train_svd_lr(rows, k=20, label="label", weight=None)
    return _rounded_metrics(ev.evaluate(model.transform(svd.transform(rows)), "svd_lr", "all", "label"))


@query("select_features", _test_rows_sql("20"))
def _(spark, sf):
    train, _, test = _split(ml_table(spark, sf))
    prepared = prep.build_pipeline("xgb", NUMERIC).fit(train)
    model = models.base_rf().fit(settle(prepared.transform(train)))
    kept = ev.select_features(model).transform(prepared.transform(test))
    return kept.select("x", "month_idx", F.size(vector_to_array(F.col("selected"))).alias("width"))


@query("regimes")
def _(spark, sf):
    return studies.regimes(obs(spark, sf)).select("x", "y", *[F.round(c, 6).alias(c) for c in studies.REGIME_FEATURES], "regime")


@query(
    "regime_features",
    f"""with {OBS}, p as (select x, y, (month_idx - 1) % 12 + 1 as moy, delta_h from obs),
    a as (select x, y, max(m) - min(m) as seasonal_amplitude from (select x, y, moy, sum(delta_h)::double / count(*) as m from p group by 1, 2, 3) group by 1, 2)
    select x, y, round(regr_slope(delta_h, month_idx) * 12, 6) as dh_dt, round(avg(surface_slope), 6) as mean_slope, round(any_value(seasonal_amplitude), 6) as seasonal_amplitude
    from obs join a using (x, y) group by x, y""",
)
def _(spark, sf):
    out = studies.regime_features(settle(obs(spark, sf)))
    return out.select("x", "y", *[F.round(c, 6).alias(c) for c in ("dh_dt", "mean_slope", "seasonal_amplitude")])


@query(
    "mascon_months",
    f"""with {OBS}, b as (select mascon_id, month_idx, avg(delta_h) as delta_h, avg(lwe_mo) as lwe, avg(x) as mean_x from obs group by 1, 2)
    select a.mascon_id, a.month_idx, round(a.delta_h, 6) as delta_h, round(p.delta_h, 6) as dh_lag1, round(r.delta_h, 6) as dh_lag3, round((a.delta_h - p.delta_h) * 12, 6) as dh_rate,
      round(a.delta_h - avg(a.delta_h) over (partition by a.mascon_id order by a.month_idx rows unbounded preceding), 6) as dh_anomaly,
      round(a.lwe - p.lwe, 6) as mass_change, round(a.mean_x, 6) as mean_x
    from b a left join b p on p.mascon_id = a.mascon_id and p.month_idx = a.month_idx - 1 left join b r on r.mascon_id = a.mascon_id and r.month_idx = a.month_idx - 3""",
)
def _(spark, sf):
    names = ["delta_h", "dh_lag1", "dh_lag3", "dh_rate", "dh_anomaly", "mass_change", "mean_x"]
    return studies.mascon_months(obs(spark, sf)).select("mascon_id", "month_idx", *[F.round(c, 6).alias(c) for c in names])


@query("mass_regression")
def _(spark, sf):
    _, predicted = studies.mass_regression(settle(obs(spark, sf)), "gbt", TRAIN_END)
    return predicted.select("mascon_id", "month_idx", "mass_change", F.round("prediction", 6).alias("prediction"))


@query("mass_skill")
def _(spark, sf):
    r2, _ = studies.mass_skill(settle(obs(spark, sf)), "rf", TRAIN_END)
    return r2.withColumn("r2", F.round("r2", 6))


@query("mass_importances")
def _(spark, sf):
    _, ranked = studies.mass_skill(settle(obs(spark, sf)), "rf", TRAIN_END)
    return ranked.withColumn("importance", F.round("importance", 6))


@query(
    "grouped_r2",
    """with p as (select l_suppkey as mascon_id, l_extendedprice as y, l_quantity * 1500 as p from lineitem)
    select mascon_id, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 6) as r2, count(*) as n from p group by 1""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mascon_id"), "l_extendedprice", (F.col("l_quantity") * 1500).alias("guess"))
    return studies.grouped_r2(lines, ["mascon_id"], "l_extendedprice", "guess").withColumn("r2", F.round("r2", 6))


@query(
    "coupling",
    f"""with {OBS}, b as (select mascon_id, month_idx, avg(delta_h) as dh, avg(lwe_mo) as lwe from obs group by 1, 2),
    l as (select unnest(range(-2, 3)) as lag)
    select a.mascon_id, cast(l.lag as int) as lag, round(corr(a.dh, c.lwe), 6) as r, count(c.lwe) as n
    from b a cross join l left join b c on c.mascon_id = a.mascon_id and c.month_idx = a.month_idx + l.lag group by 1, 2""",
)
def _(spark, sf):
    return studies.coupling(obs(spark, sf)).withColumn("r", F.round("r", 6))


# ---- evaluation

_CURVE = f"""{SCORED}, t as (select sum(label)::double as p, count(*) - sum(label)::double as n from scored),
  g as (select score, sum(label)::double as pos, sum(1 - label)::double as neg from scored group by 1),
  c as (select *, sum(pos) over (order by score desc rows unbounded preceding) as tp, sum(neg) over (order by score desc rows unbounded preceding) as fp from g)"""


@query("roc_auc", f"with {_CURVE} select round(sum(neg * (tp - pos / 2)) / (any_value(p) * any_value(n)), 6) as roc_auc from c, t")
def _(spark, sf):
    return ev.roc_auc(scored(spark, sf)).withColumn("roc_auc", F.round("roc_auc", 6))


@query(
    "pr_auc",
    f"""with {_CURVE} select round(sum(pos * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), tp / (tp + fp))) / 2) / any_value(p), 6) as pr_auc from c, t""",
)
def _(spark, sf):
    return ev.pr_auc(scored(spark, sf)).withColumn("pr_auc", F.round("pr_auc", 6))


_CELLS = f"""{SCORED}, m as (select count(*) filter (where label = 1 and prediction = 1)::double as tp, count(*) filter (where label = 0 and prediction = 1)::double as fp,
  count(*) filter (where label = 1 and prediction = 0)::double as fn, count(*) filter (where label = 0 and prediction = 0)::double as tn from scored),
  r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as p1, coalesce(tn / nullif(tn + fn, 0), 0) as p0, coalesce(tp / nullif(tp + fn, 0), 0) as r1,
    coalesce(tn / nullif(tn + fp, 0), 0) as r0, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) as f0, tp + fn as pos, tn + fp as neg from m)"""


@query(
    "precision_recall_f1",
    f"""with {_CELLS} select round((f1 * pos + f0 * neg) / (pos + neg), 6) as f1, round((p1 * pos + p0 * neg) / (pos + neg), 6) as precision,
      round((r1 * pos + r0 * neg) / (pos + neg), 6) as recall, round(f1, 6) as f1_positive, round(p1, 6) as precision_positive, round(r1, 6) as recall_positive from r""",
)
def _(spark, sf):
    out = ev.prf(scored(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query(
    "confusion",
    f"""with {SCORED}, s as (select * from (values (1, 1), (0, 1), (1, 0), (0, 0)) v(label, prediction))
    select s.label, s.prediction, count(scored.label) as n from s left join scored on scored.label = s.label and scored.prediction = s.prediction group by 1, 2""",
)
def _(spark, sf):
    return ev.confusion(scored(spark, sf))


@query(
    "regional_summary",
    f"""with {SCORED} select regional_subset_id, avg(prediction::double) as predicted_rate, avg(label::double) as true_rate, count(*) as n, 'rule' as model from scored group by 1""",
)
def _(spark, sf):
    return ev.regional_summary(scored(spark, sf), "rule")


def _rule_splits(spark, sf):
    rows = scored(spark, sf).withColumn("split", F.when(F.col("regional_subset_id") == "en", "train").otherwise("test"))
    return {s: rows.filter(F.col("split") == s) for s in ("train", "test")}


def _area_sql(where: str) -> str:
    return f"""(select sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) from (select *, sum(pos) over (order by score desc rows unbounded preceding) as tp
      from (select score, sum(label)::double as pos, sum(1 - label)::double as neg from scored where {where} group by 1)))"""


def _pr_sql(where: str) -> str:
    return f"""(select sum(pos * (tp / (tp + fp) + coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), tp / (tp + fp))) / 2) / sum(pos) from (
      select *, sum(pos) over (order by score desc rows unbounded preceding) as tp, sum(neg) over (order by score desc rows unbounded preceding) as fp
      from (select score, sum(label)::double as pos, sum(1 - label)::double as neg from scored where {where} group by 1)))"""


@query(
    "fitting_analysis",
    f"""with {SCORED}, a as (select {_area_sql("regional_subset_id = 'en'")} as train, {_area_sql("regional_subset_id <> 'en'")} as test, {_pr_sql("regional_subset_id <> 'en'")} as pr)
    select 'rule' as model, round(train, 6) as train_roc_auc, round(test, 6) as test_roc_auc, round(pr, 6) as test_pr_auc, round(train - test, 6) as gap,
      case when train - test > 0.1 then 'OVERFITTING' else 'OK' end as verdict from a""",
)
def _(spark, sf):
    metrics = settle(ev.evaluate_all([ev.to_scores(d, "rule", s, score=F.col("score")) for s, d in _rule_splits(spark, sf).items()]))
    out = ev.fitting_analysis(metrics)
    return out.withColumns({c: F.round(c, 6) for c in ("train_roc_auc", "test_roc_auc", "test_pr_auc", "gap")})


@query(
    "best_threshold",
    f"""with {_CURVE}, f as (select score as threshold, 2 * tp / (tp + fp + p) as f1, tp / (tp + fp) as precision, tp / p as recall from c, t)
    select threshold, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall from f order by f.f1 desc, threshold desc limit 1""",
)
def _(spark, sf):
    out = ev.best_threshold(scored(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("f1", "precision", "recall")})


@query(
    "evaluate",
    f"""with {_CELLS} select 'rule' as model, 'all' as split, round({_area_sql('true')}, 6) as roc_auc, round({_pr_sql('true')}, 6) as pr_auc,
      round((f1 * pos + f0 * neg) / (pos + neg), 6) as f1, round((p1 * pos + p0 * neg) / (pos + neg), 6) as precision, round((r1 * pos + r0 * neg) / (pos + neg), 6) as recall from r""",
)
def _(spark, sf):
    return _rounded_metrics(ev.evaluate(scored(spark, sf), "rule", "all", score=F.col("score")))


def _split_sql(split: str, where: str) -> str:
    counts = {"tp": "label = 1 and prediction = 1", "fp": "label = 0 and prediction = 1", "fn": "label = 1 and prediction = 0", "tn": "label = 0 and prediction = 0"}
    cells = ", ".join(f"count(*) filter (where {c})::double as {n}" for n, c in counts.items())
    mean = lambda one, zero: f"round((({one}) * (tp + fn) + ({zero}) * (tn + fp)) / (tp + fp + fn + tn), 6)"
    ratio = lambda a, b: f"coalesce({a} / nullif({b}, 0), 0)"
    return f"""select 'rule' as model, '{split}' as split, round({_area_sql(where)}, 6) as roc_auc, round({_pr_sql(where)}, 6) as pr_auc,
      {mean(ratio("2 * tp", "2 * tp + fp + fn"), ratio("2 * tn", "2 * tn + fp + fn"))} as f1,
      {mean(ratio("tp", "tp + fp"), ratio("tn", "tn + fn"))} as precision, {mean(ratio("tp", "tp + fn"), ratio("tn", "tn + fp"))} as recall
      from (select {cells} from scored where {where})"""


@query(
    "results_table",
    f"""with {SCORED} {_split_sql("train", "regional_subset_id = 'en'")} union all {_split_sql("test", "regional_subset_id <> 'en'")}""",
)
def _(spark, sf):
    rows = [ev.evaluate(d, "rule", s, score=F.col("score")) for s, d in _rule_splits(spark, sf).items()]
    return _rounded_metrics(ev.results_table(rows))


@query(
    "physics_baseline",
    f"""with {FUSED} select x, month_idx, case when t_star_mo >= 300 and dist_to_grounding_line <= 50000 then 1 else 0 end as prediction from fused""",
)
def _(spark, sf):
    return ev.physics_baseline(fused(spark, sf), 300, 50000).select("x", "month_idx", "prediction")


_POISSON = " + ".join(f"(u >= {p!r}::double)::int" for p in ev.POISSON_CDF)
_ROW = ["x", "y", "month_idx"]


@query(
    "bootstrap_interval",
    f"""with {OBS}, p as (select x, y, delta_h::double / (delta_h + lwe_mo + 1) as v,
      floor({uniform_sql(_ROW, 42)} * {ev.HASH_PRIME})::bigint as h, floor({uniform_sql(_ROW, 43)} * {ev.HASH_PRIME})::bigint as g from obs),
    u as (select x, y, v, b, ((h + b * g) % {ev.HASH_PRIME}) / {float(ev.HASH_PRIME)!r}::double as u from p, (select unnest(range(100)) as b)),
    w as (select x, y, v, b, {_POISSON} as w from u),
    m as (select x, y, b, sum(w * v) / nullif(sum(w), 0) as m from w group by 1, 2, 3),
    o as (select x, y, list_sort(list(m) filter (where m is not null)) as ms from m group by 1, 2),
    a as (select x, y, avg(v) as mean, count(*) as n from p group by 1, 2)
    select x, y, round(mean, 6) as mean, n, round(ms[cast(floor((len(ms) - 1) * {(1 - 0.95) / 2!r}::double) as int) + 1], 6) as low,
      round(ms[cast(floor((len(ms) - 1) * {1 - (1 - 0.95) / 2!r}::double) as int) + 1], 6) as high from a join o using (x, y)""",
)
def _(spark, sf):
    rows = obs(spark, sf).withColumn("probability", F.col("delta_h") / (F.col("delta_h") + F.col("lwe_mo") + F.lit(1)))
    out = ev.bootstrap_interval(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})
