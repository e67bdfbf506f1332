"""Preprocessing, models and metrics on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from polarframe.ml import evaluate as ev
from polarframe.ml import models, prep, studies
from polarframe.operators.labels import LABEL


def _scores(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


def test_tied_scores(spark):
    df = _scores(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.1, 0), (None, 1)])
    assert ev.roc_auc(df).first().roc_auc == pytest.approx((3 + 1 + 0.5 + 0.5) / 6)
    assert ev.pr_auc(df).first().pr_auc == pytest.approx(0.5 * 1 + 0.5 * (1 + 0.5) / 2)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_only(spark, label):
    df = _scores(spark, [(0.1, label), (0.2, label)])
    assert ev.roc_auc(df).first().roc_auc is None
    assert (ev.pr_auc(df).first().pr_auc is None) == (label == 0)


def test_areas_equal_brute_force_and_ignore_scale(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(0, 60) / 10, int(rng.random() < 0.3)) for _ in range(800)]
    pos, neg = [s for s, l in pairs if l], [s for s, l in pairs if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = _scores(spark, pairs)
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(want)
    assert ev.roc_auc(df.withColumn("score", F.exp("score"))).first().roc_auc == pytest.approx(want)


def test_best_threshold(spark):
    row = ev.best_threshold(_scores(spark, [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0), (0.05, 0)])).first()
    assert row.threshold == 0.6 and row.f1 == pytest.approx(6 / 7) and row.recall == 1.0


def test_confusion_and_prf(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, prediction int")
    assert rows(ev.confusion(df), "label", "prediction", "n") == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 1)]
    row = ev.prf(df).first()
    assert row.f1_positive == pytest.approx(2 / 3) and row.precision_positive == 1.0 and row.recall == pytest.approx(0.75)


def test_fitting_analysis(spark, rows):
    made = [("a", "train", 0.9304, 0.5), ("a", "test", 0.7403, 0.09), ("b", "train", 0.8, 0.5), ("b", "test", 0.75, 0.1)]
    df = spark.createDataFrame(made, "model string, split string, roc_auc double, pr_auc double")
    assert rows(ev.fitting_analysis(df), "model", "verdict") == [("a", "OVERFITTING"), ("b", "OK")]


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    df = spark.range(60).select((F.col("id") % 2).alias("x"), F.lit(0).alias("y"), F.col("id").alias("month_idx"), (F.col("id") % 7 / 7).alias("probability"))
    out = {r.x: r for r in ev.bootstrap_interval(df, replicates=40).collect()}
    assert all(r.low <= r["mean"] <= r.high and r.n == 30 and r.low < r.high for r in out.values())
    again = {r.x: r for r in ev.bootstrap_interval(df.repartition(5), replicates=40).collect()}
    assert all(out[k].low == pytest.approx(again[k].low) and out[k].high == pytest.approx(again[k].high) for k in out)


def test_fill_median_is_the_lower_middle(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,), (float("nan"),)], "v double")
    assert sorted(r.v_imputed for r in prep.fill_median(df, ["v"]).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0, 4.0]
    staged = prep.impute_median(["v"]).fit(df).transform(df)
    assert sorted(r.v_imputed for r in staged.collect()) == [1.0, 2.0, 2.0, 2.0, 3.0, 4.0]
    assert prep.usable(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]) == ["v"]


def test_pipelines_survive_unseen_regions_and_missing_distances(spark):
    made = [(float(i), float(i % 3), None if i == 2 else 6000.0 * i, "ross" if i % 2 else "ronne") for i in range(12)]
    schema = "t_star_mo double, ice_draft double, dist_to_grounding_line double, regional_subset_id string"
    train = spark.createDataFrame(made, schema)
    test = spark.createDataFrame([(1.0, 2.0, float("nan"), "amundsen_sea"), (1.0, None, None, None)], schema)
    for kind in ("xgb", "classic", "stack"):
        model = prep.build_pipeline(kind, prep.POLY_TRIPLE).fit(train)
        got = model.transform(test).collect()
        assert len(got) == 2 and len({r.features.size for r in got}) == 1


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) + 3.0
    x[:, 5] = 2.0
    df = spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(x)], ["id", "features"])
    model = prep.fit_svd(df, k=3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular_values, s[:3]) and np.allclose(np.abs(model.components), np.abs(vt[:3].T))
    z = np.array([r.svd_features.toArray() for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(np.abs(z), np.abs(x @ vt[:3].T))
    assert model.explained_variance(df).agg(F.max("cumulative")).first()[0] == pytest.approx((s[:3] ** 2).sum() / (s**2).sum())


@pytest.fixture(scope="module")
def made(spark):
    """Rows whose label depends on two features."""
    cols = {c: (F.pmod(F.xxhash64(F.lit(c), F.col("id")), F.lit(1000)) / 1000.0).alias(c) for c in prep.META_CONTEXT}
    df = spark.range(3000).select((F.col("id") % 60).alias("x"), F.lit(0).alias("y"), F.floor(F.col("id") / 60).cast("int").alias("month_idx"),
                                  F.when(F.col("id") % 3 == 0, "ross").otherwise("ronne").alias("regional_subset_id"), *cols.values())
    return df.withColumn(LABEL, ((F.col("t_star_mo") > 0.7) & (F.col("ice_draft") > 0.5)).cast("int")).withColumn("weight", F.lit(1.0)).cache()


def test_stack_learns_and_reports(spark, made):
    train, val, test = (made.filter(p) for p in ("month_idx < 30", "month_idx between 30 and 39", "month_idx >= 40"))
    base = {"Base_RF": models.base_rf(trees=5, depth=4), "Base_GBT": models.base_gbt(rounds=3, depth=3)}
    meta = {"LR": models.meta_lr("baseline")}
    out = models.train_stack(train, val, test, prep.META_CONTEXT, base=base, meta=meta, ratio=3.0, save=True)
    metrics = {(r.model, r.split): r for r in out.metrics.collect()}
    assert set(metrics) == {(m, s) for m in ("Base_RF", "Base_GBT", "LR") for s in ("fold_a", "fold_b", "val", "test")}
    assert metrics[("LR", "test")].roc_auc > 0.95 and metrics[("LR", "fold_b")].roc_auc > 0.95
    assert [r.name for r in out.coefficients.collect()] == ["intercept", *prep.META_NAMES]
    assert {r.regional_subset_id for r in out.regional.collect()} == {"ross", "ronne"}
    assert spark.read.parquet(out.saved[-1]).count() == test.count()
    gap = ev.fitting_analysis(out.metrics, train="fold_b").filter("model = 'LR'").first()
    assert gap.verdict == "OK"


def test_boosted_presets(made):
    stage = models.boosted("tuned_report")
    assert (stage.getMaxDepth(), stage.getMaxIter(), stage.getStepSize(), stage.getMinInstancesPerNode()) == (8, 400, 0.02, 20)
    assert models.boosted("tuned_code").getMaxIter() == 150 and models.boosted("baseline", n_estimators=3).getMaxIter() == 3
    assert models.meta_boosted(n_estimators=2).getFeaturesCol() == "meta_features"


def test_svd_models(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 2), array) for i, array in enumerate((rng.normal(size=(300, 8)) + np.where(np.arange(300)[:, None] % 2, 2.0, -2.0)).tolist())]
    df = spark.createDataFrame(rows, "label int, v array<double>").select("label", array_to_vector("v").alias("features")).cache()
    svd, lr = models.train_svd_lr(df, k=4, label="label", weight=None)
    assert ev.evaluate(lr.transform(svd.transform(df)), "lr", "all").first().roc_auc > 0.99
    model, quality = models.train_svd_kmeans_gbt(df, k=4, clusters=2, label="label", weight=None, n_estimators=2, max_depth=2, min_child=1)
    assert quality.first().silhouette > 0.5
    assert ev.evaluate(model.transform(df), "gbt", "all").first().f1 > 0.95


def test_selected_features_are_the_important_ones(spark, made):
    prepared = prep.build_pipeline("xgb", prep.META_CONTEXT).fit(made).transform(made)
    model = models.base_rf(trees=5, depth=4).fit(prepared)
    stage = ev.select_features(model, n=2)
    assert stage.getIndices() == [0, 1]
    assert stage.transform(prepared).select(F.size(vector_to_array("selected"))).first()[0] == 2
    top = ev.importances(spark, model, [f"f{i}" for i in range(model.numFeatures)]).filter("rank <= 2").collect()
    assert {r.name for r in top} == {"f0", "f1"}


def test_physics_baseline(spark, rows):
    df = spark.createDataFrame([(2.0, 100.0), (2.0, 9000.0), (None, 100.0)], "t_star_mo double, dist_to_grounding_line double")
    assert [r.prediction for r in ev.physics_baseline(df, 1.0, 5000.0).collect()] == [1, 0, 0]


def test_coupling_finds_the_lag(spark):
    made = [(1, m, math.sin(m), math.sin(m - 2)) for m in range(40)]
    df = spark.createDataFrame(made, "mascon_id int, month_idx int, delta_h double, lwe_mo double")
    got = {r.lag: r for r in studies.coupling(df).collect()}
    assert got[2].r == pytest.approx(1.0) and got[2].n == 38 and got[0].n == 40 and abs(got[0].r) < 0.9


def test_grouped_r2(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 1.0, 2.0), ("b", 3.0, 2.0), ("c", 1.0, 1.0)], "k string, y double, p double")
    assert rows(studies.grouped_r2(df, ["k"], "y", "p"), "k", "r2", "n") == [("a", 1.0, 2), ("b", 0.0, 2), ("c", None, 1)]
