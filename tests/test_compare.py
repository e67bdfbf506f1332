"""A run that compares models, and the gradient that proves a linear fit."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from polarframe.ml import compare, models
from polarframe.ml import evaluate as ev


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    made = []
    for i in range(900):
        heat, far = rng.random(), rng.random() * 1e5
        event = int(heat > 0.75 and far < 6e4) if rng.random() > 0.05 else 1 - int(heat > 0.75)
        made.append((i, heat if i % 17 else None, far, "ab"[i % 3 % 2], event, 1.0 + i % 3, ("train", "train", "val", "test")[i % 4]))
    df = spark.createDataFrame(made, "x long, t_star_mo double, dist_to_grounding_line double, regional_subset_id string, basal_loss_agreement int, weight double, split string")
    df = df.withColumns({"y": F.lit(0), "month_idx": F.lit(24000)})
    return {s: df.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}


def test_models_are_compared_in_one_run(sides):
    learners = {"boosted": ("xgb", models.boosted("baseline", n_estimators=8, min_child=1)), "forest": ("stack", models.base_rf(10, 4)), "gbt": ("stack", models.base_gbt(5, 3))}
    found = compare.compare_models(sides, ["t_star_mo", "dist_to_grounding_line"], learners, ratio=5.0)
    metrics = {(r.model, r.split): r for r in found.metrics.collect()}
    assert set(metrics) == {(m, s) for m in learners for s in sides}
    assert metrics["boosted", "test"].roc_auc > 0.8
    gaps = {r.model: r for r in found.fitting.collect()}
    for m in learners:
        assert gaps[m].gap == pytest.approx(metrics[m, "train"].roc_auc - metrics[m, "test"].roc_auc)
        assert gaps[m].verdict == ("OVERFITTING" if gaps[m].gap > 0.1 else "OK")
    assert {(r.model, r.regional_subset_id) for r in found.regional.collect()} == {(m, r) for m in learners for r in "ab"}
    # The fitted pipelines score raw rows as the run did.
    again = ev.evaluate(found.models["boosted"].transform(sides["test"]), "boosted", "test", "basal_loss_agreement").first()
    assert again.roc_auc == pytest.approx(metrics["boosted", "test"].roc_auc)


@pytest.mark.parametrize("reg, weight", [(0.0, None), (0.1, "weight")])
def test_the_gradient_of_a_fit_is_zero_and_of_another_model_is_not(sides, reg, weight):
    rows = VectorAssembler(inputCols=["t_star_mo", "dist_to_grounding_line"], outputCol="features").transform(sides["train"].na.drop())
    stage = LogisticRegression(labelCol="basal_loss_agreement", regParam=reg, tol=1e-10, maxIter=500)
    model = (stage.setWeightCol(weight) if weight else stage).fit(rows)
    found = {r.name: r.gradient for r in ev.gradient(model.transform(rows), model, "basal_loss_agreement", weight, ["t_star_mo", "dist_to_grounding_line"]).collect()}
    assert set(found) == {"intercept", "t_star_mo", "dist_to_grounding_line"} and all(abs(g) < 1e-5 for g in found.values())
    early = (LogisticRegression(labelCol="basal_loss_agreement", regParam=reg, maxIter=1)).fit(rows)
    wrong = ev.gradient(early.transform(rows), early, "basal_loss_agreement", weight).collect()
    assert max(abs(r.gradient) for r in wrong) > 1e-3
