"""Distributed classifiers: boosted trees, stacking, and models on SVD components."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.ml.evaluate import coefficients, evaluate_all, positive_probability, regional_summary, results_table, silhouette, to_scores
from polarframe.ml.prep import META_CONTEXT, META_NAMES, SvdModel, build_pipeline, fit_svd, meta_features
from polarframe.operators.distribute import scratch_path, settle
from polarframe.operators.labels import LABEL
from polarframe.operators.splits import oof_split, undersample
from polarframe.sources.sinks import materialize, save_predictions

WEIGHT = "weight"

# Boosted-tree presets; ``tuned_report`` and ``tuned_code`` are the two published variants.
PRESETS = {
    "baseline": dict(max_depth=4, n_estimators=100, learning_rate=0.1, subsample=0.8, colsample=0.8, min_child=10),
    "tuned_report": dict(max_depth=8, n_estimators=400, learning_rate=0.02, subsample=0.75, colsample=0.7, min_child=20),
    "tuned_code": dict(max_depth=5, n_estimators=150, learning_rate=0.05, subsample=0.75, colsample=0.7, min_child=20),
}


def boosted(preset: str = "baseline", features: str = "features", label: str = LABEL, weight: str | None = WEIGHT, **overrides) -> GBTClassifier:
    """Gradient-boosted trees with a named preset; ``overrides`` replace single preset values."""
    p = PRESETS[preset] | overrides
    stage = GBTClassifier(
        featuresCol=features, labelCol=label, seed=42, maxIter=p["n_estimators"], maxDepth=p["max_depth"],
        stepSize=p["learning_rate"], subsamplingRate=p["subsample"], featureSubsetStrategy=str(p["colsample"]),
        minInstancesPerNode=p["min_child"],
    )
    return stage.setWeightCol(weight) if weight else stage


def base_rf(trees: int = 100, depth: int = 8, label: str = LABEL, weight: str | None = WEIGHT) -> RandomForestClassifier:
    stage = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=42,
        predictionCol="rf_prediction", probabilityCol="rf_probability", rawPredictionCol="rf_rawPrediction",
    )
    return stage.setWeightCol(weight) if weight else stage


def base_gbt(rounds: int = 50, depth: int = 5, label: str = LABEL, weight: str | None = WEIGHT) -> GBTClassifier:
    stage = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=42, predictionCol="gbt_prediction")
    # Own names for all outputs: the meta-learner uses the default ones.
    stage.setRawPredictionCol("gbt_rawPrediction").setProbabilityCol("gbt_probability")
    return stage.setWeightCol(weight) if weight else stage


def meta_lr(preset: str = "baseline", label: str = LABEL, weight: str | None = WEIGHT) -> LogisticRegression:
    values = {"baseline": dict(maxIter=200, regParam=0.01, elasticNetParam=0.0), "tuned": dict(maxIter=500, regParam=0.1, elasticNetParam=0.5)}
    stage = LogisticRegression(featuresCol="meta_features", labelCol=label, **values[preset])
    return stage.setWeightCol(weight) if weight else stage


def meta_boosted(label: str = LABEL, weight: str | None = WEIGHT, **overrides) -> GBTClassifier:
    """Boosted trees over the meta-features, the alternative to the linear meta-learner."""
    return boosted("baseline", "meta_features", label, weight, **overrides)


@dataclass
class StackResult:
    """Fitted stages and the metric, coefficient and regional tables of a stacking run."""

    preprocess: PipelineModel
    base: list[PipelineModel]
    meta: dict[str, PipelineModel]
    metrics: DataFrame
    coefficients: DataFrame
    regional: DataFrame
    saved: list[str] = field(default_factory=list)


def train_stack(
    train: DataFrame, val: DataFrame, test: DataFrame, numeric: list[str], *, label: str = LABEL, weight: str | None = WEIGHT,
    ratio: float = 10.0, ratios: dict[str, float] | None = None, base=None, meta=None, context: list[str] = META_CONTEXT, save: bool = False,
) -> StackResult:
    """Out-of-fold stacking: base learners on fold A, meta-learners on fold B, all splits scored.

    Pixels, not rows, are assigned to folds. Preprocessing is fitted on fold A only, so the medians
    and scales fold B is judged with have not seen it. Fold A is undersampled; fold B is not.
    """
    spark = train.sparkSession
    raw_a, raw_b = oof_split(train)
    preprocess = build_pipeline("stack", numeric).fit(raw_a)
    flushed = {
        name: materialize(preprocess.transform(d), scratch_path(spark, f"stack-{name}"))
        for name, d in (("fold_a", raw_a), ("fold_b", raw_b), ("val", val), ("test", test))
    }
    base = base or {"Base_RF": base_rf(label=label, weight=weight), "Base_GBT": base_gbt(label=label, weight=weight)}
    # Only what the learners read is kept for their passes.
    read = sorted({stage.getFeaturesCol() for stage in base.values()} | {label} | ({weight} if weight else set()))
    fit_rows = undersample(flushed["fold_a"], ratio=ratio, ratios=ratios, label=label).select(*read).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = {name: Pipeline(stages=[stage]).fit(fit_rows) for name, stage in base.items()}
    fit_rows.unpersist()

    def with_base(df: DataFrame) -> DataFrame:
        for model in fitted.values():
            df = model.transform(df)
        return df

    prefixes = {"Base_RF": "rf", "Base_GBT": "gbt"}
    rows, scored = [], {}
    for split, df in flushed.items():
        # Scored once, then read by the evaluation of every base and meta learner.
        scored[split] = with_base(df).persist(StorageLevel.DISK_ONLY)
        for name in fitted:
            prefix = prefixes[name]
            probability = positive_probability(f"{prefix}_probability")
            rows.append(to_scores(scored[split], name, split, label, f"{prefix}_prediction", probability))
    metas = {split: meta_features(df, context) for split, df in scored.items()}
    learners = meta or {"Stack_LR_Baseline": meta_lr("baseline", label, weight), "Stack_LR_Tuned": meta_lr("tuned", label, weight)}
    fold_b = metas["fold_b"].select("meta_features", label, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    meta_models = {name: Pipeline(stages=[stage]).fit(fold_b) for name, stage in learners.items()}
    fold_b.unpersist()
    reports, regional, saved = [], [], []
    for name, model in meta_models.items():
        linear = model.stages[-1]
        if hasattr(linear, "coefficients"):
            names = META_NAMES[:3] + [f"{c}_meta" for c in context]
            reports.append(coefficients(spark, linear, names).withColumn("model", F.lit(name)))
        for split in ("fold_a", "fold_b", "val", "test"):
            predicted = model.transform(metas[split])
            rows.append(to_scores(predicted, name, split, label))
            if save:
                kept = [c for c in ("x", "y", "month_idx", "regional_subset_id", label, "prediction", "probability") if c in predicted.columns]
                saved.append(save_predictions(predicted.select(*kept), name, split, scratch_path(spark, "predictions")))
            if split == "test":
                regional.append(regional_summary(predicted, name, label=label))
    result = StackResult(
        preprocess, list(fitted.values()), meta_models, settle(evaluate_all(rows)),
        results_table(reports) if reports else None, results_table(regional), saved,
    )
    for df in scored.values():
        df.unpersist()
    return result


@dataclass
class SvdClusterModel:
    """Projection, clusters and boosted trees, in the order they are applied."""

    svd: SvdModel
    clusters: KMeansModel
    trees: PipelineModel

    def project(self, df: DataFrame) -> DataFrame:
        return self.clusters.transform(self.svd.transform(df))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(self.project(df))


def train_svd_kmeans_gbt(train: DataFrame, k: int = 20, clusters: int = 6, label: str = LABEL, weight: str | None = WEIGHT, **overrides) -> tuple[SvdClusterModel, DataFrame]:
    """SVD projection, k-means on the components, boosted trees on components and cluster; silhouette."""
    svd = fit_svd(train, k)
    projected = svd.transform(train).persist(StorageLevel.MEMORY_AND_DISK)
    groups = KMeans(k=clusters, seed=42, featuresCol="svd_features", predictionCol="cluster").fit(projected)
    clustered = groups.transform(projected)
    quality = silhouette(clustered, "svd_features", "cluster")
    joined = VectorAssembler(inputCols=["svd_features", "cluster"], outputCol="svd_cluster_features", handleInvalid="skip")
    trees = Pipeline(stages=[joined, boosted("baseline", "svd_cluster_features", label, weight, **overrides)]).fit(clustered)
    projected.unpersist()
    return SvdClusterModel(svd, groups, trees), quality


def train_svd_lr(train: DataFrame, k: int = 20, label: str = LABEL, weight: str | None = WEIGHT) -> tuple[SvdModel, PipelineModel]:
    """The simple baseline: logistic regression on SVD components."""
    svd = fit_svd(train, k)
    stage = LogisticRegression(featuresCol="svd_features", labelCol=label, regParam=0.01)
    return svd, Pipeline(stages=[stage.setWeightCol(weight) if weight else stage]).fit(svd.transform(train))
