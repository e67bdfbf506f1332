"""Exact classification metrics, reports and intervals as DataFrame jobs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.functions.missing import present
from polarframe.operators.distribute import keyed_uniform, prefix_sums, settle

METRICS = ["roc_auc", "pr_auc", "f1", "precision", "recall"]

# A prime below 2^31: multiples of it by a replicate number stay far inside 64 bits.
HASH_PRIME = 2147483647

# Cumulative probabilities of a Poisson variable with mean 1.
POISSON_CDF = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815,
               0.999916759, 0.999989751, 0.999998875, 0.999999889, 0.999999990]


def positive_probability(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability)).getItem(1)


def score_curve(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """Per distinct score inside ``keys``, highest first: positives and negatives at and above it.

    Equal scores are counted before anything is ordered, and the running sums are spread over range
    partitions, so neither a tied score nor the global order ends up on one task.
    """
    known = df.select(*keys, present(df, score).alias("score"), F.col(label).alias("label")).na.drop(subset=["score", "label"])
    counts = known.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return prefix_sums(counts, order="score", sums=["pos", "neg"], keys=list(keys), descending=True)


def _roc_area() -> Column:
    """Probability that a positive outranks a negative, ties counting half."""
    won = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return F.try_divide(won, pairs)


def _pr_area() -> Column:
    """Trapezoids under precision over recall; the curve starts at recall 0 with the first precision."""
    precision = F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    before_pos, before_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    earlier = F.coalesce(F.try_divide(before_pos, before_pos + before_neg), precision)
    return F.try_divide(F.sum(F.col("pos") * (precision + earlier) / 2.0), F.sum("pos"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return score_curve(df, score, label).agg(_roc_area().alias("roc_auc"))


def pr_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return score_curve(df, score, label).agg(_pr_area().alias("pr_auc"))


def best_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Score threshold (predict positive at or above it) with the largest F1; ties to the higher one."""
    curve = settle(score_curve(df, score, label))
    positives = curve.agg(F.sum("pos")).scalar()
    f1 = F.try_divide(2.0 * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg") + positives)
    best = curve.select(f1.alias("f1"), F.col("score").alias("threshold"), "cum_pos", "cum_neg").agg(
        F.max(F.struct("f1", "threshold", "cum_pos", "cum_neg")).alias("b")
    )
    return best.select(
        "b.threshold", "b.f1",
        F.try_divide(F.col("b.cum_pos"), F.col("b.cum_pos") + F.col("b.cum_neg")).alias("precision"),
        F.try_divide(F.col("b.cum_pos"), positives).alias("recall"),
    )


def _cells(prediction: str, label: str) -> dict[str, Column]:
    """The four counts of the confusion matrix as aggregates."""
    hit = lambda l, p: F.count_if((F.col(label) == l) & (F.col(prediction) == p))
    return {"tp": hit(1, 1), "fp": hit(0, 1), "fn": hit(1, 0), "tn": hit(0, 0)}


def prf(df: DataFrame, prediction: str = "prediction", label: str = "label", keys: list[str] = ()) -> DataFrame:
    """Precision, recall and F1: class-weighted, and of the positive class."""
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _cells(prediction, label).items()])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    sides = {1: (tp, fp, fn), 0: (tn, fn, fp)}
    precision = {k: ratio(t, t + f) for k, (t, f, _) in sides.items()}
    recall = {k: ratio(t, t + m) for k, (t, _, m) in sides.items()}
    f1 = {k: ratio(2.0 * t, 2.0 * t + f + m) for k, (t, f, m) in sides.items()}
    positives, negatives = tp + fn, tn + fp
    weighted = lambda parts: F.try_divide(parts[1] * positives + parts[0] * negatives, positives + negatives)
    return counts.select(
        *keys, weighted(f1).alias("f1"), weighted(precision).alias("precision"), weighted(recall).alias("recall"),
        f1[1].alias("f1_positive"), precision[1].alias("precision_positive"), recall[1].alias("recall_positive"),
    )


def confusion(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """All four cells, empty ones with 0."""
    cells = _cells(prediction, label)
    counts = df.agg(*[c.alias(n) for n, c in cells.items()])
    place = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    rows = [F.struct(F.lit(l).alias("label"), F.lit(p).alias("prediction"), F.col(n).alias("n")) for n, (l, p) in place.items()]
    return counts.select(F.inline(F.array(*rows)))


def to_scores(
    df: DataFrame, model: str, split: str, label: str = "label", prediction: str = "prediction", score: Column | None = None
) -> DataFrame:
    """Predictions as (model, split, label, prediction, score); the score defaults to the positive probability."""
    return df.select(
        F.lit(model).alias("model"), F.lit(split).alias("split"), F.col(label).cast("int").alias("label"),
        F.col(prediction).cast("int").alias("prediction"),
        (positive_probability() if score is None else score).cast("double").alias("score"),
    )


def evaluate_all(scores: Sequence[DataFrame]) -> DataFrame:
    """Exact metrics of many ``to_scores`` tables: one job for all models and splits together.

    The narrow scores are written first, so that no model scores its rows once per metric.
    """
    keys = ["model", "split"]
    rows = settle(reduce(lambda a, b: a.unionByName(b), scores))
    areas = score_curve(rows, "score", "label", keys).groupBy(*keys).agg(_roc_area().alias("roc_auc"), _pr_area().alias("pr_auc"))
    return prf(rows, keys=keys).join(areas, keys, "left").select(*keys, *METRICS)


def evaluate(
    df: DataFrame, model: str, split: str, label: str = "label", prediction: str = "prediction", score: Column | None = None
) -> DataFrame:
    """One row of exact metrics."""
    return evaluate_all([to_scores(df, model, split, label, prediction, score)])


def results_table(rows: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of several models and splits as one settled table."""
    return settle(reduce(lambda a, b: a.unionByName(b), rows))


def regional_summary(df: DataFrame, model: str, region: str = "regional_subset_id", prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Predicted and true positive rate and row count per region."""
    return df.groupBy(region).agg(
        F.avg(F.col(prediction).cast("double")).alias("predicted_rate"),
        F.avg(F.col(label).cast("double")).alias("true_rate"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("model", F.lit(model))


def fitting_analysis(metrics: DataFrame, gap: float = 0.1, train: str = "train", test: str = "test") -> DataFrame:
    """Train-test gap of ROC-AUC per model, flagged when above ``gap``."""
    at = lambda split, metric: F.max(F.when(F.col("split") == split, F.col(metric)))
    sides = metrics.groupBy("model").agg(
        at(train, "roc_auc").alias("train_roc_auc"), at(test, "roc_auc").alias("test_roc_auc"), at(test, "pr_auc").alias("test_pr_auc")
    )
    distance = F.col("train_roc_auc") - F.col("test_roc_auc")
    return sides.withColumn("gap", distance).withColumn("verdict", F.when(distance > gap, "OVERFITTING").otherwise("OK"))


def silhouette(df: DataFrame, features: str = "features", prediction: str = "prediction") -> DataFrame:
    """Mean silhouette with squared distances, which needs only cluster sums."""
    value = ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(df)
    return df.sparkSession.createDataFrame([(float(value),)], "silhouette double")


def _report(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Model parameters as a table; the rows are as many as the model has features."""
    return spark.createDataFrame(rows, schema)


def coefficients(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """Intercept and coefficients of a linear model with their signs."""
    pairs = [("intercept", float(model.intercept))] + [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    return _report(spark, [(n, "+" if c >= 0 else "-", c) for n, c in pairs], "name string, sign string, value double")


def gradient(df: DataFrame, model, label: str, weight: str | None = None, names: list[str] | None = None) -> DataFrame:
    """(name, gradient): slope of the penalised mean loss of a fitted logistic regression along every standardised coefficient, on the rows it was fitted on.

    At the fitted coefficients all of them are zero up to the solver's tolerance, which proves the fit without a second solver. Coefficients count in
    standard deviations of their features, as the solver has them, so the slopes do not depend on units; a constant feature has none. The penalty is
    the squared one (no absolute part). Names default to the positions.
    """
    size = model.coefficients.size
    names = ["intercept", *(names or [f"f{i}" for i in range(size)])]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    features = model.getFeaturesCol()
    rows = df.select(features, w.alias("_w"), (positive_probability(model.getProbabilityCol()) - F.col(label).cast("double")).alias("_r"))
    terms = F.transform(vector_to_array(F.col(features)), lambda x: x * F.col("_w") * F.col("_r"))
    sums = rows.agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_r")).alias("r"), Summarizer.metrics("sum").summary(array_to_vector(terms)).alias("g"),
        Summarizer.metrics("std").summary(F.col(features), F.col("_w")).alias("s"),
    ).first()
    slopes = np.concatenate([[sums.r], sums.g["sum"].toArray()]) / sums.w
    std = sums.s["std"].toArray()
    slopes[1:] = np.where(std > 0, slopes[1:] / np.where(std > 0, std, 1.0) + model.getRegParam() * model.coefficients.toArray() * std, 0.0)
    return _report(df.sparkSession, [(n, float(v)) for n, v in zip(names, slopes)], "name string, gradient double")


def importances(spark: SparkSession, model, names: list[str]) -> DataFrame:
    """Feature importances with their rank, largest first."""
    ranked = sorted(zip(names, model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    return _report(spark, [(n, float(v), i) for i, (n, v) in enumerate(ranked, 1)], "name string, importance double, rank int")


def select_features(model, n: int = 20, features: str = "features", out: str = "selected") -> VectorSlicer:
    """A stage that keeps the ``n`` most important entries of the feature vector."""
    values = model.featureImportances.toArray()
    best = sorted(sorted(range(len(values)), key=lambda i: (-values[i], i))[:n])
    return VectorSlicer(inputCol=features, outputCol=out, indices=best)


def physics_baseline(df: DataFrame, t: float, g: float, driving: str = "t_star_mo", distance: str = "dist_to_grounding_line") -> DataFrame:
    """Rule that predicts an event where thermal driving is high near the grounding line."""
    event = (F.col(driving) >= F.lit(t)) & (F.col(distance) <= F.lit(g))
    return df.withColumn("prediction", F.coalesce(event, F.lit(False)).cast("int"))


def bootstrap_interval(
    df: DataFrame, replicates: int = 100, level: float = 0.95, key: list[str] = ("x", "y"),
    row_key: list[str] = ("x", "y", "month_idx"), value: str = "probability", seed: int = 42,
) -> DataFrame:
    """Percentile interval of each pixel's mean probability from Poisson(1) bootstrap weights.

    A row's weight in replicate b comes from ``(h + b * g) mod p`` with two hashes h, g of its key, looked up in the sorted borders of the
    distribution. The replicates are the columns of a matrix: an Arrow batch draws all of its weights and sums them per pixel in a few
    vectorised steps, so what leaves a batch is one vector of weights and weighted values per pixel in it. One aggregate adds them up.
    """
    v = present(df, value).cast("double")
    start, stride = (F.floor(keyed_uniform(list(row_key), seed + i) * F.lit(HASH_PRIME)).cast("bigint") for i in (0, 1))
    key = list(key)
    rows = df.filter(v.isNotNull()).select(*key, v.alias("_v"), start.alias("_h"), stride.alias("_g"))
    borders = np.array([math.ceil(c * HASH_PRIME) for c in POISSON_CDF])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.select(key).to_pandas().groupby(key, dropna=False, sort=False).ngroup().to_numpy()
            x, h, g = (batch.column(c).to_numpy() for c in ("_v", "_h", "_g"))
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
            place = (h[order, None] + np.arange(replicates) * g[order, None]) % HASH_PRIME
            weights = np.searchsorted(borders, place, "right").astype(np.float64)
            sums = np.add.reduceat(np.concatenate([weights, weights * x[order, None]], axis=1), cuts)
            names = [batch.column(c).take(pa.array(order[cuts])) for c in key]
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), 2 * replicates).cast(pa.list_(pa.float64()))
            counted = [pa.array(np.add.reduceat(x[order], cuts)), pa.array(np.diff(cuts, append=len(order)))]
            yield pa.record_batch([*names, *counted, vectors], [*key, "t", "n", "w"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields)
    partial = rows.mapInArrow(draw, f"{kinds}, t double, n bigint, w array<double>")
    sums = partial.groupBy(*key).agg(
        (F.sum("t") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), Summarizer.metrics("sum").summary(array_to_vector("w")).alias("s")
    ).withColumn("s", vector_to_array(F.col("s.sum")))
    half = lambda first: F.slice("s", first, replicates)
    means = F.filter(F.zip_with(half(1), half(replicates + 1), lambda w, x: F.try_divide(x, w)), lambda m: m.isNotNull())
    rank = lambda share: F.floor((F.size("means") - 1) * F.lit(share)).cast("int")
    tail = (1 - level) / 2
    ordered = sums.select(*key, "mean", "n", F.array_sort(means).alias("means"))
    return ordered.select(
        *key, "mean", "n", F.get("means", rank(tail)).alias("low"), F.get("means", rank(1 - tail)).alias("high")
    )
