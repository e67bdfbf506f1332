"""Own pipeline stages through fit, save and load; clusters against brute force."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from polarframe.ml import clusters
from polarframe.ml.prep import build_pipeline
from polarframe.ml.stages import MedianImputer, Svd


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = [(i, rng.gauss(0, 5) if i % 4 else None, float("nan") if i % 5 == 0 else rng.gauss(3, 1), rng.randrange(9)) for i in range(301)]
    return spark.createDataFrame(made, "id long, a double, b double, c long").cache()


def test_medians_are_exact_and_survive_saving(spark, rows, tmp_path):
    names = ["a", "b", "c"]
    stage = MedianImputer(inputCols=names, outputCols=[f"{n}_f" for n in names])
    pipeline = Pipeline(stages=[stage, VectorAssembler(inputCols=stage.getOutputCols(), outputCol="features"), Svd(k=2)])
    pipeline.write().save(str(tmp_path / "unfitted"))
    model = Pipeline.load(str(tmp_path / "unfitted")).fit(rows)
    model.write().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    columns = ["id", "a_f", "b_f", "c_f", vector_to_array("svd_features").alias("z")]
    one, two = (sorted(map(tuple, m.transform(rows).select(*columns).collect())) for m in (model, loaded))
    assert one == two
    made = {r.id: r for r in rows.collect()}
    for name, place in (("a", 1), ("b", 2), ("c", 3)):
        kept = sorted(v for r in made.values() if (v := r[name]) is not None and v == v)
        median = float(kept[(len(kept) - 1) // 2])
        assert all(o[place] == (median if made[o[0]][name] is None or made[o[0]][name] != made[o[0]][name] else made[o[0]][name]) for o in one)
    matrix = np.array([o[1:4] for o in one])
    assert np.allclose(np.linalg.svd(matrix, compute_uv=False)[:2], np.sqrt((np.array([o[4] for o in one]) ** 2).sum(0)))


def test_a_column_without_values_has_no_median(rows):
    with pytest.raises(ValueError, match="median"):
        MedianImputer(inputCols=["n"], outputCols=["m"]).fit(rows.withColumn("n", F.lit(None).cast("double")))


def test_preprocessing_pipelines_can_be_saved(spark, tmp_path):
    made = [(float(i), 1000.0 * i, "ross" if i % 3 else "ronne") for i in range(40)]
    df = spark.createDataFrame(made, "t_star_mo double, dist_to_grounding_line double, regional_subset_id string")
    model = build_pipeline("xgb", ["t_star_mo", "dist_to_grounding_line"]).fit(df)
    model.write().save(str(tmp_path / "p"))
    assert PipelineModel.load(str(tmp_path / "p")).transform(df).select("features").collect() == model.transform(df).select("features").collect()


@pytest.fixture(scope="module")
def placed(spark):
    rng = random.Random(2)
    points = [(i, [rng.gauss(3 * (i % 5), 1), rng.gauss(i % 2, 1), rng.gauss(0, 1)]) for i in range(400)] + [(400, [90.0, 90.0, 90.0])]
    df = spark.createDataFrame(points, "id long, v array<double>")
    df = VectorAssembler(inputCols=["p", "q", "r"], outputCol="features").transform(df.select("id", *[F.col("v")[i].alias(n) for i, n in enumerate("pqr")]))
    return KMeans(k=6, seed=3, maxIter=1, featuresCol="features", predictionCol="cluster").fit(df).transform(df).select("id", "features", "cluster").cache()


def test_moments_are_the_members_sums(placed):
    own = {}
    for r in placed.collect():
        own.setdefault(r.cluster, []).append(r.features.toArray())
    for r in clusters.moments(placed, "features", "cluster").collect():
        assert r.n == len(own[r.cluster]) and np.allclose(r.sums, np.sum(own[r.cluster], 0)) and r.squares == pytest.approx(float((np.array(own[r.cluster]) ** 2).sum()))


def test_settled_clusters_are_a_fixed_point(placed):
    done = clusters.settled(placed, "features", "cluster").cache()
    names, centres = clusters.centres_of(clusters.moments(done, "features", "cluster"), "cluster")
    report = clusters.audit(done, "features", "cluster", dict(zip(names, centres))).first()
    assert (report.n, report.n_nearest, report.centre_gap) == (401, 401, 0.0)
    x = {r.id: (r.features.toArray(), r.cluster) for r in done.collect()}
    for v, c in x.values():
        distance = ((centres - v) ** 2).sum(1)
        assert distance[names.index(c)] <= distance.min() + 1e-9
    assert report.silhouette == pytest.approx(ClusteringEvaluator(predictionCol="cluster").evaluate(done), abs=1e-9)


def test_wrong_centres_and_assignments_are_found(placed):
    done = clusters.settled(placed, "features", "cluster")
    names, centres = clusters.centres_of(clusters.moments(done, "features", "cluster"), "cluster")
    moved = {n: c + (1.0 if n == names[0] else 0.0) for n, c in zip(names, centres)}
    assert clusters.audit(done, "features", "cluster", moved).first().centre_gap == pytest.approx(1.0)
    other = done.withColumn("cluster", F.when(F.col("id") < 7, F.lit(names[0])).otherwise(F.col("cluster")))
    assert clusters.audit(other, "features", "cluster", dict(zip(names, centres))).first().n_nearest < 401
