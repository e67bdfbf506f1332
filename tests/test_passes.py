"""What fits pass over hundreds of times: even partitions, narrow rows, no needless hashing; walks that don't multiply rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from polarframe.ml import trees
from polarframe.operators import distribute, profile, splits, temporal
from polarframe.operators.labels import LABEL
from polarframe.plans import learning_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_fill_the_cores_a_whole_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(distribute, "EVEN_ROWS", 1000)
    monkeypatch.setattr(distribute, "ROWS_PER_TASK", 1000)
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(24_000).select((F.col("id") % 800).alias("x"), (F.col("id") % 8).alias("y"), (F.col("id") / 800).cast("int").alias("month_idx"), F.col("id").alias("delta_h"))
    dealt = distribute.even(df, temporal.PIXEL, 24_000)
    windows = distribute.settle(temporal.momentum(temporal.expanding_mean(dealt, "delta_h"), "delta_h"))
    sizes = windows.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) == cores * 3 and sizes.sum() == 24_000 and sizes.max() < 2 * sizes.mean()
    assert _plan(temporal.expanding_mean(dealt, "delta_h")).count("Exchange hashpartitioning") == 1
    assert distribute.even(df, temporal.PIXEL, 999) is df


def test_fit_rows_are_narrow_and_drawn_as_before(spark):
    rows = spark.range(400).select(
        F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("month_idx"), (F.col("id") < 5).cast("int").alias(LABEL), F.lit(1.0).alias("weight"), F.rand(1).alias("a")
    )
    prepared = VectorAssembler(inputCols=["a", "x"], outputCol="features")
    fit = learning_queries._fit_rows(prepared, rows)
    assert fit.columns == ["features", "weight", LABEL]
    kept = {int(r.features[1]) for r in fit.collect()}
    draw = {r.x: r.u for r in rows.select("x", distribute.keyed_uniform(splits.ROW_KEY, 42).alias("u")).collect()}
    assert kept == {x for x in range(400) if x < 5 or draw[x] < 50 / 395}
    assert splits.undersample(rows, ratio=1000.0).count() == 400


def test_quantiles_count_buffered_digits(spark, monkeypatch):
    monkeypatch.setattr(profile, "BUFFERED", 300)
    values = np.random.default_rng(4).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    found = profile.quantiles(df, ["v"], [0.25, 0.5]).orderBy("share").collect()
    ordered = np.sort(values)
    assert [r.n for r in found] == [5000, 5000]
    assert [(r.low, r.high) for r in found] == [(ordered[int(s * 4999)], ordered[int(s * 4999) + 1]) for s in (0.25, 0.5)]


@pytest.mark.parametrize("places", [1 << 20, 37])
def test_a_walk_does_not_multiply_rows(spark, monkeypatch, places):
    monkeypatch.setattr(trees, "PLACES", places)
    df = spark.range(300).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("label", (F.col("a") > F.col("b")).cast("double"))
    rows = distribute.settle(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    model = GBTClassifier(maxDepth=3, maxIter=5, seed=3).fit(rows)
    scored = distribute.settle(model.transform(rows))
    nodes = trees.node_table(model)
    walked = trees.walk(scored, ["id"], "features", nodes, 3)
    assert "Generate" not in _plan(walked) and "Join" not in _plan(walked)
    audit = trees.audited(model, scored, ["id"], "features", vector_to_array("probability")[1])
    assert tuple(trees.agreement(audit, []).first()) == (300, 300, 5)
    # Rows that share a key are added up, as by the joins.
    monkeypatch.setattr(distribute, "BROADCAST_VALUES", 0)
    twice = scored.withColumn("id", F.col("id") % 100)
    joined = {r.id: (r.margin, r.trees) for r in trees.walk(twice, ["id"], "features", nodes, 3).collect()}
    monkeypatch.undo()
    again = {r.id: (r.margin, r.trees) for r in trees.walk(twice, ["id"], "features", nodes, 3).collect()}
    assert joined.keys() == again.keys() and all(joined[k] == pytest.approx(again[k], abs=1e-9) for k in joined)
