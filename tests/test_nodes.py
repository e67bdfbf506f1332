"""Tables of nodes: DuckDB walks the exported trees over the exported features and must get every stored score."""

import duckdb
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from polarframe.ml import trees
from polarframe.operators import distribute

WALK = """
with recursive w as (
  select id, tree, 0 as node from rows, (select distinct tree from nodes)
  union all
  select w.id, w.tree, case when case when n.categories is not null then list_contains(n.categories, r.f[n.feature::bigint + 1]) else r.f[n.feature::bigint + 1] <= n.threshold end
    then n."left" else n."right" end
  from w join nodes n on n.tree = w.tree and n.node = w.node join rows r on r.id = w.id where n."left" is not null
)
select w.id, sum(n.value * n.weight) as margin, count(*) as trees from w join nodes n on n.tree = w.tree and n.node = w.node where n."left" is null group by 1
"""


@pytest.fixture(scope="module")
def frame(spark):
    """Two numbers and a category as one-hot columns, which trees split by sets of values."""
    df = spark.range(500).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 4).cast("double").alias("k"))
    df = df.withColumn("label", (F.col("a") * F.col("b") + F.col("k") / 10 > 0.4).cast("double")).withColumn("y", F.col("a") + F.col("k"))
    hot = OneHotEncoder(inputCols=["k"], outputCols=["o"]).fit(df).transform(df)
    return distribute.settle(VectorAssembler(inputCols=["a", "o", "b"], outputCol="features").transform(hot))


@pytest.mark.parametrize("kind", [GBTClassifier, RandomForestClassifier, GBTRegressor, RandomForestRegressor])
@pytest.mark.parametrize("broadcast", [True, False])
def test_sql_walks_to_every_stored_score(spark, frame, kind, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(distribute, "BROADCAST_VALUES", 0)
    classifier = "Classifier" in kind.__name__
    model = kind(labelCol="label" if classifier else "y", maxDepth=4, seed=3, **({"maxIter": 7} if "GBT" in kind.__name__ else {"numTrees": 7})).fit(frame)
    stored = vector_to_array("probability")[1] if classifier else F.col("prediction")
    scored = distribute.settle(model.transform(frame))
    audit = trees.audited(model, scored, ["id"], "features", stored)
    whole = trees.agreement(audit, []).first()
    assert (whole.n, whole.n_equal, whole.trees) == (500, 500, 7)
    con = duckdb.connect()
    nodes, rows = trees.node_table(model).toPandas(), frame.select("id", vector_to_array("features").alias("f")).toPandas()
    nodes["left"], nodes["right"] = nodes["left"].astype("Int64"), nodes["right"].astype("Int64")
    con.register("nodes", nodes), con.register("rows", rows)
    margins = {i: (m, n) for i, m, n in con.execute(WALK).fetchall()}
    formula = trees.score_of(model, F.col("m"), F.col("n"))
    again = spark.createDataFrame([(i, m, n) for i, (m, n) in margins.items()], "id long, m double, n long").select("id", formula.alias("p"))
    want = {r.id: r.p for r in scored.select("id", stored.alias("p")).collect()}
    got = {r.id: r.p for r in again.collect()}
    assert len(got) == 500 and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_a_forged_score_is_found(spark, frame):
    model = GBTClassifier(labelCol="label", maxDepth=3, maxIter=4, seed=3).fit(frame)
    stored = F.when(F.col("id") == 7, F.lit(0.123)).otherwise(vector_to_array("probability")[1])
    audit = trees.audited(model, distribute.settle(model.transform(frame)), ["id"], "features", stored)
    assert trees.agreement(audit, []).first().n_equal == 499
