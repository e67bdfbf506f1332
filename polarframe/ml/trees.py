"""Fitted tree ensembles as tables of nodes, and scoring by joins with them.

A model that lives only inside one library can't be audited: ``node_table`` writes it as plain rows (tree, node, feature, threshold,
categories, left, right, value, weight, rows), and ``walk`` scores rows with that table alone. Any SQL engine
can do the same from the two tables (a test does), so a stored probability can be checked without the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.operators import distribute
from polarframe.operators.distribute import lookup_join, scratch_path, settle

#: A walked and a stored score may differ by the order of a sum of doubles.
TOLERANCE = 1e-9
#: Places (rows times trees) that one step of a walk moves at once.
PLACES = 1 << 20


def node_table(model) -> DataFrame:
    """One row per node of a fitted forest or of boosted trees; inner nodes have ``left`` and ``right``, leaves have neither.

    A row goes left if its feature is at most ``threshold``, or, where ``categories`` is not null, among those. ``value`` is a leaf's
    share of the positive class in a forest for classification and its prediction otherwise, ``weight`` the tree's factor in the sum, ``rows``
    the number of training rows that reached the node.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "nodes")
    model.write().save(path)
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])  # one value per tree
    n, s = F.col("nodeData"), F.col("nodeData.split")
    stats = n["impurityStats"]
    share = F.try_divide(stats[1], F.aggregate(stats, F.lit(0.0), lambda a, b: a + b))
    inner, ordered = n["leftChild"] >= 0, s["numCategories"] < 0
    return settle(spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, s["featureIndex"]).alias("feature"),
        F.when(inner & ordered, s["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(inner & ~ordered, s["leftCategoriesOrThreshold"]).alias("categories"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        (share if _votes(model) else n["prediction"]).alias("value"), F.get(weights, F.col("treeID")).alias("weight"), n["rawCount"].alias("rows"),
    ))


def _votes(model) -> bool:
    """Forests for classification average the classes' shares in their leaves; all others add up predictions."""
    return type(model).__name__ == "RandomForestClassificationModel"


def score_of(model, margin: Column, trees: Column) -> Column:
    """The model's probability of the positive class (or its prediction) from the weighted sum over its trees."""
    name = type(model).__name__
    if name == "GBTClassificationModel":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))
    return margin / trees if name.startswith("RandomForest") else margin


def walk(rows: DataFrame, keys: list[str], features: str, nodes: DataFrame, depth: int) -> DataFrame:
    """(keys, margin, trees): the weighted sum of the leaves that each row of ``rows`` reaches, and the number of trees.

    ``keys`` name a row; rows that share them are added up. A table of nodes below ``BROADCAST_VALUES`` goes to every task, where a
    batch of rows steps down all trees at once and leaves one sum per row. Beyond that a row is repeated per tree and meets one node per level: ``depth``
    joins with the table of nodes and one aggregate that combines before it shuffles.
    """
    if nodes.count() * len(nodes.columns) <= distribute.BROADCAST_VALUES:
        return _walk_batches(rows, keys, features, nodes, depth)
    values = rows.select(*keys, vector_to_array(F.col(features)).alias("_f"))
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    state = values.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"))
    inner = nodes.where("left is not null").select("tree", "node", "feature", "threshold", "categories", "left", "right")
    for _ in range(depth):
        met = lookup_join(state, inner, ["tree", "node"])
        value = F.get("_f", F.col("feature"))
        goes_left = F.when(F.col("categories").isNotNull(), F.array_contains("categories", value)).otherwise(value <= F.col("threshold"))
        ahead = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        state = met.select(*keys, "_f", "tree", ahead.alias("node"))
    leaves = nodes.where("left is null").select("tree", "node", (F.col("value") * F.col("weight")).alias("_v"))
    return lookup_join(state, leaves, ["tree", "node"], "inner").groupBy(*keys).agg(F.sum("_v").alias("margin"), F.count(F.lit(1)).alias("trees"))


def _walk_batches(rows: DataFrame, keys: list[str], features: str, nodes: DataFrame, depth: int) -> DataFrame:
    """The walk of ``walk`` with the nodes as arrays: a place is a node's position, and a leaf's children are itself."""
    table = nodes.select("tree", "node", "feature", "threshold", "categories", "left", "right", "value", "weight").orderBy("tree", "node").collect()
    at = {(n.tree, n.node): i for i, n in enumerate(table)}  # a model's nodes: below the bound of broadcasts
    child = lambda side: np.array([i if n[side] is None else at[n.tree, n[side]] for i, n in enumerate(table)], np.int32)
    left, right = child("left"), child("right")
    feature = np.array([n.feature or 0 for n in table], np.int32)
    threshold = np.array([np.nan if n.threshold is None else n.threshold for n in table])
    sets = [(i, n.categories) for i, n in enumerate(table) if n.categories is not None]
    # Categories are small whole numbers; one row of flags per node that has a set of them, and a row without any.
    member = np.zeros((len(sets) + 1, int(max((max(c, default=0) for _, c in sets), default=0)) + 2), bool)
    chosen = np.full(len(table), -1, np.int32)
    for k, (i, c) in enumerate(sets):
        chosen[i] = k
        member[k, [int(v) for v in c]] = True
    leaf = np.array([n.value * n.weight if n.left is None else 0.0 for n in table])
    roots = np.array([i for i, n in enumerate(table) if n.node == 0], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PLACES // len(roots))
        for batch in batches:
            for part in (batch.slice(s, step) for s in range(0, batch.num_rows, step)):
                vectors = part.column("_f")
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                line = np.arange(part.num_rows)[:, None]
                place = np.broadcast_to(roots, (part.num_rows, len(roots)))
                for _ in range(depth):
                    value = x[line, feature[place]]
                    goes_left = value <= threshold[place]
                    if sets:
                        known = (value >= 0) & (value < member.shape[1]) & (value == np.floor(value))
                        goes_left |= member[chosen[place], np.where(known, value, -1).astype(np.int32)] & known
                    place = np.where(goes_left, left[place], right[place])
                sums = leaf[place].sum(axis=1)
                found = [pa.array(sums), pa.array(np.full(part.num_rows, len(roots), np.int64))]
                yield pa.record_batch([*[part.column(k) for k in keys], *found], [*keys, "margin", "trees"])

    values = rows.select(*keys, vector_to_array(F.col(features)).alias("_f"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    walked = values.mapInArrow(run, f"{kinds}, margin double, trees bigint")
    return walked.groupBy(*keys).agg(F.sum("margin").alias("margin"), F.sum("trees").alias("trees"))


def audited(model, scored: DataFrame, keys: list[str], features: str, stored: Column) -> DataFrame:
    """(keys, stored, walked, trees): the score that ``scored`` holds beside the one that the model's table of nodes gives."""
    depth = max(t.depth for t in model.trees)
    walked = walk(scored, keys, features, node_table(model), depth)
    kept = scored.select(*keys, stored.alias("stored"))
    return kept.join(walked, keys).select(*keys, "stored", score_of(model, F.col("margin"), F.col("trees")).alias("walked"), "trees")


def agreement(audit: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_equal, trees): rows and rows whose two scores agree, per group."""
    same = F.abs(F.col("stored") - F.col("walked")) <= TOLERANCE
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"), F.max("trees").alias("trees"))
