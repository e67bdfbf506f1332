"""Source products to a scored model, end to end on a small made-up ice shelf."""

import pytest
from pyspark.sql import functions as F

from polarframe.ml import evaluate as ev
from polarframe.ml import models, prep
from polarframe.operators import labels, splits
from polarframe.operators.distribute import settle
from polarframe.plans.observations import feature_table, observation_table
from polarframe.sources.schemas import V2

SIDE, FIRST, MONTHS = 12, 2020 * 12 + 4, 36


@pytest.fixture(scope="module")
def products(spark):
    cells = spark.range(SIDE * SIDE).select((F.col("id") % SIDE).alias("cell_x"), F.floor(F.col("id") / SIDE).alias("cell_y"))
    x, y = F.col("cell_x"), F.col("cell_y")
    mask = F.when(y == 0, None).when(y < 4, 3).when(y == 4, 2).otherwise(1)
    topography = cells.select("*", (y * 20 + x + 30).cast("double").alias("surface"), (-500 - y * 10.0).alias("bed"), (y * 40 + 300).cast("double").alias("thickness"), mask.alias("mask"))
    months = cells.withColumn("month_idx", F.explode(F.sequence(F.lit(FIRST), F.lit(FIRST + MONTHS - 1))))
    noise = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1000)) / 1000.0
    event = noise("month_idx", F.lit(7)) < 0.3
    altimetry = months.select("*", (x * 500.0).alias("x"), (y * 500.0).alias("y"), F.lit(None).cast("timestamp").alias("exact_time"), F.lit(1.0).alias("ice_area"),
                              (noise("cell_x", "cell_y", "month_idx") - F.when(event & (y < 6), 3.0).otherwise(0.0)).alias("delta_h"))
    mascon = F.floor(F.col("cell_x") / 4).cast("int")
    gravity = months.select(mascon.alias("mascon_id"), "month_idx", event.alias("e")).distinct().select("mascon_id", "month_idx", (noise("month_idx") - F.when(F.col("e"), 5.0).otherwise(0.0)).alias("lwe_thickness_cm"))
    sea = months.select(F.lit(0).cast("bigint").alias("ocean_x"), F.lit(0).cast("bigint").alias("ocean_y"), "month_idx").distinct()
    ocean = sea.withColumn("depth", F.explode(F.array(F.lit(50.0), F.lit(200.0), F.lit(350.0)))).withColumns({"thetao": F.col("depth") / 500 - 1.0, "so": F.lit(34.0)})
    mascon_map = cells.withColumn("mascon_id", mascon)
    region_map = spark.createDataFrame([(0, "ross"), (1, "ross"), (2, "ronne")], "mascon_id int, regional_subset_id string")
    return altimetry, topography, gravity, ocean, mascon_map, region_map


@pytest.fixture(scope="module")
def fact(products):
    return settle(observation_table(*products, keep=["retrograde_flag"]))


def test_fact_table_has_the_fixed_schema(fact):
    assert [(f.name, f.dataType) for f in fact.schema][: len(V2)] == [(f.name, f.dataType) for f in V2]
    assert fact.count() == SIDE * SIDE * MONTHS


def test_fact_table_values(fact):
    rows = {(r.x, r.y): r for r in fact.filter(F.col("month_idx") == FIRST).collect()}
    shelf, inland = rows[(1000.0, 1000.0)], rows[(1000.0, 4000.0)]
    assert shelf.dist_to_grounding_line == 1000.0 and shelf.dist_to_ocean == 1000.0
    assert inland.dist_to_grounding_line == 2000.0 and inland.dist_to_ocean == 4000.0
    assert shelf.ice_draft == 308.0 and shelf.clamped_depth == 308.0
    assert shelf.thetao_mo == pytest.approx(-0.3) and inland.thetao_mo is None
    assert shelf.t_star_mo == pytest.approx(-0.3 + 0.057 * 34 + 0.00076 * 308, rel=1e-5)
    assert shelf.bed_slope == pytest.approx(0.02) and shelf.retrograde_flag == 1
    mean = fact.filter(F.col("mascon_id") == 0).groupBy("month_idx").agg(F.avg("lwe_fused").alias("a"), F.avg("lwe_mo").alias("b"))
    assert mean.filter(F.abs(F.col("a") - F.col("b")) > 1e-5).count() == 0


@pytest.mark.parametrize("place, name", [(0, "altimetry"), (1, "topography"), (2, "gravity"), (4, "mascon_map"), (5, "region_map")])
def test_doubled_keys_are_an_error(products, place, name):
    doubled = [p.unionByName(p.limit(1)) if i == place else p for i, p in enumerate(products)]
    with pytest.raises(ValueError, match=name):
        observation_table(*doubled)


def test_features_to_scores(spark, fact):
    features = settle(feature_table(fact))
    labelled = labels.agreement_label(features, stats_from=features.filter(F.col("month_idx") <= splits.TRAIN_END))
    rows = settle(labels.sample_weights(splits.temporal_split(labelled.filter(F.col(labels.LABEL).isNotNull()))))
    assert 0.02 < rows.agg(F.avg(labels.LABEL)).first()[0] < 0.6
    numeric = ["delta_h_momentum", "delta_h_deviation", "lwe_trend", "t_star_mo", "ice_draft", "dist_to_grounding_line", "regional_delta_h_percentile", "thermal_x_gl_proximity"]
    rows = rows.withColumns({c: F.col(c).cast("double") for c in numeric})
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    stages = prep.build_pipeline("xgb", prep.usable(train, numeric)).fit(train)
    model = models.boosted("baseline", n_estimators=5, max_depth=3, min_child=1).fit(settle(splits.undersample(stages.transform(train), ratio=3.0)))
    out = {r.split: r for r in ev.evaluate_all([ev.to_scores(model.transform(stages.transform(d)), "gbt", s, labels.LABEL) for s, d in (("train", train), ("val", val))]).collect()}
    assert out["train"].roc_auc > 0.9 and 0.0 <= out["train"].pr_auc <= 1.0
