"""The dual-sensor rare-event label, and sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.functions.missing import present
from polarframe.operators.distribute import lookup_join, settle

LABEL = "basal_loss_agreement"


def _limits(df: DataFrame, key: str, name: str, k: float, out: str) -> DataFrame:
    value = present(df, name)
    return settle(df.groupBy(key).agg((F.avg(value) - F.lit(k) * F.stddev_samp(value)).alias(out)))


def agreement_label(
    df: DataFrame,
    k: float = 0.5,
    stats_from: DataFrame | None = None,
    mass: str = "lwe_quarterly_avg",
    height: str = "delta_h",
) -> DataFrame:
    """1 where mass is low for its gravity cell and height change is low for its region.

    ``stats_from`` is the slice means and deviations come from; pass the training months so that
    later months do not leak into the thresholds. A missing input or threshold gives a NULL label.
    """
    source = df if stats_from is None else stats_from
    joined = lookup_join(df, _limits(source, "mascon_id", mass, k, "_mass_limit"), ["mascon_id"])
    joined = lookup_join(joined, _limits(source, "regional_subset_id", height, k, "_height_limit"), ["regional_subset_id"])
    inputs = [present(df, mass), F.col("_mass_limit"), present(df, height), F.col("_height_limit")]
    known = F.lit(True)
    for column in inputs:
        known = known & column.isNotNull()
    both = (inputs[0] < inputs[1]) & (inputs[2] < inputs[3])
    return joined.withColumn(LABEL, F.when(known, both.cast("int"))).drop("_mass_limit", "_height_limit")


def sample_weights(df: DataFrame, label: str = LABEL, region: str = "regional_subset_id", out: str = "weight") -> DataFrame:
    """Inverse-frequency weight of the class times that of the region: n/(K n_class) * n/(R n_region).

    All counts are of the rows that have a label and a region; the others get no weight.
    """
    usable = df.filter(F.col(label).isNotNull() & F.col(region).isNotNull())
    counts = settle(usable.groupBy(label, region).agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    balance = lambda key, alias: counts.groupBy(key).agg(F.sum("n").alias(alias))
    classes, regions = balance(label, "_n_class"), balance(region, "_n_region")
    n_classes, n_regions = classes.agg(F.count(F.lit(1))).scalar(), regions.agg(F.count(F.lit(1))).scalar()
    share = lambda groups, size: total / (groups * F.col(size))
    weight = share(n_classes, "_n_class") * share(n_regions, "_n_region")
    return lookup_join(lookup_join(df, classes, [label]), regions, [region]).withColumn(out, weight).drop("_n_class", "_n_region")


def quality_weights(df: DataFrame, sigma: str = "delta_h_sigma", count: str = "data_count", misfit: str = "misfit_rms", eps: float = 1e-6) -> DataFrame:
    """Precision weight from the stated error, density weight from photon count and roughness."""
    s, n, m = (present(df, c) for c in (sigma, count, misfit))
    return df.withColumns({"precision_weight": F.lit(1.0) / (s * s + F.lit(eps)), "density_weight": n / (F.lit(1.0) + m)})
