"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, oracle_connection, types_note

from polarframe.operators import distribute

SF = "/root/testdata/sf0.001"
CHECKED = sorted(oracle_sql())
UNCHECKED = sorted(set(queries()) - set(CHECKED))


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, oracle, name):
    df = queries()[name](spark, SF)
    want = oracle.execute(oracle_sql()[name]).df().astype(object).where(lambda d: d.notna(), None)
    assert difference(df.toPandas(), want) is None
    assert types_note(dict(df.dtypes), oracle, oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["x", "y", "regional_subset_id", "mean_delta_h", "mean_zscore"]
    assert df.count() > 0


BEYOND = [
    "fuse", "bilinear", "lookup_coarse", "regional_zscore", "agreement_label", "undersample_by_region", "sample_weights",
    "nearest_distance", "neighbourhood_fraction", "sample_nearest_depth", "clamp_depth", "join_static", "roc_auc", "box_stats",
]


@pytest.mark.parametrize("name", BEYOND)
def test_equals_sql_beyond_the_broadcast_bound(spark, oracle, name, monkeypatch):
    """The same results when no lookup table counts as small: salted shuffle joins everywhere."""
    monkeypatch.setattr(distribute, "BROADCAST_VALUES", 0)
    want = oracle.execute(oracle_sql()[name]).df().astype(object).where(lambda d: d.notna(), None)
    assert difference(queries()[name](spark, SF).toPandas(), want) is None
