"""Writing the fact table, cutting lineage through Parquet, saving predictions, previews."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame


def write_observations(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by month.

    ``rebalance`` clusters rows by month but lets adaptive execution split a month that is larger
    than the advisory size, so a crowded month is not written by one task as one file.
    """
    df.hint("rebalance", "month_idx").write.mode(mode).partitionBy("month_idx").parquet(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: a plan that starts at a file scan with known size and statistics."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_predictions(df: DataFrame, model: str, split: str, root: str) -> str:
    """Predictions of one (model, split), under a folder Spark reads back as partition columns; names are escaped as Spark does."""
    path = f"{root}/model={quote(model, safe='')}/split={quote(split, safe='')}"
    df.drop("model", "split").write.mode("overwrite").parquet(path)
    return path


def preview(df: DataFrame, columns: list[str], key: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by ``key``: a top-n per task and a merge, not a full sort."""
    return df.select(*dict.fromkeys([*columns, *key])).orderBy(*key).limit(n).select(*columns)
