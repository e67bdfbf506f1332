"""Singular value decomposition of a vector column through its Gram matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SvdModel:
    """Right singular vectors of the training matrix; projects rows as Z = X V."""

    components: np.ndarray
    singular_values: np.ndarray
    explained: np.ndarray
    features: str
    out: str

    def transform(self, df: DataFrame) -> DataFrame:
        v = self.components

        @F.pandas_udf("array<double>")
        def project(rows: pd.Series) -> pd.Series:
            return pd.Series(list(np.vstack(rows.to_numpy()) @ v) if len(rows) else [])

        return df.withColumn(self.out, array_to_vector(project(vector_to_array(F.col(self.features)))))

    def explained_variance(self, df: DataFrame) -> DataFrame:
        rows = [(i + 1, float(s), float(e)) for i, (s, e) in enumerate(zip(self.singular_values, np.cumsum(self.explained)))]
        return df.sparkSession.createDataFrame(rows, "component int, singular_value double, cumulative double")


def fit_svd(df: DataFrame, k: int = 20, features: str = "features", out: str = "svd_features") -> SvdModel:
    """SVD through the distributed d x d Gram matrix, rebuilt from moments Spark computes in the JVM.

    X'X = (n - 1) covariance + n mean mean'. Only d x d numbers reach the driver.
    """
    stats = df.select(Summarizer.metrics("count", "mean", "std").summary(F.col(features)).alias("s")).first().s
    n, mean, std = stats["count"], stats["mean"].toArray(), stats["std"].toArray()
    correlation = np.nan_to_num(Correlation.corr(df, features).first()[0].toArray(), nan=0.0)
    np.fill_diagonal(correlation, 1.0)
    gram = (n - 1) * correlation * np.outer(std, std) + n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][: min(k, len(values))]
    kept = np.clip(values[order], 0.0, None)
    total = max(float(np.clip(values, 0.0, None).sum()), np.finfo(float).tiny)
    # A fixed sign: the entry of largest size of every component is positive.
    chosen = vectors[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return SvdModel(chosen * signs, np.sqrt(kept), kept / total, features, out)


def svd_project(df: DataFrame, k: int = 20, features: str = "features", out: str = "svd_features") -> DataFrame:
    return fit_svd(df, k, features, out).transform(df)
