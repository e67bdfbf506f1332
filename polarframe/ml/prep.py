"""Preprocessing stages and pipelines; everything is fitted on the training slice."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    PCA, Bucketizer, MinMaxScaler, Normalizer, OneHotEncoder, PolynomialExpansion, StandardScaler,
    StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.functions.missing import is_missing, present
from polarframe.ml.stages import MedianImputer
from polarframe.ml.svd import SvdModel, fit_svd, svd_project  # noqa: F401  (used as prep.fit_svd and so on)
from polarframe.operators.profile import quantiles

# Borders of the grounding-line distance classes in metres.
GL_SPLITS = [-float("inf"), 5e3, 2e4, 5e4, 1e5, float("inf")]
POLY_TRIPLE = ["t_star_mo", "ice_draft", "dist_to_grounding_line"]
OCEAN_EIGHT = ["thetao_mo", "t_star_mo", "so_mo", "t_f_mo", "t_star_quarterly_avg", "t_star_quarterly_std", "thetao_quarterly_avg", "thetao_quarterly_std"]
META_CONTEXT = ["t_star_mo", "ice_draft", "dist_to_grounding_line", "delta_h_momentum", "lwe_trend"]
META_NAMES = ["rf_pos_prob", "gbt_score", "base_agreement"] + [f"{c}_meta" for c in META_CONTEXT]


def imputed(name: str) -> str:
    return f"{name}_imputed"


def usable(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least one value: an all-missing column has no median."""
    seen = df.agg(*[F.count_if(~is_missing(df, c)).alias(c) for c in columns]).first()
    return [c for c in columns if seen[c]]


def impute_median(columns: list[str]) -> MedianImputer:
    return MedianImputer(inputCols=columns, outputCols=[imputed(c) for c in columns])


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact lower median in place of missing values; a column without values keeps them missing."""
    medians = {r["column"]: r["low"] for r in quantiles(df, columns, [0.5]).collect()}  # one row per column
    return df.withColumns({imputed(c): F.coalesce(present(df, c).cast("double"), F.lit(medians[c])) for c in columns})


def gl_buckets(source: str = "dist_to_grounding_line") -> Bucketizer:
    return Bucketizer(splits=GL_SPLITS, inputCol=source, outputCol="gl_bucket_idx", handleInvalid="keep")


def index_region(source: str = "regional_subset_id") -> StringIndexer:
    return StringIndexer(inputCol=source, outputCol="region_index", handleInvalid="keep")


def one_hot(columns: dict[str, str]) -> OneHotEncoder:
    """``columns`` maps index columns to vector columns; an index unseen in training is kept."""
    return OneHotEncoder(inputCols=list(columns), outputCols=list(columns.values()), handleInvalid="keep")


def assemble(columns: list[str], out: str = "raw_features") -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip")


def minmax(source: str = "raw_features", out: str = "features") -> MinMaxScaler:
    return MinMaxScaler(inputCol=source, outputCol=out)


def standardize(source: str = "raw_features", out: str = "features") -> StandardScaler:
    return StandardScaler(inputCol=source, outputCol=out, withMean=True, withStd=True)


def l2_normalize(source: str = "raw_features", out: str = "features") -> Normalizer:
    return Normalizer(inputCol=source, outputCol=out, p=2.0)


def poly_triple(degree: int = 2, source: str = "poly_input") -> PolynomialExpansion:
    return PolynomialExpansion(degree=degree, inputCol=source, outputCol="poly_features")


def ocean_pca(k: int = 4, source: str = "ocean_vec") -> PCA:
    return PCA(k=k, inputCol=source, outputCol="ocean_pca")


def build_pipeline(kind: str, numeric: list[str]) -> Pipeline:
    """``xgb`` (min-max), ``classic`` (polynomial, ocean components, standardised) or ``stack`` (L2)."""
    scaler = {"xgb": minmax, "classic": standardize, "stack": l2_normalize}[kind]()
    distance = "dist_to_grounding_line"
    stages = [
        impute_median(numeric),
        gl_buckets(imputed(distance) if distance in numeric else distance),
        index_region(),
        one_hot({"gl_bucket_idx": "gl_bucket_ohe", "region_index": "region_ohe"}),
    ]
    inputs = [imputed(c) for c in numeric] + ["gl_bucket_ohe", "region_ohe"]
    if kind == "classic":
        ocean = [c for c in OCEAN_EIGHT if c in numeric]
        if set(POLY_TRIPLE) <= set(numeric):
            stages += [assemble([imputed(c) for c in POLY_TRIPLE], "poly_input"), poly_triple()]
            inputs.append("poly_features")
        if len(ocean) >= 4:
            stages += [assemble([imputed(c) for c in ocean], "ocean_vec"), ocean_pca()]
            inputs.append("ocean_pca")
    return Pipeline(stages=[*stages, assemble(inputs), scaler])


def meta_features(df: DataFrame, context: list[str] = META_CONTEXT) -> DataFrame:
    """Three base-model outputs and the context columns as one small vector.

    The base models' own vector columns are dropped, so the meta-learner can use the default names.
    """
    named = df.withColumns(
        {
            "rf_pos_prob": vector_to_array(F.col("rf_probability")).getItem(1),
            "gbt_score": vector_to_array(F.col("gbt_probability")).getItem(1),
            "base_agreement": (F.col("rf_prediction") == F.col("gbt_prediction")).cast("double"),
        }
        | {f"{c}_meta": F.col(imputed(c) if imputed(c) in df.columns else c).cast("double") for c in context}
    )
    base = [f"{m}_{c}" for m in ("rf", "gbt") for c in ("rawPrediction", "probability", "prediction")]
    names = ["rf_pos_prob", "gbt_score", "base_agreement"] + [f"{c}_meta" for c in context]
    return assemble(names, "meta_features").transform(named).drop(*base)
