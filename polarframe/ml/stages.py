"""Pipeline stages the ML library lacks: exact medians and an SVD, fitted, saved and loaded like its own."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarframe.functions.missing import present
from polarframe.ml.svd import SvdModel, fit_svd
from polarframe.operators.profile import quantiles


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Exact lower median of every input column in place of its missing values (NULL or NaN).

    All columns are selected in the same passes of ``quantiles``. A column without any value has no median and is an error.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        names = self.getInputCols()
        found = {r["column"]: r["low"] for r in quantiles(dataset, names, [0.5]).collect()}  # one row per column
        empty = [n for n in names if found[n] is None]
        if empty:
            raise ValueError(f"no value to take a median of: {empty}")
        return self._copyValues(MedianImputerModel(medians=[found[n] for n in names]))


class MedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "a value per input column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, medians: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians))
        return dataset.withColumns({o: F.coalesce(present(dataset, c).cast("double"), F.lit(m)) for c, o, m in columns})


class Svd(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Projection of a vector column onto the first ``k`` right singular vectors of the fitted rows."""

    k = Param(Params._dummy(), "k", "number of components", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k: int = 20, inputCol: str = "features", outputCol: str = "svd_features"):
        super().__init__()
        self._set(**{"k": k, "inputCol": inputCol, "outputCol": outputCol})

    def _fit(self, dataset: DataFrame) -> SvdStage:
        return self._copyValues(SvdStage(fit_svd(dataset, self.getOrDefault(self.k), self.getInputCol(), self.getOutputCol())))


class SvdStage(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """A fitted SVD as a stage; its matrix is saved as a table, a row per component."""

    k = Param(Params._dummy(), "k", "number of components", typeConverter=TypeConverters.toInt)

    def __init__(self, svd: SvdModel | None = None):
        super().__init__()
        self.svd = svd

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.svd.transform(dataset)

    def write(self) -> MLWriter:
        return _SvdWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SvdReader(cls)


class _SvdWriter(MLWriter):
    def __init__(self, stage: SvdStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark, svd = SparkSession.active(), self.stage.svd
        DefaultParamsWriter.saveMetadata(self.stage, path, spark)
        rows = [(i, float(s), float(e), [float(x) for x in v]) for i, (s, e, v) in enumerate(zip(svd.singular_values, svd.explained, svd.components.T))]
        spark.createDataFrame(rows, "i int, singular_value double, explained double, vector array<double>").coalesce(1).write.parquet(f"{path}/data")


class _SvdReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SvdStage:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        rows = spark.read.parquet(f"{path}/data").orderBy("i").collect()  # one row per component
        components = np.array([r.vector for r in rows]).T
        stage.svd = SvdModel(components, np.array([r.singular_value for r in rows]), np.array([r.explained for r in rows]), stage.getInputCol(), stage.getOutputCol())
        return stage
