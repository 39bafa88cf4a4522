"""The linear models as pyspark.ml Estimators with models that can be saved, and fits that are kept by what they were fitted on."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.operators import models


class _LinearParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Columns of feature arrays, target arrays and predicted arrays."""

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(featuresCol="features", labelCol="targets", predictionCol="prediction")


class LinearModel(Model, _LinearParams, MLWritable, MLReadable):
    """Weights (features, targets) and offsets; `facts` has what the fit tells beside them."""

    def __init__(self, weights: np.ndarray | None = None, offset: np.ndarray | None = None, facts: dict | None = None):
        super().__init__()
        self.weights, self.offset, self.facts = weights, offset, facts or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return models.predict(dataset, self.getFeaturesCol(), self.weights, self.getPredictionCol(), self.offset)

    def write(self) -> MLWriter:
        return _LinearWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LinearReader()


class _LinearWriter(MLWriter):
    def __init__(self, model: LinearModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802 (its name in pyspark.ml)
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"facts": self.model.facts})
        rows = [(k, [float(x) for x in w]) for k, w in enumerate([self.model.offset, *self.model.weights])]
        self.sparkSession.createDataFrame(rows, "place int, w array<double>").write.parquet(f"{path}/weights")


class _LinearReader(MLReader):
    def load(self, path: str) -> LinearModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = sorted((r.place, r.w) for r in self.sparkSession.read.parquet(f"{path}/weights").collect())
        model = LinearModel(np.array([w for _, w in rows[1:]]), np.array(rows[0][1]), metadata["facts"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class LeastSquares(Estimator, _LinearParams, DefaultParamsReadable, DefaultParamsWritable):
    """Weights of minimum norm, without intercept or scaling, from one pass over the rows."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "targets", predictionCol: str = "prediction"):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearModel:
        (n, g), *_ = models.gram(dataset, self.getFeaturesCol(), self.getLabelCol()).values()
        dims = len(dataset.select(self.getFeaturesCol()).first()[0])
        w = np.linalg.pinv(g[:dims, :dims], hermitian=True) @ g[:dims, dims:-1]
        return self._copyValues(LinearModel(w, np.zeros(w.shape[1]), {"rows": n}))


class RidgeCV(Estimator, _LinearParams, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge on z-scored features, the penalty chosen by held-out R2 over the folds of the columns foldCols; facts: alpha and the mean score of each."""

    foldCols = Param(Params._dummy(), "foldCols", "columns with the number of a row's fold, one for each repeat", TypeConverters.toListString)
    alphas = Param(Params._dummy(), "alphas", "penalties to choose from", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "targets", predictionCol: str = "prediction", foldCols: list[str] | None = None, alphas: list[float] | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(foldCols=["fold"], alphas=[float(a) for a in np.logspace(-5, 2, 10)])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LinearModel:
        dims = len(dataset.select(self.getFeaturesCol()).first()[0])
        fit = models.ridge_cv(dataset, self.getFeaturesCol(), self.getLabelCol(), dims, self.getOrDefault(self.foldCols), np.array(self.getOrDefault(self.alphas)))
        return self._copyValues(LinearModel(fit["weights"], fit["offset"], {"alpha": fit["alpha"], "scores": fit["scores"]}))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A digest of a table's rows in these columns, whatever their order: their number, and the sum of two hashes of each row."""
    two = [F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)") for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(h) for h in two]).first()
    return hashlib.sha256(json.dumps([str(x) for x in row]).encode()).hexdigest()[:32]


def fit_kept(estimator: Estimator, df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> tuple[Model, bool]:
    """The estimator's model of df, and whether it was read: a fit is kept under path by the estimator's parameters and the rows' fingerprint.

    columns are those that the fit depends on. The same rows with the same parameters are fitted once; with overwrite they are fitted
    anew. A model that another writer puts there meanwhile is replaced.
    """
    named = {p.name: v for p, v in sorted(estimator.extractParamMap().items(), key=lambda x: x[0].name)}
    key = hashlib.sha256(json.dumps([type(estimator).__name__, named, fingerprint(df, columns)], sort_keys=True, default=str).encode()).hexdigest()[:32]
    at, spark = f"{path.rstrip('/')}/{type(estimator).__name__}-{key}", df.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/weights/_SUCCESS")  # the last that a writer writes
    if not overwrite and jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return LinearModel.load(at), True
    model = estimator.fit(df)
    model.write().overwrite().save(at)
    return model, False
