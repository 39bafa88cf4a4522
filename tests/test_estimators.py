"""Estimators and fits that are kept, against the plain functions."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from stimframe.operators import estimators, models


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(31)
    x = g.normal(size=(120, 3))
    y = x @ g.normal(size=(3, 2)) + 0.1 * g.normal(size=(120, 2)) + 1
    return x, y, spark.createDataFrame([(i, a.tolist(), b.tolist(), i % 5) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, y array<double>, fold int").repartition(3)


def test_fits_are_those_of_the_functions(data):
    x, y, df = data
    plain = estimators.LeastSquares(featuresCol="x", labelCol="y").fit(df)
    assert np.allclose(plain.weights, np.linalg.lstsq(x, y, rcond=None)[0]) and plain.facts == {"rows": 120}
    want = models.ridge_cv(df, "x", "y", 3, "fold")
    fit = estimators.RidgeCV(featuresCol="x", labelCol="y").fit(df)
    assert fit.facts["alpha"] == want["alpha"] and np.allclose(fit.weights, want["weights"])
    got = np.array([r.prediction for r in fit.transform(df).orderBy("id").collect()])
    assert np.allclose(got, x @ want["weights"] + want["offset"])


def test_pipeline_comes_back_from_its_folder(data, tmp_path):
    _, _, df = data
    fit = Pipeline(stages=[estimators.RidgeCV(featuresCol="x", labelCol="y", predictionCol="p", alphas=[0.1, 1.0])]).fit(df)
    fit.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.stages[0].facts == fit.stages[0].facts and np.allclose(back.stages[0].weights, fit.stages[0].weights)
    assert [r.p for r in back.transform(df).orderBy("id").collect()] == [r.p for r in fit.transform(df).orderBy("id").collect()]


def test_a_second_fit_reads(data, tmp_path, monkeypatch):
    _, _, df = data
    est = estimators.RidgeCV(featuresCol="x", labelCol="y")
    first, read = estimators.fit_kept(est, df, str(tmp_path), ["x", "y", "fold"])
    assert not read
    passes = []
    gram = models.gram
    monkeypatch.setattr(models, "gram", lambda *a, **b: passes.append(1) or gram(*a, **b))
    again, read = estimators.fit_kept(est, df.repartition(7).orderBy(F.desc("id")), str(tmp_path), ["x", "y", "fold"])
    assert read and not passes and np.array_equal(again.weights, first.weights) and again.getFeaturesCol() == "x"
    assert estimators.fit_kept(est, df, str(tmp_path), ["x", "y", "fold"], overwrite=True)[1] is False and passes
    for other, rows in ((estimators.RidgeCV(featuresCol="x", labelCol="y", alphas=[1.0]), df), (est, df.where("id > 0")), (estimators.LeastSquares(featuresCol="x", labelCol="y"), df)):
        assert estimators.fit_kept(other, rows, str(tmp_path), ["x", "y", "fold"])[1] is False


def test_fingerprint(data):
    _, _, df = data
    assert estimators.fingerprint(df, ["id", "x"]) == estimators.fingerprint(df.repartition(5), ["id", "x"])
    assert len({estimators.fingerprint(d, ["id", "fold"]) for d in (df, df.unionAll(df), df.where("id > 1"), df.withColumn("fold", F.lit(1)), df.where("id < 0"))}) == 5
