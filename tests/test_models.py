"""Models and kernels against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.functions import signal
from stimframe.operators import models, rank, vectors


@pytest.fixture(scope="module")
def data(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(200, 4))
    y = x @ g.normal(size=(4, 2)) + 0.1 * g.normal(size=(200, 2)) + 1
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, y array<double>").repartition(3)
    return x, y, df


def test_lstsq(data):
    x, y, df = data
    assert np.allclose(models.lstsq(df, "x", "y", 4), np.linalg.lstsq(x, y, rcond=None)[0])


def test_lstsq_of_a_repeated_column(data):
    x, y, df = data
    twice = df.withColumn("x", F.concat("x", F.slice("x", 1, 1)))
    assert np.allclose(models.lstsq(twice, "x", "y", 5), np.linalg.lstsq(np.column_stack((x, x[:, 0])), y, rcond=None)[0], atol=1e-8)


def test_ridge(data):
    x, y, df = data
    fit = models.ridge_cv(df.withColumn("fold", F.col("id") % 5), "x", "y", 4, "fold")
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + fit["alpha"] * np.eye(4), z.T @ (y - y.mean(0))) / x.std(0)[:, None]
    assert np.allclose(fit["weights"], w) and np.allclose(fit["offset"], y.mean(0) - x.mean(0) @ w)
    scores = []
    for k in range(5):
        at = np.arange(200) % 5 != k
        zz = (x - x[at].mean(0)) / x[at].std(0)
        ww = np.linalg.solve(zz[at].T @ zz[at] + 1e-5 * np.eye(4), zz[at].T @ (y[at] - y[at].mean(0)))
        e = y[~at] - zz[~at] @ ww - y[at].mean(0)
        scores.append(np.mean(1 - (e**2).sum(0) / ((y[~at] - y[~at].mean(0)) ** 2).sum(0)))
    assert np.isclose(fit["scores"][0], np.mean(scores))


def test_pca(data):
    x, _, df = data
    fit = models.pca(df, "x", 4, 3)
    z = (x - x.mean(0)) / x.std(0)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(fit["ratio"], (s / s.sum())[:3])
    rows = models.pca_transform(df, "x", fit).orderBy("id").collect()
    assert np.allclose([r.scores for r in rows], z @ fit["components"])


def test_logistic_reaches_the_optimum(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(150, 2))
    y = (x @ [1.0, -2.0] + g.normal(size=150) > 0).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, y int")
    p = np.array([r.proba[1] for r in models.logistic(df, "x", F.col("y"))(df).orderBy("id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.lstsq(np.column_stack((z, np.ones(150))), np.log(p / (1 - p)), rcond=None)[0]
    assert np.allclose(z.T @ (p - y) + w[:2], 0, atol=1e-3) and abs((p - y).sum()) < 1e-3


def test_splits_are_disjoint_and_whole(spark):
    rows = models.split_keys(spark.range(23).withColumnRenamed("id", "stim"), "stim", 3, 0.8, 0.1).collect()
    for k in range(3):
        assert sorted(r.stim for r in rows if r.split == k) == list(range(23))
        assert [sum(r.role == x for r in rows if r.split == k) for x in ("train", "val", "test")] == [18, 2, 3]


def test_folds_are_even(spark):
    folds = [r.fold for r in models.fold_of(spark.range(20).withColumnRenamed("id", "stim"), "stim", 5).collect()]
    assert sorted(folds) == sorted([0, 1, 2, 3, 4] * 4)


def test_ranks_of_a_large_group(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 7 % 1000).alias("x")).repartition(5)
    assert all(r["rank"] == r.x for r in rank.ranked(df, ["g"], [F.col("x")]).collect())


def test_gaussianize(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, 1, 2, 5, 4])], "d string, i int, v double")
    out = [r.gauss for r in vectors.gaussianize(df, ["d"], "v", "i").orderBy("v").collect()]
    assert np.allclose(out, np.negative(out[::-1])) and np.isclose(np.std(out), 1)


def test_tone():
    t = np.arange(16_000) / 16_000
    tone = 0.5 * np.sin(2 * np.pi * 440 * t)
    f = signal.frames(tone, 400, 320)
    assert np.allclose(signal.rms(f), 0.5 / np.sqrt(2), atol=0.01)
    assert np.allclose(signal.pitch(f, 16_000), 440, atol=10)
    assert np.allclose(signal.zero_crossings(f), 2 * 440 / 16_000, atol=0.005)
    assert signal.log_mel(tone).shape == (49, 23) and signal.log_mel(tone[:100]).shape == (0, 23)
    assert signal.mfcc(tone).shape == (20, 32)
    assert not signal.pitch(np.zeros((3, 400)), 16_000).any()
    assert np.allclose(np.abs(np.fft.rfft(signal.resample(tone, 16_000, 8_000))).argmax(), 440, atol=1)


def test_levinson():
    x = np.zeros(5000)
    noise = np.random.default_rng(0).normal(size=5000)
    for i in range(2, 5000):
        x[i] = 1.2 * x[i - 1] - 0.5 * x[i - 2] + noise[i]
    a, _ = signal.levinson(np.array([x[: 5000 - k] @ x[k:] for k in range(3)]), 2)
    assert np.allclose(a, [-1.2, 0.5], atol=0.05)


def test_sums_of_products_of_many_dimensions(spark):
    """Matrices move in pieces; equal to numpy for every fold, and by group."""
    g = np.random.default_rng(21)
    n, d = 600, 150
    x, y = g.normal(size=(n, d)), g.normal(size=(n, 2))
    rows = [(i, a.tolist(), b.tolist(), i % 3, i % 2, None if i % 4 == 0 else f"g{i % 4}") for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>, f int, h int, k string").repartition(5)
    got = models.gram(df, "x", "y", ["f", "h"])
    m = np.column_stack((x, y, np.ones(n)))
    assert got.keys() == {0, 1, 2, models.FOLDS, models.FOLDS + 1}
    for k, (count, s) in got.items():
        own = m[np.arange(n) % (3 if k < models.FOLDS else 2) == k % models.FOLDS]
        assert count == len(own) and np.allclose(s, own.T @ own)
    fits = {r.k: np.array(r.weights) for r in models.solved_by(df, "k", "x", "y", d, 2, alpha=1.0).collect()}
    assert fits.keys() == {None, "g1", "g2", "g3"}
    for k, w in fits.items():
        at = np.array([r[5] == k for r in rows])
        z = (x[at] - x[at].mean(0)) / x[at].std(0)
        want = np.linalg.solve(z.T @ z + np.eye(d), z.T @ (y[at] - y[at].mean(0))) / x[at].std(0)[:, None]
        assert np.allclose(w, want)
    assert models.solved_by(df.where("id < 0"), "k", "x", "y", d, 2).count() == 0
