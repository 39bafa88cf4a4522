"""Descriptors of voice, functionals over runs and turns, and joins that check, against plain numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.functions import signal
from stimframe.operators import align, functionals, identity, models, rank
from stimframe.operators.extract import VOICE, extract, extract_series, select_outputs
from stimframe.sources import files

RATE = 16_000


def tone(hz, seconds=0.5, harmonics=8):
    t = np.arange(int(RATE * seconds)) / RATE
    return sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, harmonics + 1)) * 0.1


@pytest.mark.parametrize("hz", [82.0, 140.0, 220.0, 391.0])
def test_pitch_by_subharmonics(hz):
    f0 = signal.pitch_shs(signal.frames(tone(hz), 800, 320), RATE)
    assert np.allclose(f0, hz, rtol=0.02)
    assert not signal.pitch_shs(np.zeros((3, 400)), RATE).any()


def test_band_levels_against_sums_over_lines():
    f = signal.frames(np.random.default_rng(1).normal(size=4000), 400, 320)
    got = signal.band_levels(f, RATE)
    for k, x in enumerate(f):
        power, hz = np.abs(np.fft.rfft(x * signal.window("hamming", 400), 512)) ** 2, np.fft.rfftfreq(512, 1 / RATE)
        total = lambda a, b: sum(p for p, h in zip(power, hz) if a <= h < b)
        top = lambda a, b: max(p for p, h in zip(power, hz) if a <= h < b)
        assert np.isclose(got["alpha"][k], 10 * np.log10(total(50, 1000) / total(1000, 5000)))
        assert np.isclose(got["hammarberg"][k], 10 * np.log10(top(0, 2000) / top(2000, 5000)))
        assert np.isclose(got["band_250_650"][k], total(250, 650)) and np.isclose(got["band_1000_4000"][k], total(1000, 4000))
        at = (hz >= 500) & (hz < 1500)
        assert np.isclose(got["slope_500_1500"][k], np.polyfit(hz[at], 10 * np.log10(power[at]), 1)[0])


def test_octave_spectrum_of_a_line():
    hz = np.fft.rfftfreq(2048, 1 / RATE)
    got, at = signal.octave_spectrum(hz[None] * 2.0, hz, 100.0, 12, 60)
    assert np.allclose(got[0], 2 * at) and np.isclose(at[12], 200)


def test_voice_by_blocks_and_outputs(spark):
    values = {"a": tone(120.0, 0.4), "b": tone(200.0, 0.1)}
    waves = spark.createDataFrame([(s, RATE, v.astype(np.float32).tolist()) for s, v in values.items()], "stim string, sample_rate int, waveform array<float>")
    series = spark.createDataFrame([(s, i, float(np.float32(x))) for s, v in values.items() for i, x in enumerate(v)], "stim string, i long, value double")
    want = {(r.stim, r.frame): r.features for r in extract(waves, "voice").collect()}
    got = {(r.stim, r.frame): r.features for r in extract_series(series, "voice", 1, block=7).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    two = select_outputs(extract(waves, "voice"), VOICE, ("alpha", "f0")).collect()
    assert all(np.allclose(r.features, [want[r.stim, r.frame][4], want[r.stim, r.frame][0]]) for r in two)


def test_temporal_rates(spark):
    f0 = [0, 0, 100, 110, 120, 0, 0, 0, 90, 0]
    loud = [1, 3, 2, 1, 5, 1, 1, 4, 2, 2]
    df = spark.createDataFrame([("a", i, float(p), float(v)) for i, (p, v) in enumerate(zip(f0, loud))], "stim string, frame int, f0 double, loud double")
    r = functionals.temporal_rates(df, ["stim"], ["frame"], "loud", "f0", 0.1).first()
    above = sum(1 for i in (1, 4, 7) if loud[i] > np.mean(loud))
    assert np.isclose(r.peaks_per_second, above / 1.0) and np.isclose(r.voiced_per_second, 2.0)
    assert np.isclose(r.mean_voiced, 0.2) and np.isclose(r.sd_voiced, 0.1) and np.isclose(r.mean_unvoiced, 0.2)


def test_quantiles(spark):
    g = np.random.default_rng(3)
    groups = {"a": g.normal(size=1001), "b": g.integers(0, 4, 50).astype(float), None: g.normal(size=3), "one": np.array([2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.q for r in rank.quantiles(df, ["k"], "v", (0.01, 0.5, 0.75, 1.0)).collect()}
    assert got.pop("none") is None
    assert got.keys() == groups.keys() and all(np.allclose(got[k], np.quantile(v, (0.01, 0.5, 0.75, 1.0))) for k, v in groups.items())


def test_ranks_with_ties_and_null_groups(spark):
    df = spark.createDataFrame([(k, i % 7, i) for i in range(500) for k in ("a", None)], "k string, v int, i int").repartition(6)
    for _, own in df.join(rank.ranked(df, ["k"], [F.col("v"), F.col("i")]).select("i", F.col("k").alias("k2"), "rank"), "i").where("k <=> k2").toPandas().groupby("k", dropna=False):
        assert own.sort_values(["v", "i"])["rank"].tolist() == list(range(500))


def test_times_join_stops_where_times_differ(spark):
    x = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 0.5, 2.0)], "stim string, frame int, t double, x double")
    y = spark.createDataFrame([("a", 0, 0.0, 5.0), ("a", 1, 0.5, 6.0)], "stim string, frame int, t double, y double")
    assert sorted(map(tuple, align.times_join(x, y, times=("t",)).select("stim", "frame", "t", "x", "y").collect())) == [("a", 0, 0.0, 1.0, 5.0), ("a", 1, 0.5, 2.0, 6.0)]
    for other in (y.where("frame = 0"), y.withColumn("t", F.col("t") + 0.1)):
        with pytest.raises(Exception, match="stimulus a"):
            align.times_join(x, other, times=("t",)).count()
    lengths = spark.createDataFrame([("a", 5), ("b", 9)], "stim string, n int")
    assert align.too_short(lengths, "n", 8).count() == 1 and align.require_length(lengths, "n", 5).count() == 2
    with pytest.raises(Exception, match="stimulus a"):
        align.require_length(lengths, "n", 8).count()


def test_repeated_folds_and_ridge(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(240, 3))
    y = x @ np.array([[1.0], [0.0], [-2.0]]) + 0.5 * g.normal(size=(240, 1))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y array<double>")
    folds = models.repeated_folds(df, "id", 5, 3)
    at = {r.id: (r.fold0, r.fold1, r.fold2) for r in folds.collect()}
    fit = models.ridge_cv(df.join(folds, "id"), "x", "y", 3, ["fold0", "fold1", "fold2"])
    scores = []
    for alpha in np.logspace(-5, 2, 10):
        r2 = []
        for r in range(3):
            for k in range(5):
                test = np.array([at[i][r] == k for i in range(240)])
                m, s = x[~test].mean(0), x[~test].std(0)
                z, t = (x - m) / s, y - y[~test].mean(0)
                w = np.linalg.solve(z[~test].T @ z[~test] + alpha * np.eye(3), z[~test].T @ t[~test])
                r2.append(1 - ((y[test] - z[test] @ w - y[~test].mean(0)) ** 2).sum() / ((y[test] - y[test].mean(0)) ** 2).sum())
        scores.append(np.mean(r2))
    assert np.allclose(fit["scores"], scores) and np.isclose(fit["alpha"], np.logspace(-5, 2, 10)[np.argmax(scores)])
    assert len({tuple(at[i][r] for i in range(240)) for r in range(3)}) == 3


def test_models_by_group(spark):
    g = np.random.default_rng(5)
    rows, want = [], {}
    for k in "abc":
        x, y = g.normal(size=(40, 2)) + 3, g.normal(size=(40, 1))
        rows += [(k, a.tolist(), b.tolist()) for a, b in zip(x, y)]
        c, d = x - x.mean(0), y - y.mean(0)
        want[k] = np.linalg.lstsq(x, y, rcond=None)[0], np.linalg.solve(c.T @ c + 2 * np.eye(2), c.T @ d)
    df = spark.createDataFrame(rows, "k string, x array<double>, y array<double>")
    for i, fit in enumerate((models.solved_by(df, "k", "x", "y", 2), models.solved_by(df, "k", "x", "y", 2, alpha=2.0, scale=False))):
        assert {r.k for r in fit.collect()} == set(want) and all(np.allclose(r.weights, want[r.k][i]) for r in fit.collect())


def test_noise_tokens_and_attributes(spark):
    df = spark.createDataFrame([(w,) for w in ("SP", "{IG}", "SP\x7f", "AH0V", "", "UH", "MM", "THE")], "token string")
    assert {r.token for r in identity.drop_noise(df, "token").collect()} == {"UH", "MM", "THE"}
    hot = spark.createDataFrame([(["voiced", "low"],)], "a array<string>").select(identity.multi_hot(F.col("a")).alias("h")).first().h
    assert len(hot) == 22 and [identity.ARTICULATIONS[k] for k, v in enumerate(hot) if v] == ["voiced", "low"]


def test_results_and_identities(spark, tmp_path):
    (tmp_path / "ridge" / "word").mkdir(parents=True)
    (tmp_path / "ridge" / "word" / "m.json").write_text(json.dumps({"r2": 0.5, "f1": [0.25, float("nan")]}))
    got = {(r.model, r.target, r.metric, r.dim): r.value for r in files.read_results(spark, str(tmp_path), {"model": -3, "target": -2}).collect()}
    assert got["ridge", "word", "r2", None] == 0.5 and got["ridge", "word", "f1", 0] == 0.25 and np.isnan(got["ridge", "word", "f1", 1])
    df = spark.createDataFrame([("a", 0, "T", [1.0], 0.0, 0.5)], "stim string, seq int, tokens string, targets array<double>, t_start double, t_end double")
    files.write_identities(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "times")).first().t_end == 0.5


def test_audio_that_cannot_be_read_says_why(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"no sound")
    r = files.read_audio(files.select_stimuli(spark, str(tmp_path)), keep_failed=True).first()
    assert r.waveform is None and r.error
    assert extract(files.read_audio(files.select_stimuli(spark, str(tmp_path))), "fbank").count() == 0
