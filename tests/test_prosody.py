"""Descriptor sets by blocks against plain loops over whole waveforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.functions import signal, voice
from stimframe.operators import functionals, prosody, scans

RATE = 16_000


def speech(seconds, seed):
    """Tones with gliding pitch, pauses and noise, as 32-bit floats."""
    g = np.random.default_rng(seed)
    t = np.arange(int(RATE * seconds)) / RATE
    f0 = 150 + 40 * np.sin(2 * np.pi * 0.9 * t + seed)
    phase = 2 * np.pi * np.cumsum(f0) / RATE
    wave = sum(np.sin(k * phase) / k for k in range(1, 12)) * (0.6 + 0.4 * np.sin(2 * np.pi * 1.3 * t))
    wave[(t * 2).astype(int) % 3 == 2] = 0.0
    return (0.1 * wave + 0.002 * g.normal(size=len(t))).astype(np.float32)


@pytest.fixture(scope="module")
def waves():
    return {"a": speech(2.3, 1), "b": speech(1.0, 2), "short": speech(0.03, 3), "tiny": speech(0.01, 4)}


@pytest.fixture(scope="module")
def series(spark, waves):
    rows = [(s, i, float(x)) for s, w in waves.items() for i, x in enumerate(w)]
    return spark.createDataFrame(rows, "stim string, i long, value double").repartition(5).cache()


def by_stim(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.stim, r.frame)):
        got.setdefault(r.stim, []).append(r.features)
    return {s: np.array(m) for s, m in got.items()}


def plain_pitch(wave, kind):
    """A plain dynamic program over all frames."""
    c, n = prosody.SETS[kind], prosody.CANDIDATES
    f = signal.frames(wave.astype(float), prosody.LENGTH, prosody.SHIFT)
    f0, v = voice.pitch_candidates(f, RATE, n, c.low, c.high)
    local, step = voice.pitch_costs(f0, v)
    cost, back = local[0], []
    for t in range(1, len(f)):
        ways = cost[:, None] + step[t]
        back.append(ways.argmin(0))
        cost = ways.min(0) + local[t]
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path = np.array(path[::-1])
    there = (path < n) & (signal.rms(f) > prosody.SILENT)
    return f, np.where(there, f0[np.arange(len(f)), np.minimum(path, n - 1)], 0.0), np.where(path < n, v[np.arange(len(f)), np.minimum(path, n - 1)], v.max(1))


def smooth(x, nonzero):
    out = np.empty_like(x)
    for t in range(len(x)):
        near = x[max(0, t - 1) : t + 2]
        for k in range(x.shape[1]):
            v = near[:, k][near[:, k] != 0] if k in nonzero else near[:, k]
            out[t, k] = 0.0 if k in nonzero and x[t, k] == 0 else v.mean()
    return out


@pytest.mark.parametrize("block", [16, 2048])
def test_egemaps_equals_a_loop_over_whole_waveforms(spark, waves, series, block):
    got = by_stim(prosody.egemaps(series, block=block))
    assert got.keys() == {"a", "b", "short"} and len(prosody.EGEMAPS) == 25
    for s in got:
        f, f0, voicing = plain_pitch(waves[s], "egemaps")
        assert (f0 > 0).any()
        m = np.column_stack((f0, voicing, prosody._egemaps_before(f)))
        want = prosody._egemaps_after(waves[s].astype(float), f, np.arange(len(f)) * prosody.SHIFT, m, 0.1)[:, :-1]
        assert got[s].shape == want.shape and np.allclose(got[s], smooth(want, range(10, 25)), rtol=1e-6, atol=1e-6)


def test_pitch_follows_the_glide(waves, series):
    got = by_stim(prosody.egemaps(series))["a"]
    hz = 27.5 * 2 ** (got[:, 10] / 12)
    t = np.arange(len(got)) * 0.02 + 0.0125
    true = 150 + 40 * np.sin(2 * np.pi * 0.9 * t + 1)
    sounding = (np.minimum(t * 2 % 3, (t + 0.0125) * 2 % 3) > 0.1) & ((t * 2 % 3) < 1.8)
    assert (got[sounding, 10] > 0).mean() > 0.95
    assert np.median(np.abs(hz[sounding & (got[:, 10] > 0)] / true[sounding & (got[:, 10] > 0)] - 1)) < 0.02
    assert (got[((t * 2 % 3) > 2.1) & ((t * 2 % 3) < 2.9), 10] == 0).mean() > 0.7


@pytest.mark.parametrize("block", [16, 2048])
def test_compare_equals_a_loop_over_whole_waveforms(spark, waves, series, block):
    got = by_stim(prosody.compare(series, block=block, delta=True))
    assert len(prosody.COMPARE) == 65
    weight = voice.mel_power(np.zeros((1, 400)), RATE)[1]
    for s in got:
        f, f0, voicing = plain_pitch(waves[s], "compare")
        want = prosody._compare_after(waves[s].astype(float), f, np.arange(len(f)) * prosody.SHIFT, np.column_stack((f0, voicing, prosody._compare_before(f))), 0.25)
        logs, y, filtered = want[:, 4:30].copy(), np.zeros(26), []
        for t in range(len(logs)):
            y = 0.98 * y + sum(b * logs[max(0, t - k)] for k, b in enumerate((0.2, 0.1, 0.0, -0.1, -0.2)))
            filtered.append(y)
        want[:, 4:30] = (np.exp(np.array(filtered)) * weight) ** 0.33
        want[:, 1] = want[:, 4:30].sum(1)
        want = smooth(want, (59, 61, 62, 63, 64))
        assert got[s].shape == (len(want), 130) and np.allclose(got[s][:, :65], want, rtol=1e-6, atol=1e-6)
        x = np.pad(want, ((2, 2), (0, 0)), "edge")
        assert np.allclose(got[s][:, 65:], ((x[3:-1] - x[1:-3]) + 2 * (x[4:] - x[:-4])) / 10, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("block", [16, 2048])
def test_functionals_equal_those_of_whole_contours(spark, series, block):
    got = {r.stim: r.features for r in prosody.egemaps_functionals(series, block=block).collect()}
    contours = {}
    for r in sorted(scans.unpack(prosody._smooth_egemaps(series, 1, 2048), ["stim"], prosody._ALL).collect(), key=lambda r: (r.stim, r.frame)):
        contours.setdefault(r.stim, []).append(r.features)
    turned = lambda v: functionals.turning_points(spark.createDataFrame([("x", i, float(a)) for i, a in enumerate(v)], "k string, i int, v double"), ["k"], ["i"], "v").collect()
    assert len(prosody.EGEMAPS_FUNCTIONALS) == 88 and got.keys() == contours.keys()
    for s, rows in contours.items():
        x, named = np.array(rows), dict(zip(prosody.EGEMAPS_FUNCTIONALS, got[s]))
        assert len(got[s]) == 88
        f0, loud = x[:, 10], x[:, 0]
        for v, name in ((f0[f0 > 0], "F0semitoneFrom27.5Hz_sma3nz"), (loud, "loudness_sma3")):
            assert np.isclose(named[f"{name}_amean"], v.mean()) and np.isclose(named[f"{name}_stddevNorm"], v.std() / abs(v.mean()))
            q = np.quantile(v, (0.2, 0.5, 0.8))
            assert np.allclose([named[f"{name}_percentile{p}"] for p in ("20.0", "50.0", "80.0")], q) and np.isclose(named[f"{name}_pctlrange0-2"], q[2] - q[0])
            t = turned(v)
            if t:
                assert np.isclose(named[f"{name}_meanRisingSlope"] * 0.02, t[0].mean_rise or 0.0) and np.isclose(named[f"{name}_meanFallingSlope"] * 0.02, t[0].mean_fall or 0.0)
        assert np.isclose(named["loudnessPeaksPerSec"], (turned(loud)[0].n_maxima if turned(loud) else 0) / (len(x) * 0.02))
        runs, flags = [], (f0 > 0).tolist()
        for k, on in enumerate(flags):
            if k and on == flags[k - 1]:
                runs[-1][1] += 1
            else:
                runs.append([on, 1])
        for on, a, b in ((True, "MeanVoicedSegmentLengthSec", "StddevVoicedSegmentLengthSec"), (False, "MeanUnvoicedSegmentLength", "StddevUnvoicedSegmentLength")):
            n = np.array([n for flag, n in runs if flag == on]) * 0.02
            assert np.allclose([named[a], named[b]], [n.mean(), n.std()] if len(n) else [0, 0])
        assert np.isclose(named["VoicedSegmentsPerSec"], sum(f for f, _ in runs) / (len(x) * 0.02))
        jitter = x[:, 11][x[:, 11] != 0]
        assert np.isclose(named["jitterLocal_sma3nz_amean"], jitter.mean() if len(jitter) else 0.0)
        alpha = x[f0 > 0, 1]
        assert named["equivalentSoundLevel_dBp"] < 0 and (not len(alpha) or named["alphaRatioV_sma3nz_amean"] != 0)
    assert prosody.egemaps_functionals(series.where("i < 0")).count() == 0


def test_values_held_for_many_samples(spark):
    g = np.random.default_rng(9)
    values = g.normal(size=40).astype(np.float32)
    held = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(values)], "stim string, i long, value double")
    plain = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(np.repeat(values, 160))], "stim string, i long, value double")
    a, b = by_stim(prosody.egemaps(held, 160, block=8)), by_stim(prosody.egemaps(plain, block=32))
    assert np.allclose(a["a"], b["a"])


def test_null_samples_and_stimuli(spark):
    df = spark.range(2000).select(F.lit(None).cast("string").alias("stim"), F.col("id").alias("i"), F.when(F.col("id") % 3 > 0, F.sin(F.col("id") / 20)).alias("value"))
    assert {r.stim for r in prosody.egemaps_functionals(df).collect()} == {None}
