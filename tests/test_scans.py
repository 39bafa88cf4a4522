"""Scans by block against loops over all frames, and kernels of voice quality against synthetic signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.functions import signal, voice
from stimframe.operators import scans

RATE = 16_000


def series(spark, values, columns="stim string, frame long, v array<double>"):
    rows = [(s, i, r.tolist()) for s, m in values.items() for i, r in enumerate(m)]
    return spark.createDataFrame(rows, columns).repartition(3)


def back(packed, width, block):
    got = {}
    for r in sorted(scans.unpack(packed, ["stim"], width, block=block).collect(), key=lambda r: (str(r.stim), r.frame)):
        got.setdefault(r.stim, []).append(r.features)
    return {s: np.array(m) for s, m in got.items()}


@pytest.mark.parametrize("block", [1, 3, 8, 64])
def test_recurrence_equals_a_loop(spark, block):
    g = np.random.default_rng(1)
    values = {s: g.normal(size=(n, 2)) for s, n in (("a", 37), ("b", 1), ("c", 8), (None, 16))}
    packed = scans.written(scans.pack(series(spark, values), ["stim"], "frame", "v", block, lead=4))
    got = back(scans.rasta(packed, ["stim"], 2, 0.94), 2, block)
    taps = (0.2, 0.1, 0.0, -0.1, -0.2)
    assert got.keys() == values.keys()
    for s, x in values.items():
        y, want = np.zeros(2), []
        for t in range(len(x)):
            y = 0.94 * y + sum(b * x[max(0, t - k)] for k, b in enumerate(taps))
            want.append(y)
        assert np.allclose(got[s], want)


def plain_path(local, step):
    costs, back = local[0], []
    for t in range(1, len(local)):
        ways = costs[:, None] + step[t]
        back.append(ways.argmin(0))
        costs = ways.min(0) + local[t]
    at = int(costs.argmin())
    path = [at]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], costs.min()


@pytest.mark.parametrize("block", [1, 4, 7, 128])
def test_path_of_least_cost_equals_a_loop(spark, block):
    g = np.random.default_rng(2)
    n, values = 3, {}
    for s, size in (("a", 61), ("b", 1), ("c", 14), (None, 28)):
        f0 = np.where(g.random((size, n)) < 0.8, g.uniform(60, 400, (size, n)), 0.0)
        values[s] = np.column_stack((f0, np.where(f0 > 0, g.random((size, n)), 0.0)))
    costs = lambda x: voice.pitch_costs(x[:, :n], x[:, n:])
    packed = scans.written(scans.pack(series(spark, values), ["stim"], "frame", "v", block, lead=1))
    got = back(scans.least_cost_path(packed, ["stim"], 2 * n, n + 1, costs), 1, block)
    assert got.keys() == values.keys()
    for s, x in values.items():
        path, least = plain_path(*costs(x))
        assert got[s][:, 0].astype(int).tolist() == path
        local, step = costs(x)
        p = got[s][:, 0].astype(int)
        assert np.isclose(local[0, p[0]] + sum(local[t, p[t]] + step[t, p[t - 1], p[t]] for t in range(1, len(p))), least)


@pytest.mark.parametrize("block", [1, 4, 50])
def test_smoothing_equals_a_loop(spark, block):
    g = np.random.default_rng(3)
    values = {s: np.where(g.random((n, 2)) < 0.5, g.normal(size=(n, 2)), 0.0) for s, n in (("a", 23), ("b", 1), ("c", 4))}
    packed = scans.pack(series(spark, values), ["stim"], "frame", "v", block, 1, 1)
    got = back(scans.smoothed(packed, ["stim"], 2, (1,)), 2, block)
    for s, x in values.items():
        for t in range(len(x)):
            near = x[max(0, t - 1) : t + 2]
            assert np.isclose(got[s][t, 0], near[:, 0].mean())
            nz = near[:, 1][near[:, 1] != 0]
            assert np.isclose(got[s][t, 1], nz.mean() if x[t, 1] != 0 else 0.0)


def test_scans_of_nothing_and_of_nulls(spark):
    none = series(spark, {"a": np.zeros((1, 2))}).where("frame > 5")
    packed = scans.written(scans.pack(none, ["stim"], "frame", "v", 8, 4))
    assert packed.count() == 0 and scans.rasta(packed, ["stim"], 2).count() == 0
    df = spark.createDataFrame([("a", 0, [1.0, None])], "stim string, frame long, v array<double>")
    assert np.isnan(scans.unpack(scans.pack(df, ["stim"], "frame", "v"), ["stim"], 2).first().features[1])


def pulses(lengths, sizes):
    """Decaying resonances, one for each period, whose lengths are in samples and may be fractions."""
    at = np.cumsum(np.concatenate(([200.0], lengths)))
    wave = np.zeros(int(at[-1]) + 400)
    for p, a in zip(at, sizes):
        k = np.arange(int(np.ceil(p)), len(wave))
        t = (k - p) / RATE
        wave[k] += a * np.exp(-t * 500) * np.sin(2 * np.pi * 700 * t)
    return wave


def test_jitter_and_shimmer_of_known_pulses():
    g = np.random.default_rng(4)
    mean = 120.0
    lengths = mean * (1 + 0.02 * g.uniform(-1, 1, 300))
    sizes = 1 + 0.1 * g.uniform(-1, 1, 301)
    wave = pulses(lengths, sizes)
    found, tops = [], []
    at = 200.0
    for k in range(0, 290, 10):
        t, a = voice.periods(wave, int(at - 20), RATE / mean, RATE, count=10)
        assert np.allclose(t[:9], lengths[k : k + 9], atol=0.5)
        found.append(voice.jitter(t)[0])
        tops.append(voice.shimmer(a)[0])
        at += lengths[k : k + 10].sum()
    want = np.mean([np.abs(np.diff(lengths[k : k + 10])).mean() / lengths[k : k + 10].mean() for k in range(0, 290, 10)])
    loud = np.mean([np.abs(np.diff(sizes[k : k + 10])).mean() / sizes[k : k + 10].mean() for k in range(0, 290, 10)])
    assert abs(np.mean(found) - want) < 0.02 * want + 2e-4 and abs(np.mean(tops) - loud) < 0.05 * loud
    even = pulses(np.full(50, 120.0), np.ones(51))
    t, a = voice.periods(even, 180, RATE / 120, RATE, 10)
    assert voice.jitter(t)[0] < 1e-3 and voice.shimmer(a)[1] < 0.02
    assert voice.jitter(np.array([1.0])) == (0.0, 0.0) == voice.shimmer(np.empty(0))


@pytest.mark.parametrize("ratio", [5.0, 15.0, 25.0])
def test_noise_ratio_of_a_known_mixture(ratio):
    g = np.random.default_rng(5)
    t = np.arange(8000) / RATE
    tone = sum(np.sin(2 * np.pi * 200 * k * t) / k for k in range(1, 6))
    noise = g.normal(size=len(t))
    wave = tone + noise * np.sqrt((tone**2).mean() / (noise**2).mean() / 10 ** (ratio / 10))
    assert abs(np.mean([voice.noise_ratio(wave[s : s + 800], 200.0, RATE) for s in range(0, 7000, 400)]) - ratio) < 1.0


def test_formants_of_synthesised_vowels():
    for poles in (((700, 60), (1220, 80), (2600, 120)), ((300, 50), (2300, 90), (3000, 130))):
        a = np.array([1.0])
        for hz, width in poles:
            r = np.exp(-np.pi * width / RATE)
            a = np.convolve(a, [1, -2 * r * np.cos(2 * np.pi * hz / RATE), r * r])
        x = np.zeros(4000)
        x[::160] = 1.0
        for t in range(len(x)):
            x[t] -= sum(a[k] * x[t - k] for k in range(1, len(a)) if t >= k)
        hz, width = voice.formants(signal.frames(x, 800, 320)[3:], RATE, order=11)
        for want, _ in poles:
            assert np.abs(hz - want).min(1).mean() < 25, (want, hz[:2])


def test_levinson_of_many_rows():
    g = np.random.default_rng(6)
    x = g.normal(size=(5, 300))
    r = np.array([[row[: 300 - k] @ row[k:] for k in range(12)] for row in x])
    assert np.allclose(voice.levinson_rows(r, 11), [signal.levinson(row, 11)[0] for row in r])
    assert not voice.levinson_rows(np.zeros((1, 12)), 11).any()


def test_harmonics_of_known_lines():
    t = np.arange(800) / RATE
    sizes = {k: 1 / k**1.5 for k in range(1, 20)}
    x = sum(a * np.sin(2 * np.pi * 250 * k * t + k) for k, a in sizes.items())
    level = lambda k: 20 * np.log10(sizes[k])
    got = voice.harmonic_levels(x, 250.0, RATE, np.array([500.0, 1500.0, 2500.0]))
    # Within 20 % of the formants the strongest lines are the second, the fifth and the eighth.
    want = [level(1) - level(2), level(1) - level(8), level(2) - level(1), level(5) - level(1), level(8) - level(1)]
    assert np.allclose(got, want, atol=0.5)


@pytest.mark.parametrize("hz", [90.0, 140.0, 233.0, 410.0])
def test_pitch_candidates_hold_the_pitch(hz):
    t = np.arange(8000) / RATE
    x = sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, 9))
    f0, voicing = voice.pitch_candidates(signal.frames(x, 800, 320), RATE)
    assert (np.abs(f0 - hz).min(1) < 0.03 * hz).all() and (voicing[:, 0] > 0.7).all() and (np.diff(voicing, axis=1) <= 1e-9).all()
    f0, voicing = voice.pitch_candidates(np.zeros((2, 400)), RATE)
    assert not f0.any() and not voicing.any() and voice.pitch_candidates(np.zeros((0, 400)), RATE)[0].shape == (0, 6)


def test_mel_cepstrum_harmonicity_and_sharpness():
    g = np.random.default_rng(7)
    f = g.normal(size=(3, 400))
    power, hz = np.abs(np.fft.rfft(f * np.hamming(400), 512)) ** 2, np.fft.rfftfreq(512, 1 / RATE)
    logs = np.log(power @ signal.mel_bank(26, 512, RATE, 20.0, 8000.0).T)
    for i, row in enumerate(logs):
        for k in range(1, 5):
            want = sum(v * np.cos(np.pi * k * (j + 0.5) / 26) for j, v in enumerate(row)) * np.sqrt(2 / 26) * (1 + 11 * np.sin(np.pi * k / 22))
            assert np.isclose(voice.mel_cepstrum(f, RATE)[i, k - 1], want)
    comb = np.tile([1.0, 0.0], (1, 20))
    assert np.isclose(voice.harmonicity(comb)[0], 1.0 / 0.5) and voice.harmonicity(np.ones((1, 9)))[0] == 0
    line = np.zeros((1, 257))
    line[0, 32] = 1.0
    assert np.isclose(voice.sharpness(line, hz)[0], 6 * np.arcsinh(1000 / 600))
