"""Values of operators that SQL doesn't express, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.functions import signal
from stimframe.operators import align, extract, models, stats, vectors
from stimframe.plans.catalogue import QUERIES, table
from stimframe.sources import files

DIR = "/root/testdata/sf0.001"


def p_of_t(t, df, n=200_001):
    """Two-sided p by Simpson's rule over the density."""
    x = np.linspace(0, abs(t), n)
    y = (1 + x * x / df) ** (-(df + 1) / 2) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 1 - 2 * (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_pairwise_p(spark):
    g = np.random.default_rng(51)
    groups = {"a": g.normal(size=12), "b": g.normal(0.5, 1, 15), "c": g.normal(2, 1, 9)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k string, v double")
    n = sum(map(len, groups.values()))
    s2 = sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / (n - 3)
    for r in stats.pairwise_p(df, "k", "v").collect():
        a, b = groups[r.group1], groups[r.group2]
        t = (a.mean() - b.mean()) / math.sqrt(s2 * (1 / len(a) + 1 / len(b)))
        assert np.isclose(r.t, t) and np.isclose(r.p, p_of_t(t, n - 3), atol=1e-9) and np.isclose(r.p_adj, min(1, 3 * r.p))
        assert r.signif == next((s for limit, s in ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*")) if r.p_adj <= limit), "ns")


def test_labels_left_out_are_nan(spark):
    got = stats.fill_labels(spark.createDataFrame([(0, 0.5)], "dim int, f1 double"), spark.range(3).selectExpr("cast(id as int) as dim"), "dim", ["f1"]).orderBy("dim").collect()
    assert got[0].f1 == 0.5 and all(np.isnan(r.f1) for r in got[1:])


def test_diverse_top(spark):
    g = np.random.default_rng(52)
    v = g.normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    query, left, want = g.normal(size=4), set(range(60)), []
    while left and len(want) < 4:
        best = max(left, key=lambda i: (v[i] @ query, -i))
        want.append(best)
        left -= set(sorted(left, key=lambda i: (((v[i] - v[best]) ** 2).sum(), i))[:8])
    assert [r.id for r in vectors.diverse_top(df, "id", "v", query.tolist(), 4, 7).orderBy("place").collect()] == want


def test_svd(spark):
    g = np.random.default_rng(53)
    x = g.normal(size=(80, 5)) + 1
    values, v = models.svd_reduce(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), "x", 5, 3)
    _, s, w = np.linalg.svd(x)
    assert np.allclose(values, s[:3]) and np.allclose(np.abs(v.T @ w[:3].T), np.eye(3), atol=1e-8)


def test_bag_of_all_words_has_the_means(spark):
    rows = table(spark, DIR, "embeddings").orderBy("vec_id").collect()
    first = {}
    for r in rows:
        first.setdefault(r.label, np.array(r.embedding, float))
    texts = {}
    for r in table(spark, DIR, "events").collect():
        if r.event_id % 12 in first:
            texts.setdefault(r.user_id, []).append(first[r.event_id % 12])
    got = QUERIES["bag_of_words_all"](spark, DIR).collect()
    assert len(got) == 64 * len(texts) and all(abs(r["mean"] - np.mean([v[r.dim] for v in texts[r.user_id]])) < 2e-6 for r in got)


def test_folds_and_splits_have_even_sizes(spark):
    keys = {r.user_id for r in table(spark, DIR, "events").select("user_id").distinct().collect()}
    folds = QUERIES["fold_assign"](spark, DIR).collect()
    assert {r.user_id for r in folds} == keys and len(folds) == len(keys)
    sizes = np.bincount([r.fold for r in folds])
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    splits = QUERIES["split_stimuli"](spark, DIR).collect()
    for k in range(3):
        own = [r for r in splits if r.split == k]
        assert {r.user_id for r in own} == keys and len(own) == len(keys)
        n = len(keys)
        assert [sum(r.role == x for r in own) for x in ("train", "val")] == [int(n * 0.8), int(n * 0.1)]


def test_a_frame_of_fbank_and_of_mfcc():
    """Each figure from the definitions, a sum at a time."""
    g = np.random.default_rng(54)
    wave = g.normal(size=4096)
    frame = wave[320:720] - wave[320:720].mean()
    x = [(frame[0] * 0.03 if n == 0 else frame[n] - 0.97 * frame[n - 1]) * (0.5 - 0.5 * math.cos(2 * math.pi * n / 399)) ** 0.85 for n in range(400)]
    power = [abs(sum(x[n] * complex(math.cos(2 * math.pi * k * n / 512), -math.sin(2 * math.pi * k * n / 512)) for n in range(400))) ** 2 for k in range(257)]
    mel = lambda f: 1127 * math.log(1 + f / 700)
    low, step = mel(20), (mel(8000) - mel(20)) / 24
    for band in (0, 7, 22):
        want = sum(p * max(0.0, min((mel(k * 31.25) - low - band * step) / step, (low + (band + 2) * step - mel(k * 31.25)) / step)) for k, p in enumerate(power))
        assert np.isclose(signal.log_mel(wave)[1, band], math.log(want))
    db = signal.mel_db(np.pad(wave, 1024))
    kept = np.maximum(db, db.max() - 80)[2]
    for c in (0, 1, 5):
        want = sum(v * math.cos(math.pi * c * (k + 0.5) / 128) for k, v in enumerate(kept)) * math.sqrt((1 if c == 0 else 2) / 128)
        assert np.isclose(signal.mfcc(wave)[c, 2], want)


def test_copied_times_and_layers(spark):
    times = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("b", 2.0)], "stim string, t double")
    assert sorted(r.t for r in files.copy_times(times, spark.createDataFrame([("b",), ("b",), ("z",)], "stim string")).collect()) == [1.0, 2.0]


def test_windows_with_a_stride(spark):
    assert align.with_stride(1600, 6400, None) == (1600, 6400) and align.with_stride(1600, 6400, 400) == (400, 7600)
    waves = spark.createDataFrame([("a", 16_000, [float(i) for i in range(10_000)])], "stim string, sample_rate int, waveform array<float>")
    got = extract.snippet_waves(waves, 1600, 6400, stride=400).orderBy("s_start").collect()
    assert [(r.s_start, r.s_end) for r in got] == [(e - 8000, e) for e in range(8000, 10_001, 400)] and all(len(r.waveform) == 8000 for r in got)


def test_stimuli_that_are_too_short_give_no_frames(spark):
    df = spark.createDataFrame([(s, i) for s, n in (("a", 20), ("b", 8), ("c", 9), (None, 30)) for i in range(n)], "stim string, frame int")
    got = {}
    for r in align.select_frames(df, "stim", ["frame"], 3, 5, whole=True).collect():
        got.setdefault(r.stim, []).append(r.frame)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [9, 14, 19], "c": [3, 8], None: [19, 24, 29]}
    lengths = spark.createDataFrame([("a", 5), ("b", 9), ("c", None)], "stim string, n int")
    assert [r.stim for r in align.long_enough(lengths, "n", 8).collect()] == ["b"]


def test_multilabel_of_separable_classes(spark):
    g = np.random.default_rng(55)
    x = g.normal(size=(120, 2))
    df = spark.createDataFrame([(i, r.tolist(), int(r[0] > 0), int(r[1] > 0.3), 0) for i, r in enumerate(x)], "id int, x array<double>, p int, q int, never int")
    kept, add = models.multilabel(df, "x", ["p", "q", "never"])
    rows = add(df).collect()
    assert kept == ["p", "q"] and np.mean([r.pred_p == r.p for r in rows]) > 0.95 and np.mean([r.pred_q == r.q for r in rows]) > 0.95
