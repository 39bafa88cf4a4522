"""Many short stimuli: what is done where a stimulus is must equal what is chained through blocks, and move and write no contours."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stimframe.operators import prosody, scans, summaries
from stimframe.session import shared_dir

HOLD = 160
#: Counts what Arrow takes; must outlive what is made in it.
POOL = pa.proxy_memory_pool(pa.default_memory_pool())


@pytest.fixture(scope="module")
def short(spark):
    """41 stimuli of about 33 frames, one null, one constant, one without a frame."""
    e = spark.range(40 * 66).select((F.col("id") % 40).cast("string").alias("stim"), F.floor(F.col("id") / 40).alias("i"), (F.rand(4) * 100).alias("value"))
    null = spark.range(70).select(F.lit(None).cast("string").alias("stim"), F.col("id").alias("i"), F.when(F.col("id") % 5 > 0, 50 * F.rand(5)).alias("value"))
    flat = spark.range(50).select(F.lit("flat").alias("stim"), F.col("id").alias("i"), F.lit(3.0).alias("value"))
    tiny = spark.range(2).select(F.lit("tiny").alias("stim"), F.col("id").alias("i"), F.lit(3.0).alias("value"))
    return e.unionByName(null).unionByName(flat).unionByName(tiny).cache()


def scratch_bytes(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stimframe")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def local(spark, df_of):
    """The rows of a job, after checking that it neither groups in Python nor writes much."""
    before = scratch_bytes(spark)
    df = df_of()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("FlatMapGroups|SortMergeJoin|BroadcastHashJoin", plan)
    rows = df.collect()
    assert scratch_bytes(spark) - before < 200_000  # contours alone take 41 * 33 frames of 46 or 130 doubles
    return rows


def same(a, b):
    a, b = ({r[0]: np.array(r.features) for r in rows} for rows in (a, b))
    assert a.keys() == b.keys() and len(a) == 42
    for s in a:
        assert np.allclose(a[s], b[s], rtol=1e-6, atol=1e-6), s


def test_egemaps_functionals_of_short_stimuli(spark, short):
    got = local(spark, lambda: prosody.egemaps_functionals(short, HOLD))
    same(got, prosody.egemaps_functionals(short, HOLD, block=16).collect())


@pytest.mark.parametrize("block", [7, 16, 33])
def test_blocks_of_any_size_give_the_same_contours(spark, short, block):
    few = short.where("stim in ('1', '2', 'flat', 'tiny') or stim is null")
    key = lambda r: (r.stim or "", r.frame)
    for run in (lambda b: prosody.egemaps(few, HOLD, b), lambda b: prosody.compare(few, HOLD, b, True), lambda b: prosody.pitch(few, "compare", HOLD, b)):
        a, b = (sorted(run(n).collect(), key=key) for n in (scans.BLOCK, block))
        assert [key(r) for r in a] == [key(r) for r in b] and np.allclose([r.features for r in a], [r.features for r in b], rtol=1e-6, atol=1e-6)
    with pytest.raises(ValueError):
        prosody.egemaps(few, HOLD, 6)


def test_compare_of_short_stimuli(spark, short):
    rows = local(spark, lambda: prosody.compare(short, HOLD, delta=True))
    assert {r.stim for r in rows} == {*map(str, range(40)), "flat", None} and len(rows[0].features) == 130


def test_compare_functionals_of_short_stimuli(spark, short):
    got = local(spark, lambda: prosody.compare_functionals(short, HOLD))
    assert len(got) == 42 and all(len(r.features) == 6373 and np.isfinite(r.features).all() for r in got)
    few = [r for r in got if r.stim in ("3", None)]
    for r in prosody.compare_functionals(short.where("stim = '3' or stim is null"), HOLD, block=16).collect():
        (own,) = [np.array(x.features) for x in few if x.stim == r.stim]
        # Gains and coefficients of nearly perfect predictions, and shares of a mean near 0, have few digits.
        assert np.isclose(own, r.features, rtol=1e-5, atol=1e-6).mean() > 0.999


def test_figures_of_many_contours_are_those_of_each(spark):
    g = np.random.default_rng(7)
    for n in (1, 2, 3, 7, 40):
        x = np.round(g.normal(size=(n, 6)) * [1, 1, 1, 0, 1, 1], 1)
        x[:, 4:] *= g.random((n, 2)) < [0.5, 0.1]
        got = summaries.whole(x, 0.02, (4, 5), (4,))
        assert got.shape == (7, len(summaries.FIGURES))
        for k, v in enumerate((*x[:, :4].T, x[x[:, 4] != 0, 4], x[x[:, 5] != 0, 5])):
            if not len(v):
                assert not got[k].any()
                continue
            one = summaries.figures(summaries.block_state(v, v.mean(), v.min(), v.max())[None], v.mean(), v.min(), v.max(), 0.02)
            assert np.allclose(got[k, : len(one)], one, rtol=1e-9, atol=1e-9)
            named = dict(zip(summaries.FIGURES, got[k]))
            assert np.allclose([named[f] for f in ("percentile1.0", "quartile1", "quartile2", "quartile3", "percentile99.0")], np.quantile(v, summaries.POINTS))
        assert np.isclose(got[6, 0], (x[:, 4] != 0).mean()) and not got[6, -9:].any()


def test_rows_of_frames_dont_repeat_the_matrix():
    x = np.random.default_rng(1).normal(size=(2048, 130))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([x.tobytes()], pa.binary())], names=["stim", "m"])
    usual = pa.default_memory_pool()
    pa.set_memory_pool(POOL)
    try:
        got = scans.frame_rows(batch, ["stim"], [0], [4096], [x[:500]])
    finally:
        pa.set_memory_pool(usual)
    assert got.num_rows == 500 and got.column("frame")[0].as_py() == 4096 and got.column("features")[499].as_py() == x[499].tolist()
    assert POOL.max_memory() < 20_000_000
