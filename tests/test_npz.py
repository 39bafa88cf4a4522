"""The npz data source: what is written comes back, and a job that fails leaves nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.sources import files
from stimframe.sources.npz import NpzSource


@pytest.fixture
def source(spark):
    spark.dataSource.register(NpzSource)
    return spark


def features(spark, names="abc"):
    g = np.random.default_rng(1)
    m = {s: g.normal(size=(n, 3)) for s, n in zip(names, (5, 1, 40))}
    rows = [(s, i, r.tolist()) for s, x in m.items() for i, r in enumerate(x)]
    return m, spark.createDataFrame(rows, "stim string, frame long, features array<double>").repartition(4)


def test_round_trip(source, tmp_path):
    m, df = features(source)
    assert {(r.stim, r.n_frames) for r in files.write_npz(df, str(tmp_path)).collect()} == {("a", 5), ("b", 1), ("c", 40)}
    assert sorted(os.listdir(tmp_path)) == ["a.npz", "b.npz", "c.npz"]
    assert all(np.array_equal(np.load(tmp_path / f"{s}.npz")["features"], x) for s, x in m.items())
    got = {(r.stim, r.frame): r.features for r in source.read.format("npz").option("path", f"file://{tmp_path}").load().collect()}
    assert got == {(s, i): r.tolist() for s, x in m.items() for i, r in enumerate(x)}
    only = source.read.format("npz").option("path", str(tmp_path)).option("search", '["c"]').load()
    assert {r.stim for r in only.collect()} == {"c"}
    rest = source.read.format("npz").option("path", str(tmp_path)).option("ignore", '["c"]').load()
    assert {r.stim for r in rest.collect()} == {"a", "b"}


def test_append_and_overwrite(source, tmp_path):
    _, df = features(source)
    files.write_npz(df, str(tmp_path))
    np.savez(tmp_path / "z.npz", np.zeros((1, 1)))
    (tmp_path / "notes.txt").write_text("stay")
    files.write_npz(df.where("stim = 'a'").withColumn("features", F.transform("features", lambda x: x * 2)), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["a.npz", "b.npz", "c.npz", "notes.txt", "z.npz"]
    files.write_npz(df.where("stim = 'b'"), str(tmp_path), "overwrite")
    assert sorted(os.listdir(tmp_path)) == ["b.npz", "notes.txt"]


def test_a_job_that_fails_leaves_no_file(source, tmp_path):
    _, df = features(source)
    bad = df.withColumn("features", F.when((F.col("stim") == "c") & (F.col("frame") == 39), F.raise_error(F.lit("broken"))).otherwise(F.col("features")))
    with pytest.raises(Exception, match="broken"):
        files.write_npz(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_stimulus_in_two_tasks_is_an_error(source, tmp_path):
    _, df = features(source)
    with pytest.raises(Exception, match="more than one task"):
        df.where("stim = 'c'").write.format("npz").option("path", str(tmp_path)).mode("append").save()
    assert os.listdir(tmp_path) == []


def test_the_four_parts_of_aligned_annotations(source, tmp_path):
    rows = [("a", k, [float(k), 1.0], 7 - k, [0.0, float(k), 2.0], k / 2, k / 2 + 0.5) for k in (2, 0, 1)] + [("b", 0, [9.0, 9.0], 3, [1.0, 1.0, 1.0], 0.0, 1.0)]
    df = source.createDataFrame(rows, "stim string, seq int, pooled array<double>, token_id int, targets array<double>, t_start double, t_end double")
    files.write_aligned(df, str(tmp_path))
    load = lambda n: np.load(tmp_path / f"{n}.npz")["arr_0"]
    assert load("a").tolist() == [[0, 1], [1, 1], [2, 1]] and load("a_idtargets").tolist() == [7, 6, 5]
    assert load("a_regtargets").tolist() == [[0, 0, 2], [0, 1, 2], [0, 2, 2]] and load("a_times").tolist() == [[0, 0.5], [0.5, 1], [1, 1.5]]
    assert sorted(os.listdir(tmp_path)) == sorted(f"{s}{p}.npz" for s in "ab" for p in ("", "_idtargets", "_regtargets", "_times"))


def test_nothing_to_write(source, tmp_path):
    _, df = features(source)
    files.write_npz(df.where("frame < 0"), str(tmp_path))
    assert os.listdir(tmp_path) == []
    assert source.read.format("npz").option("path", str(tmp_path)).load().count() == 0
