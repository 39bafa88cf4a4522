"""Files in and out, alignment edges, and streams."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.operators import align, extract
from stimframe.sources import files
from stimframe.streaming import windows


def put_wav(path, samples, rate=16_000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())


def test_npz(spark, tmp_path):
    m = np.arange(12.0).reshape(4, 3)
    np.savez(tmp_path / "a_1.npz", features=m)
    np.savez(tmp_path / "b.npz", m + 1)
    np.savez(tmp_path / "a_1_times.npz", times=m[:, :2])
    read = files.read_features(spark, str(tmp_path), ignore=["_times"]).orderBy("stim", "frame").collect()
    assert [r.stim for r in read] == ["a"] * 4 + ["b"] * 4 and read[5].features == [4.0, 5.0, 6.0]
    t = files.read_features(spark, str(tmp_path), search="_times".split())
    joined = files.with_times(files.read_features(spark, str(tmp_path), ignore=["_times"]), t).orderBy("frame").collect()
    assert [(r.t_start, r.t_end) for r in joined] == [(0, 1), (3, 4), (6, 7), (9, 10)]
    out = tmp_path / "out"
    out.mkdir()
    files.write_npz(files.read_features(spark, str(tmp_path), search=["b."]), str(out)).collect()
    assert np.array_equal(np.load(out / "b.npz")["features"], m + 1)


def test_two_files_of_one_stimulus(spark, tmp_path):
    for n in ("a_1.npz", "a_2.npz"):
        np.savez(tmp_path / n, np.zeros((1, 1)))
    with pytest.raises(ValueError, match="two files"):
        files.unique_stimuli(files.scan_binary(spark, str(tmp_path), "*.npz"))


def test_audio_to_features(spark, tmp_path):
    put_wav(tmp_path / "tone.wav", 0.5 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))
    put_wav(tmp_path / "short.wav", np.zeros(10))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    waves = files.read_audio(files.select_stimuli(spark, str(tmp_path)))
    assert {r.stim: len(r.waveform) for r in waves.collect()} == {"tone": 16_000, "short": 10}
    lld = extract.extract(waves, "lld").collect()
    assert {r.stim for r in lld} == {"tone"} and len(lld) == 49
    assert all(abs(r.features[2] - 440) < 10 for r in lld)
    cut = extract.snippet_waves(waves, 1600, 6400).collect()
    assert len(cut) == 6 and all(len(r.waveform) == 8000 for r in cut)
    padded = extract.unpad(extract.extract(extract.pad_silence(waves, 1600), "fbank"), 0.1)
    assert padded.where("t_start < 0").isEmpty()
    with pytest.raises(ValueError, match="no stimuli"):
        files.select_stimuli(spark, str(tmp_path), names=["none"])


def test_documents(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1}))
    (tmp_path / "splits.json").write_text(json.dumps([{"train": ["x", "y"], "val": [], "test": ["z"]}]))
    (tmp_path / "m.txt").write_text("2 3\n1 2 3\n4 5 6\n")
    assert {r.token: r.idx for r in files.read_vocabulary(spark, str(tmp_path / "vocab.json")).collect()} == {"a": 0, "b": 1}
    assert sorted((r.split, r.stim, r.role) for r in files.read_splits(spark, str(tmp_path / "splits.json")).collect()) == [(0, "x", "train"), (0, "y", "train"), (0, "z", "test")]
    assert [r.row for r in files.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("place").collect()] == [[1, 2, 3], [4, 5, 6]]


def test_loudness(spark):
    df = spark.createDataFrame([([float(i) for i in range(14)],)], "features array<double>")
    assert files.drop_loudness(df).first().features == [float(i) for i in range(14) if i != 12]
    with pytest.raises(Exception, match="13 channels"):
        files.drop_loudness(df.withColumn("features", F.slice("features", 1, 5))).collect()


@pytest.mark.parametrize("bucket", [None, 0.5])
def test_overlap(spark, bucket):
    spans = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 2.5, 2.5), ("b", 2, 0.0, 9.0)], "stim string, seq int, s double, e double")
    frames = spark.createDataFrame([("a", 1.0), ("a", 2.25), ("a", 2.26), ("a", 2.5), ("a", 0.99)], "stim string, t_end double")
    got = align.overlap_join(spans, frames, "stim", ("s", "e"), "t_end", 0.25, bucket=bucket).collect()
    assert sorted((r.seq, r.t_end) for r in got) == [(0, 1.0), (0, 2.25), (1, 2.5)]


def test_stream_gives_the_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(d)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), batch.schema)
    windows.run_once(windows.sliding_stream(stream, "ts", "24 hours", "12 hours", ["event_type"], "value", "60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q = windows.sliding_stream(batch, "ts", "24 hours", "12 hours", ["event_type"], "value")
    want = {(r.event_type, r.w_start): (round(r["mean"], 6), r.n) for r in q.collect()}
    got = {(r.event_type, r.w_start): (round(r["mean"], 6), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert all(want[k] == v for k, v in got.items())
