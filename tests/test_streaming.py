"""Joins of two streams."""

import numpy as np
import pytest

from stimframe.streaming import windows


def test_overlaps_of_long_annotations(spark, tmp_path):
    """Every frame of an annotation of three days is kept; an annotation beyond the stated length is an error, with frames or without."""
    spans, frames = "stim string, s timestamp, e timestamp", "stim string, t timestamp"
    to_time = lambda *rows: [tuple(f"2024-01-0{x}" if isinstance(x, int) else x for x in r) for r in rows]
    for name, rows, schema in (("spans", to_time(("a", 1, 4), ("b", 1, 2)), spans), ("frames", to_time(("a", 1), ("a", 3), ("a", 4), ("a", 5), ("b", 2), ("b", 3)), frames), ("none", [], frames)):
        fields = [f.split() for f in schema.split(", ")]
        text = spark.createDataFrame(rows, ", ".join(f"{n} string" for n, _ in fields))
        text.selectExpr(*[f"cast({n} as {t}) as {n}" for n, t in fields]).write.parquet(str(tmp_path / name))
    run = lambda longest, of, out: windows.run_once(windows.overlap_stream(windows.read_stream(spark, str(tmp_path / "spans"), spans), windows.read_stream(spark, str(tmp_path / of), frames), "stim", "s", "e", "t", longest), str(tmp_path / out), str(tmp_path / f"{out}-state"))
    run("3 days", "frames", "out")
    assert sorted((r.stim, r.t.day) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 2)]
    for k, of in enumerate(("frames", "none")):
        with pytest.raises(Exception, match="longer than 2 days"):
            run("2 days", of, f"refused-{k}")


@pytest.mark.parametrize("name", ["session", "sliding"])
def test_windows_of_a_stream_are_those_of_a_batch(spark, tmp_path, name):
    """Files come one at a time; once the last one has moved the clock, every closed window has come, as from a batch."""
    from pyspark.sql import functions as F

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).alias("ts"), "user_id", "value")
    cut = e.agg(F.expr("percentile(cast(ts as double), array(0.4, 0.8))")).first()[0]
    t = F.col("ts").cast("double")
    far = spark.createDataFrame([(-1, 0.0)], "user_id long, value double").select(F.timestamp_seconds(F.lit(4e9)).alias("ts"), "user_id", "value")
    make = {
        "session": lambda df: windows.session_stream(df, "ts", "12 hours", ["user_id"], "value", "2 days"),
        "sliding": lambda df: windows.sliding_stream(df, "ts", "24 hours", "12 hours", ["user_id"], "value", "2 days"),
    }[name]
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.where("user_id >= 0").collect())
    for part in (e.where(t <= cut[0]), e.where((t > cut[0]) & (t <= cut[1])), e.where(t > cut[1]), far, far):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows.run_once(make(windows.read_stream(spark, str(tmp_path / "in"), e.schema, 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(make(e))


def scan_batches(spark, tmp_path, rows, schema, n, run):
    """What a stream gives over n files, stopped and started again from its checkpoint in the middle."""
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    got = []
    for k in range(n):
        spark.read.parquet(str(tmp_path / f"part{k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = windows.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        windows.run_once(run(stream), str(tmp_path / "out"), str(tmp_path / "check"))
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    return spark.read.parquet(str(tmp_path / "out")).collect(), got


def test_recurrence_over_a_stream_equals_the_table(spark, tmp_path):
    from stimframe.operators import scans

    g = np.random.default_rng(41)
    values = {s: g.normal(size=n) for s, n in (("a", 40), ("b", 7), ("c", 1))}
    rows = [(s, i, float(x)) for s, v in values.items() for i, x in enumerate(v)]
    g.shuffle(rows)
    rows = [(s, int(i), float(x)) for s, i, x in rows] + [("a", 3, 99.0)]  # one comes again
    taps = (0.2, 0.1, 0.0, -0.1, -0.2)
    got, sizes = scan_batches(spark, tmp_path, rows, "stim string, frame long, v double", 3, lambda s: windows.recurrence_stream(s, "stim", "frame", "v", 0.98, taps))
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(s, i, [float(x)]) for s, v in values.items() for i, x in enumerate(v)], "stim string, frame long, v array<double>")
    want = {(r.stim, r.frame): r.features[0] for r in scans.unpack(scans.rasta(scans.written(scans.pack(table, ["stim"], "frame", "v", 8, 4)), ["stim"], 1), ["stim"], 1, block=8).collect()}
    found = {(r.stim, r.frame): r.y for r in got}
    assert len(got) == len(found) == len(want) and all(np.isclose(found[k], want[k]) for k in want) and sizes[0] < sizes[-1]


def test_segments_over_a_stream_equal_the_table(spark, tmp_path):
    from stimframe.operators import functionals

    g = np.random.default_rng(42)
    flags = {s: (g.random(n) < 0.5).tolist() for s, n in (("a", 30), ("b", 9), ("c", 1))}
    rows = [(s, i, bool(x)) for s, v in flags.items() for i, x in enumerate(v)] + [(s, len(v), None) for s, v in flags.items()]
    order = g.permutation(len(rows))
    got, _ = scan_batches(spark, tmp_path, [rows[k] for k in order], "stim string, frame long, f boolean", 3, lambda s: windows.segments_stream(s, "stim", "frame", "f"))
    table = spark.createDataFrame([r for r in rows if r[2] is not None], "stim string, frame long, f boolean")
    from pyspark.sql import functions as F

    want = functionals.segments(table, ["stim"], ["frame"], F.col("f")).collect()
    assert sorted((r.stim, r.start, r.on, r.length) for r in got) == sorted((r.stim, r.start, r.on, r.length) for r in want)
