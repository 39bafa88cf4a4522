"""The same transforms over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive; the checkpoint remembers those that are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sliding_stream(stream: DataFrame, ts: str, length: str, hop: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Mean and count of overlapping windows; rows later than `late` are dropped, and in append mode a window comes once it is closed."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(*by, F.window("__ts", length, hop)).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*by, F.unix_seconds("window.start").alias("w_start"), "mean", "n")


def session_stream(stream: DataFrame, ts: str, gap: str, by: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Sessions of rows with no gap as long as `gap` between them: start and end in epoch seconds, count and sum."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(*by, F.session_window("__ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.unix_seconds("session_window.start").alias("start"), F.unix_seconds("session_window.end").alias("stop"), "n", "total")


def overlap_stream(spans: DataFrame, frames: DataFrame, key: str, start: str, stop: str, at: str, longest: str, late: str = "1 hour") -> DataFrame:
    """Pairs of annotations and frames of a stimulus, both streams, where a frame's time falls within the annotation.

    longest is an interval ("3 days") that no annotation may exceed: state is held for so long and for `late`, and an
    annotation that lasts longer stops the query with an error, as it would miss frames. Rows later than `late` are dropped.
    """
    a = spans.withColumns({"__s": F.col(start).cast("timestamp"), "__e": F.col(stop).cast("timestamp")})
    fits = F.col("__e").isNull() | F.col("__s").isNull() | F.expr(f"__e <= __s + interval {longest}")
    told = F.raise_error(F.concat_ws(" ", F.lit(f"an annotation lasts longer than {longest}:"), F.col("__s").cast("string"), F.col("__e").cast("string"))).cast("boolean")
    a = a.where(F.when(fits, F.lit(True)).otherwise(told)).withWatermark("__s", late)
    b = frames.withColumn("__t", F.col(at).cast("timestamp")).withColumnRenamed(key, "__key").withWatermark("__t", late)
    return a.join(b, F.expr(f"{key} = __key and __t >= __s and __t <= __e and __t <= __s + interval {longest}")).drop("__s", "__e", "__t", "__key")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now to Parquet and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Frames of a series that wait for earlier ones, at most, before a stream stops with an error.
WAITING = 1_000_000


def _in_order(held: list, rows: Iterator[pd.DataFrame], key: str, frame: str, columns: list[str], following: int) -> tuple[list[tuple], list[tuple]]:
    """The rows from frame `following` on without a gap, and those that wait; a frame that comes again counts once."""
    seen = {r[0]: tuple(r) for r in held}
    for part in rows:
        for r in part[[frame, *columns]].itertuples(index=False):
            if r[0] >= following:
                seen.setdefault(int(r[0]), tuple(r))
    if len(seen) > WAITING:
        raise ValueError(f"more than {WAITING} frames wait for frame {following}")
    ready = []
    while following in seen:
        ready.append(seen.pop(following))
        following += 1
    return ready, sorted(seen.values())


def recurrence_stream(stream: DataFrame, key: str, frame: str, value: str, feedback: float, taps: tuple[float, ...]) -> DataFrame:
    """(key, frame, y) of a stream of (key, frame, value): y[t] = feedback * y[t - 1] + sum of taps[k] * value[t - k].

    The state of a series is its last values, the last y, the next frame's number and the frames that came before their turn (frames are numbered from
    0). A frame goes out once all before it have come, so that the stream gives what scans.recurrence() gives on a table, in whatever batches
    and order the frames come, also after a restart from the checkpoint. Before a series its first value stands in. A frame that comes again is passed over.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, y, following, held = state.get if state.exists else ([], 0.0, 0, [])
        ready, wait = _in_order([(int(f), v) for f, v in held], rows, key, frame, [value], following)
        last, out = list(last), []
        for _, v in ready:
            last = [*last, float(v)] if last else [float(v)] * len(taps)
            last = last[-len(taps) :]
            y = feedback * y + sum(t * x for t, x in zip(taps, reversed(last)))
            out.append(y)
        state.update((last, float(y), following + len(ready), [(int(f), float(v)) for f, v in wait]))
        if out:
            yield pd.DataFrame({key: [k[0]] * len(out), frame: range(following, following + len(out)), "y": out})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {frame} long, y double", "last array<double>, y double, following long, held array<struct<f:long,v:double>>", "append", "NoTimeout")


def segments_stream(stream: DataFrame, key: str, frame: str, flag: str) -> DataFrame:
    """(key, start, on, length) of the runs of equal flags of a stream of (key, frame, flag), each when the next begins; a NULL flag ends the series' last run.

    The state of a series is its open run and the frames that came before their turn; as in recurrence_stream() frames are numbered from 0 and may come in any order.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on, start, following, held = state.get if state.exists else (None, 0, 0, [])
        ready, wait = _in_order([(int(f), v) for f, v in held], rows, key, frame, [flag], following)
        out = []
        for f, v in ready:
            v = None if pd.isna(v) else bool(v)
            if v != on:
                if on is not None:
                    out.append((k[0], start, on, int(f) - start))
                start = int(f)
            on = v
        state.update((on, start, following + len(ready), [(int(f), None if pd.isna(v) else bool(v)) for f, v in wait]))
        if out:
            yield pd.DataFrame(out, columns=[key, "start", "on", "length"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start long, on boolean, length long", "on boolean, start long, following long, held array<struct<f:long,v:boolean>>", "append", "NoTimeout")
