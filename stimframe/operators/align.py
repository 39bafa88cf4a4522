"""Time alignment: ordering, interval overlap, pooling, windows and frame selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimframe.session import materialise


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def seconds(ts: str) -> Column:
    return micros(ts) / F.lit(1e6)


def align_sort(df: DataFrame, key: str, start: str, frame: str, to: str = "pos") -> DataFrame:
    """0-based place of each row of a stimulus by start time; the frame number decides ties."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(key).orderBy(start, frame)) - 1)


def overlap_join(spans: DataFrame, frames: DataFrame, key: str, span: tuple[str, str], frame_end: str, frame_len: float | None = 0.025, frame_start: str | None = None, bucket: float | None = None) -> DataFrame:
    """Pairs of an annotation and a frame of the same stimulus whose closed intervals share a point.

    A frame is [end - frame_len, end], or [frame_start, end] with frame_len=None. With a bucket width each side is dealt to the
    time buckets that it touches, and a pair is made in the first bucket that both touch, so long stimuli are compared
    piecewise and spread over tasks; without one the join is on the stimulus alone.
    """
    s, e = span
    low = F.col(frame_end) - F.lit(frame_len) if frame_len is not None else F.col(frame_start)
    a = spans.withColumns({"__s": F.col(s), "__e": F.col(e)})
    b = frames.withColumns({"__lo": low, "__hi": F.col(frame_end)})
    meets = F.greatest("__s", "__lo") <= F.least("__e", "__hi")
    if bucket is None:
        return a.join(b, key).where(meets).drop("__s", "__e", "__lo", "__hi")
    at = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    a = a.withColumn("__b", F.explode(F.sequence(at("__s"), at("__e"))))
    b = b.withColumn("__b", F.explode(F.sequence(at("__lo"), at("__hi"))))
    first = F.col("__b") == F.greatest(at("__s"), at("__lo"))
    return a.join(b, [key, "__b"]).where(meets & first).drop("__s", "__e", "__lo", "__hi", "__b")


def mean_pool(pairs: DataFrame, by: list[str], value: str, to: str = "pooled") -> DataFrame:
    """Mean of the matched frames of each annotation; annotations without a frame are gone with the inner join."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), F.avg(value).alias(to))


def mean_pool_vectors(pairs: DataFrame, by: list[str], features: str, to: str = "pooled") -> DataFrame:
    """Element-wise mean of the matched frames' vectors, as an array in the order of dimensions."""
    long = pairs.select(*by, F.posexplode(features).alias("dim", "v")).groupBy(*by, "dim").agg(F.avg("v").alias("m"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias(to))


def snippets(length: Column, chunk: int, context: int, full: bool = True) -> Column:
    """Windows of a stimulus of that many samples: array of struct(s_start, s_end), a hop of chunk and a length of context + chunk.

    With full only windows with the whole context; without it the first ones begin at 0. Ranges alone, no samples.
    """
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.floor(length / chunk).cast("int"), F.lit(1))), lambda i: i * chunk)
    every = F.transform(ends, lambda e: F.struct(F.greatest(e - F.lit(context + chunk), F.lit(0)).alias("s_start"), e.alias("s_end")))
    return F.filter(every, lambda w: (w["s_end"] <= length) & (F.lit(not full) | (w["s_end"] - w["s_start"] == context + chunk)))


def with_stride(chunk: int, context: int, stride: int | None) -> tuple[int, int]:
    """Hop and context of windows of the same length, context + chunk, that move on by `stride` where one is given."""
    return (chunk, context) if stride is None else (stride, chunk + context - stride)


def sliding(df: DataFrame, ts: str, length: str, hop: str, by: list[str], value: str) -> DataFrame:
    """Mean and count of overlapping windows, named by their start in epoch seconds."""
    return (
        df.groupBy(*by, F.window(ts, length, hop)).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(*by, F.floor(micros("window.start") / 1_000_000).alias("w_start"), "mean", "n")
    )


def select_frames(df: DataFrame, key: str, order: list[str], n: int = 1, skip: int = 5, whole: bool = False) -> DataFrame:
    """The last frame of each stimulus and n - 1 before it, skip apart; with whole, none of a stimulus with fewer than (n - 1) * skip - 1 frames."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])) - 1
    held = df.withColumn("__back", back).where((F.col("__back") % skip == 0) & (F.col("__back") < n * skip)).drop("__back")
    if not whole:
        return held
    sizes = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= (n - 1) * skip - 1)
    return held.join(sizes, F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def row_offsets(df: DataFrame, key: str) -> DataFrame:
    """Row range [start, stop) of each stimulus in the concatenation by name."""
    n = materialise(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(key).withColumn("__pid", F.spark_partition_id()), "offsets")
    within = F.sum("n").over(Window.partitionBy("__pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    sums = n.groupBy("__pid").agg(F.sum("n").alias("__sum"))  # a row for each partition
    before = sums.select("__pid", (F.sum("__sum").over(Window.orderBy("__pid")) - F.col("__sum")).alias("__before"))
    stop = n.withColumn("__in", within).join(before, "__pid").withColumn("stop", F.col("__before") + F.col("__in"))
    return stop.select(key, (F.col("stop") - F.col("n")).alias("start"), "stop")


def times_join(features: DataFrame, targets: DataFrame, key: str = "stim", frame: str = "frame", times: tuple[str, ...] = ("t_start", "t_end")) -> DataFrame:
    """Rows of both sides by stimulus and frame, with the times of the features.

    Both must have the same frames at the same times: a frame of one side alone, or with other times, stops the job with the
    stimulus in the message. The check is part of the join, in its one exchange.
    """
    named = {t: f"__{t}" for t in times}
    both = features.withColumn("__a", F.lit(True)).join(targets.withColumnsRenamed(named).withColumn("__b", F.lit(True)), [key, frame], "full_outer")
    good = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for t, other in named.items():
        good = good & F.col(t).eqNullSafe(F.col(other))
    stop = F.raise_error(F.concat(F.lit("features and targets differ in frames or times: stimulus "), F.col(key).cast("string"), F.lit(", frame "), F.col(frame).cast("string")))
    return both.where(F.when(good, F.lit(True)).otherwise(stop.cast("boolean"))).drop("__a", "__b", *named.values())


def too_short(df: DataFrame, length: str, least: int) -> DataFrame:
    """Stimuli whose length is under the least that a model takes; with require_length() such a stimulus stops the job."""
    return df.where(F.col(length) < least)


def long_enough(df: DataFrame, length: str, least: int) -> DataFrame:
    """df without stimuli whose length is under the least that a model takes, or unknown."""
    return df.where(F.col(length) >= least)


def require_length(df: DataFrame, length: str, least: int, key: str = "stim") -> DataFrame:
    """df, unless a stimulus is shorter than the full context that is asked for."""
    stop = F.raise_error(F.concat(F.lit(f"shorter than {least}: stimulus "), F.col(key).cast("string")))
    return df.where(F.when(F.col(length) >= least, F.lit(True)).otherwise(stop.cast("boolean")))
