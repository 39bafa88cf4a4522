"""Functionals of time series: smoothing, deltas, runs, moments, percentiles, regression, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stimframe.operators.rank import quantiles


def _order(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, width: int = 3, no_zero: bool = False, to: str = "smooth") -> DataFrame:
    """Centred mean of `width` rows; with no_zero zeros don't count, and stay zero themselves."""
    w = _order(by, order).rowsBetween(-(width // 2), width // 2)
    if not no_zero:
        return df.withColumn(to, F.avg(value).over(w))
    return df.withColumn(to, F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.avg(F.nullif(F.col(value), F.lit(0.0))).over(w)))


def delta(df: DataFrame, by: list[str], order: list[str], value: str, reach: int = 2, to: str = "delta") -> DataFrame:
    """Regression slope over `reach` rows on either side; beyond an end its own row stands in."""
    w = _order(by, order)
    v = F.col(value)
    top = sum((k * (F.coalesce(F.lead(value, k).over(w), F.last(value).over(w.rowsBetween(0, k))) - F.coalesce(F.lag(value, k).over(w), F.first(value).over(w.rowsBetween(-k, 0)))) for k in range(1, reach + 1)), F.lit(0.0) * v)
    return df.withColumn(to, top / (2 * sum(k * k for k in range(1, reach + 1))))


def segments(df: DataFrame, by: list[str], order: list[str], flag) -> DataFrame:
    """Runs of equal flags: where each begins (the first order column), whether it is on, and its length."""
    w = _order(by, order)
    on = df.withColumn("on", flag)
    new = F.when(F.col("on") != F.lag("on").over(w), 1).otherwise(0)
    runs = on.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "__run", "on").agg(F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("length")).drop("__run")


def segments_above(df: DataFrame, by: list[str], order: list[str], value: str, share: float = 0.25) -> DataFrame:
    """Runs of values over the group's minimum by more than that share of its range, and under it."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return segments(df.join(ends, by), by, order, F.col(value) > F.col("__lo") + share * (F.col("__hi") - F.col("__lo")))


def segment_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Number, mean, largest, smallest and SD (population) of the lengths of runs that are on."""
    return runs.where("on").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_segments"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"), F.min("length").alias("min_length"), F.stddev_pop("length").alias("sd_length")
    )


def means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Arithmetic mean, mean of positive values, root of the mean square, flatness (geometric over arithmetic mean of the non-zero), number of non-zero values."""
    v = F.col(value)
    size = F.when(v != 0, F.abs(v))
    return df.groupBy(*by).agg(
        F.avg(v).alias("amean"), F.avg(F.when(v > 0, v)).alias("posamean"), F.sqrt(F.avg(v * v)).alias("rqmean"), F.try_divide(F.exp(F.avg(F.log(size))), F.avg(size)).alias("flatness"), F.count_if(v != 0).alias("nnz")
    )


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population SD, its share of the mean, skewness and kurtosis (3 for a normal)."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.try_divide(F.stddev_pop(value), F.abs(F.avg(value))).alias("sd_norm"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt")
    )


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1, 20, 25, 50, 75, 80 and 99 per cent points, interpolated, and the range between the outer ones."""
    points = (0.01, 0.2, 0.25, 0.5, 0.75, 0.8, 0.99)
    p = quantiles(df, by, value, points, "p")
    return p.select(*by, *[F.col("p")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(points)], (F.col("p")[4] - F.col("p")[2]).alias("iqr"), (F.col("p")[6] - F.col("p")[0]).alias("range"))


def regression(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Line through the values over time, its mean squared error, and the centroid of their sizes."""
    slope, offset = F.regr_slope(value, t), F.regr_intercept(value, t)
    error = F.regr_syy(value, t) - F.try_divide(F.regr_sxy(value, t) * F.regr_sxy(value, t), F.regr_sxx(value, t))
    size = F.abs(F.col(value))
    return df.groupBy(*by).agg(slope.alias("slope"), offset.alias("offset"), (error / F.count(F.lit(1))).alias("error"), F.try_divide(F.sum(F.col(t) * size), F.sum(size)).alias("centroid"))


def quadratic(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """a, b, c of the least-squares parabola a*t*t + b*t + c, by the normal equations of centred time (Cramer's rule)."""
    c = df.join(df.groupBy(*by).agg(F.avg(t).alias("__m")), by).withColumn("__t", F.col(t) - F.col("__m"))
    sums = c.groupBy(*by).agg(*[F.sum(F.pow("__t", F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(F.pow("__t", F.lit(k)) * F.col(value)).alias(f"y{k}") for k in range(3)], F.first("__m").alias("__m"))
    d = "(s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2))"
    a = f"try_divide(y2 * (s2 * s0 - s1 * s1) - s3 * (y1 * s0 - s1 * y0) + s2 * (y1 * s1 - s2 * y0), {d})"
    b = f"try_divide(s4 * (y1 * s0 - s1 * y0) - y2 * (s3 * s0 - s1 * s2) + s2 * (s3 * y0 - y1 * s2), {d})"
    k = f"try_divide(s4 * (s2 * y0 - y1 * s1) - s3 * (s3 * y0 - y1 * s2) + y2 * (s3 * s1 - s2 * s2), {d})"
    at = sums.select(*by, "__m", F.expr(a).alias("qa"), F.expr(b).alias("__b"), F.expr(k).alias("__k"))
    return at.select(*by, "qa", (F.col("__b") - 2 * F.col("qa") * F.col("__m")).alias("qb"), (F.col("qa") * F.col("__m") * F.col("__m") - F.col("__b") * F.col("__m") + F.col("__k")).alias("qc"))


def extremes(df: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """Relative place of the largest and smallest value, the first where several are equal."""
    first = -F.col(place)
    return df.groupBy(*by).agg(
        (F.max(F.struct(F.col(value), first.alias("p")))["p"] * -1 / F.count(F.lit(1))).alias("max_pos"), (F.min(F.struct(F.col(value), F.col(place).alias("p")))["p"] / F.count(F.lit(1))).alias("min_pos")
    )


def level_times(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Share of rows above those levels of the range."""
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    above = lambda q: F.avg((F.col(value) > F.col("__lo") + q * (F.col("__hi") - F.col("__lo"))).cast("double"))
    return df.join(ends, by).groupBy(*by).agg(*[above(q).alias(f"up{round(q * 100)}") for q in levels])


def rise_times(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Share of steps that rise, and that curve to the left."""
    w = _order(by, order)
    step = df.withColumn("__d", F.col(value) - F.lag(value).over(w))
    step = step.withColumn("__dd", F.col("__d") - F.lag("__d").over(w))
    return step.groupBy(*by).agg(F.avg((F.col("__d") > 0).cast("double")).alias("rise"), F.avg((F.col("__dd") > 0).cast("double")).alias("left_curve"))


def peaks(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float = 0.1) -> DataFrame:
    """Local maxima higher above the mean than `threshold` of the range: number, mean distance in rows, mean height above the mean."""
    w = _order(by, order)
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), (F.max(value) - F.min(value)).alias("__r"))
    v = F.col(value)
    at = df.withColumns({"__at": F.row_number().over(w), "__top": (v > F.lag(value).over(w)) & (v >= F.lead(value).over(w))}).join(stats, by).where(F.col("__top") & (v - F.col("__m") > threshold * F.col("__r")))
    gap = at.withColumn("__gap", F.col("__at") - F.lag("__at").over(Window.partitionBy(*by).orderBy("__at")))
    return gap.groupBy(*by).agg(F.count(F.lit(1)).alias("n_peaks"), F.avg("__gap").alias("mean_distance"), F.avg(v - F.col("__m")).alias("mean_height"))


def turning_points(df: DataFrame, by: list[str], order: list[str], value: str, least: float = 0.1) -> DataFrame:
    """Of the maxima and minima that differ from the turn before them by more than `least` of the range: numbers, mean and range of
    the maxima, mean of the minima, mean distance in rows of the turns kept, mean slopes of rises and of falls (a row is a step).
    """
    w = _order(by, order)
    v = F.col(value)
    spread = df.groupBy(*by).agg((F.max(value) - F.min(value)).alias("__r"))
    turn = df.withColumns({"__at": F.row_number().over(w), "__up": v - F.lag(value).over(w), "__down": v - F.lead(value).over(w)})
    turn = turn.where("(__up > 0 and __down >= 0) or (__up < 0 and __down <= 0)").withColumn("__top", F.col("__up") > 0)
    t = Window.partitionBy(*by).orderBy("__at")
    step = turn.withColumns({"__dv": v - F.lag(value).over(t), "__dt": F.col("__at") - F.lag("__at").over(t)}).join(spread, by)
    kept = step.where(F.abs("__dv") > least * F.col("__r"))
    top = F.when(F.col("__top"), v)
    slope = F.col("__dv") / F.col("__dt")
    return kept.groupBy(*by).agg(
        F.count_if("__top").alias("n_maxima"), F.count_if(~F.col("__top")).alias("n_minima"), F.avg(top).alias("mean_maximum"), (F.max(top) - F.min(top)).alias("range_maxima"),
        F.avg(F.when(~F.col("__top"), v)).alias("mean_minimum"), F.avg("__dt").alias("mean_distance"), F.avg(F.when(F.col("__dv") > 0, slope)).alias("mean_rise"), F.avg(F.when(F.col("__dv") < 0, slope)).alias("mean_fall"),
    )


def temporal_rates(df: DataFrame, by: list[str], order: list[str], loudness: str, pitch: str, frame_seconds: float) -> DataFrame:
    """Loudness peaks a second, voiced segments a second, and mean and SD (population) of voiced and unvoiced segments in seconds."""
    n = df.groupBy(*by).agg((F.count(F.lit(1)) * frame_seconds).alias("__seconds"))
    tops = peaks(df, by, order, loudness, 0.0).select(*by, "n_peaks")
    length = F.col("length") * frame_seconds
    runs = segments(df, by, order, F.col(pitch) > 0).groupBy(*by).agg(
        F.count_if("on").alias("__voiced"), F.avg(F.when(F.col("on"), length)).alias("mean_voiced"), F.stddev_pop(F.when(F.col("on"), length)).alias("sd_voiced"),
        F.avg(F.when(~F.col("on"), length)).alias("mean_unvoiced"), F.stddev_pop(F.when(~F.col("on"), length)).alias("sd_unvoiced"),
    )
    rate = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("__seconds")
    every = n.join(tops, by, "left").join(runs, by)
    return every.select(*by, rate("n_peaks").alias("peaks_per_second"), rate("__voiced").alias("voiced_per_second"), "mean_voiced", "sd_voiced", "mean_unvoiced", "sd_unvoiced")


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """Sums of products at lags 0 to lags: what linear prediction starts from."""
    w = _order(by, order)
    return df.withColumns({f"__l{k}": F.col(value) * F.lag(value, k).over(w) for k in range(lags + 1)}).groupBy(*by).agg(*[F.sum(f"__l{k}").alias(f"r{k}") for k in range(lags + 1)])


def sound_level(df: DataFrame, by: list[str], energy: str) -> DataFrame:
    """Equivalent sound level in dB."""
    return df.groupBy(*by).agg((10 * F.log10(F.avg(energy))).alias("level"))
