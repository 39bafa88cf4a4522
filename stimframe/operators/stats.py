"""Metrics, grouped summaries and tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimframe.operators.rank import quantiles


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where either side is constant, in ANSI mode too."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def r2_rmse(df: DataFrame, by: list[str], true: str, pred: str) -> DataFrame:
    """R2 and RMSE of each group, in one pass: the total sum of squares comes from the variance. A constant target has no R2."""
    e = F.col(pred) - F.col(true)
    return df.groupBy(*by).agg((1 - F.try_divide(F.avg(e * e), F.var_pop(true))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"))


def class_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """A row for each class that is true or predicted somewhere: support, precision, recall, F1; NULL where undefined."""
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))  # a row for each pair of classes
    every = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("is"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("is"), F.col("n").alias("said")))).alias("s")).select("s.*")
    sums = every.groupBy(F.col("c").alias("class")).agg(F.sum("hit").alias("hit"), F.sum("is").alias("support"), F.sum("said").alias("said"))
    p, r = F.try_divide(F.col("hit"), F.col("said")), F.try_divide(F.col("hit"), F.col("support"))
    return sums.select("class", "support", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def class_summary(df: DataFrame, true: str, pred: str, average: str = "macro") -> DataFrame:
    """One row: accuracy, balanced accuracy (mean recall of true classes), and precision, recall and F1, macro or weighted by support."""
    m = class_metrics(df, true, pred)
    w = F.when(F.col("support") > 0, F.col("support") if average == "weighted" else F.lit(1)).otherwise(0)
    mean = lambda c: F.sum(F.coalesce(c, F.lit(0.0)) * w) / F.sum(w)
    return m.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
        mean(F.col("precision")).alias("precision"), mean(F.col("recall")).alias("recall"), mean(F.col("f1")).alias("f1"),
    )


def fill_labels(metrics: DataFrame, labels: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """metrics with a row for every label; values of those left out of the fit are NaN."""
    return labels.select(label).join(metrics, label, "left").withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in columns})


def group_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def pairwise_t(df: DataFrame, group: str, value: str) -> DataFrame:
    """t and degrees of freedom of every pair of groups, unpaired with pooled SD over all groups."""
    m = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    pooled = m.agg((F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)).alias("s2"), F.sum(F.col("n") - 1).alias("df"))
    a, b = (m.select(F.col(group).alias(f"group{k}"), F.col("n").alias(f"n{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
    pairs = a.join(b, F.col("group1") < F.col("group2")).crossJoin(pooled)  # of group moments: a row for each group
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("s2") * (1 / F.col("n1") + 1 / F.col("n2")))
    return pairs.select("group1", "group2", t.alias("t"), F.col("df"))


def pairwise_p(df: DataFrame, group: str, value: str) -> DataFrame:
    """pairwise_t with two-sided p, its Bonferroni adjustment and significance marks; rows are pairs of groups, few enough for the driver."""
    spark, rows = df.sparkSession, pairwise_t(df, group, value).collect()
    jvm = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    out = []
    for r in rows:
        p = 2 * jvm.TDistribution(float(r.df)).cumulativeProbability(-abs(r.t)) if r.t is not None else None
        adj = None if p is None else min(1.0, p * len(rows))
        marks = None if adj is None else next((s for limit, s in ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*")) if adj <= limit), "ns")
        out.append((r.group1, r.group2, r.t, float(r.df), p, adj, marks))
    return spark.createDataFrame(out, "group1 string, group2 string, t double, df double, p double, p_adj double, signif string")


def boxplot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 IQR of the box) and the number of outliers."""
    box = quantiles(df, by, value, (0.25, 0.5, 0.75))
    box = box.select(*by, *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)])
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(low, high)
    return df.join(box, by).groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def pooled_eval(df: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """Mean and count by (group, part) and by group alone (part NULL), in one pass."""
    return df.groupingSets([[F.col(group), F.col(part)], [F.col(group)]], group, part).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def corr_by_feature(long_a: DataFrame, on: list[str], by: list[str], x: str, y: str) -> DataFrame:
    """Correlation over rows, for each dimension of `by`."""
    return long_a.groupBy(*by).agg(guarded_corr(F.col(x), F.col(y)).alias("corr"))


def recode(df: DataFrame, columns: list[str], names: dict[str, str]) -> DataFrame:
    return df.replace(names, subset=columns)


def split_metric(metric: Column) -> tuple[Column, Column]:
    """Name and trailing number of a metric such as recall12; NULL without a number."""
    n = F.regexp_extract(metric, "([0-9]*)$", 1)
    return F.regexp_extract(metric, "^(.*?)[0-9]*$", 1), F.when(n != "", n.cast("int"))


def drop_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL or NaN in the columns."""
    kept = df.dropna(subset=columns)
    for c in columns:
        kept = kept.where(~F.isnan(c))
    return kept


def all_pairs(groups: list[str]) -> list[tuple[str, str]]:
    return list(combinations(sorted(groups), 2))
