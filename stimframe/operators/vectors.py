"""Vector tables: scaling, ranks, projections, similarity search."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.operators.rank import ranked

TINY = 1e-10


def with_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with the mean and population SD of its group: a partial aggregate joined back, so few large groups don't meet in few tasks."""
    return df.join(df.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd")), by)


def zscore(df: DataFrame, by: list[str], value: str, to: str = "z") -> DataFrame:
    return with_moments(df, by, value).withColumn(to, (F.col(value) - F.col("__mean")) / (F.lit(TINY) + F.col("__sd"))).drop("__mean", "__sd")


def clip_sd(df: DataFrame, by: list[str], value: str, sds: float, to: str = "clipped") -> DataFrame:
    low, high = (F.col("__mean") + F.lit(k * sds) * F.col("__sd") for k in (-1.0, 1.0))
    return with_moments(df, by, value).withColumn(to, F.least(F.greatest(F.col(value), low), high)).drop("__mean", "__sd")


def uniformize(df: DataFrame, by: list[str], value: str, tie: str, to: str = "rank") -> DataFrame:
    """0-based rank of each value in its dimension; ties by the tie column."""
    return ranked(df, by, [F.col(value), F.col(tie)], to).withColumn(to, F.col(to).cast("double"))


@F.pandas_udf(T.DoubleType())
def _inverse_normal(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return p.map(inv)


def gaussianize(df: DataFrame, by: list[str], value: str, tie: str, to: str = "gauss") -> DataFrame:
    """Normal quantile of (rank + 1) / (largest rank + 2), over its population SD."""
    placed = uniformize(df, by, value, tie, "__rank")
    top = placed.groupBy(*by).agg(F.max("__rank").alias("__top"))
    q = placed.join(top, by).withColumn("__q", _inverse_normal((F.col("__rank") + 1) / (F.col("__top") + 2)))
    return with_moments(q, by, "__q").withColumn(to, F.when(F.col("__sd") > 0, F.col("__q") / F.col("__sd")).otherwise(F.lit(0.0))).drop("__mean", "__sd", "__q", "__rank", "__top")


def rectify(vec: Column) -> Column:
    """Negative parts, then positive parts: twice the dimensions."""
    return F.concat(F.transform(vec, lambda x: F.greatest(-x, x * 0)), F.transform(vec, lambda x: F.greatest(x, x * 0)))


def drop_channel(vec: Column, channel: int = 12, size: int | None = None) -> Column:
    """vec without the element at that place; with size, an error where that many aren't left."""
    left = F.filter(vec, lambda x, i: i != channel)
    return left if size is None else F.when(F.size(left) == size, left).otherwise(F.raise_error(F.concat(F.lit(f"not {size} channels left but "), F.size(left))))


def concat_channels(*parts: Column) -> Column:
    return F.concat(*parts)


def select_layers(df: DataFrame, module: str, layers: list[str]) -> DataFrame:
    """Rows of the named layers; an empty list keeps none."""
    return df.where(F.col(module).isin(layers)) if layers else df.where(F.lit(False))


def exploded(df: DataFrame, key: list[str], vec: str) -> DataFrame:
    return df.select(*key, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def similarity(vec: Column, query: list[float], corr: bool = True) -> Column:
    """Pearson correlation with the query (0 where either is constant), or dot product; within the row, no shuffle."""
    q = np.asarray(query, float)
    if not corr:
        return F.aggregate(F.zip_with(vec, F.lit([float(x) for x in q]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    q = q - q.mean()
    n = float(np.sqrt((q * q).sum()))
    mean = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(vec)
    dot = F.aggregate(F.zip_with(vec, F.lit([float(x) for x in q]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) - F.size(vec) * mean * mean
    return F.coalesce(F.try_divide(dot, F.sqrt(F.greatest(square, F.lit(0.0))) * F.lit(n)), F.lit(0.0))


def top_similar(df: DataFrame, key: str, vec: str, query: list[float], n: int = 10, corr: bool = True) -> DataFrame:
    return df.select(key, similarity(F.col(vec), query, corr).alias("score")).orderBy(F.col("score").desc(), key).limit(n)


def top_similar_to(df: DataFrame, key: str, vec: str, word, n: int = 10, corr: bool = True) -> DataFrame:
    """As top_similar, of the vector of that key, itself included."""
    return top_similar(df, key, vec, list(df.where(F.col(key) == word).select(vec).first()[0]), n, corr)


def top_similar_batch(df: DataFrame, key: str, vec: str, queries: dict[int, list[float]], n: int = 10, corr: bool = True) -> DataFrame:
    """Top n for each of some query vectors. Each row scores all queries in place, and tasks keep n a query before they shuffle."""
    scored = df.select(key, F.explode(F.array(*[F.struct(F.lit(q).alias("query"), similarity(F.col(vec), v, corr).alias("score")) for q, v in queries.items()])).alias("s")).select(key, "s.*")
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))).where(F.col("r") <= n)


def blocks_of(df: DataFrame, key: str, vec: str, rows: int) -> DataFrame:
    """df packed into rows of about that many keys (dealt by a hash) with their vectors: keys, vectors."""
    n = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("__b")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("k"), F.col(vec).alias("v"))).alias("__s")).select(F.col("__s.k").alias("keys"), F.col("__s.v").alias("vectors"))


def top_similar_blocks(df: DataFrame, key: str, vec: str, queries: DataFrame, n: int = 10, block: int = 2048) -> DataFrame:
    """Top n of df for each row of queries, of any number: query, key, score (correlation), r.

    Blocks of queries meet blocks of rows in Arrow tasks, a matrix product for each pair, and n a query leave each pair for
    the shuffle. Scores are rounded to 12 places, so that equal vectors tie; ties go by key.
    """

    def scaled(vectors) -> np.ndarray:
        m = np.stack([np.asarray(v, float) for v in vectors])
        m = m - m.mean(1, keepdims=True)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 1e-12)

    def run(parts):
        for part in parts:
            for qk, qv, keys, vectors in zip(part["qkeys"], part["qvectors"], part["keys"], part["vectors"]):
                scores = np.round(scaled(qv) @ scaled(vectors).T, 12) + 0.0
                keys = np.asarray(keys)
                k = min(n, len(keys))
                least = np.partition(scores, len(keys) - k, axis=1)[:, len(keys) - k]
                found = []
                for q, row, low in zip(qk, scores, least):
                    at = np.flatnonzero(row >= low)
                    at = at[np.lexsort((keys[at], -row[at]))[:k]]
                    found.append((np.full(k, q), keys[at], row[at]))
                yield pd.DataFrame({"query": np.concatenate([f[0] for f in found]), key: np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    pairs = blocks_of(queries, key, vec, block).withColumnsRenamed({"keys": "qkeys", "vectors": "qvectors"}).crossJoin(blocks_of(df, key, vec, block))
    scored = pairs.mapInPandas(run, f"query long, {key} long, score double")
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), key))).where(F.col("r") <= n)


def diverse_top(df: DataFrame, key: str, vec: str, query: list[float], n: int, cull: int) -> DataFrame:
    """n keys, each the best by dot product of those left after the cull + 1 nearest (squared L2) to the one before are gone.

    One step after the other by nature: a step is a distributed top-1 and a distributed top-(cull + 1); the driver sees those keys alone.
    """
    picked, gone = [], []
    scored = df.select(key, vec, similarity(F.col(vec), query, corr=False).alias("score"))
    for _ in range(n):
        best = scored.where(~F.col(key).isin(gone)).orderBy(F.col("score").desc(), key).first() if gone else scored.orderBy(F.col("score").desc(), key).first()
        if best is None:
            break
        picked.append((len(picked), best[0], float(best[2])))
        q = F.lit([float(x) for x in best[1]])
        far = F.aggregate(F.zip_with(F.col(vec), q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x)
        left = scored.where(~F.col(key).isin(gone)) if gone else scored
        gone += [r[0] for r in left.select(key, far.alias("d")).orderBy("d", key).limit(cull + 1).collect()]
    return df.sparkSession.createDataFrame(picked, f"place int, {key} long, score double")


def best_worst(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    scored = df.select(key, value.alias("score"))
    best = scored.orderBy(F.col("score").desc(), key).limit(n).withColumn("side", F.lit("best"))
    return best.unionByName(scored.orderBy("score", key).limit(n).withColumn("side", F.lit("worst")))


def rank_band(df: DataFrame, key: str, vec: str, low: int, high: int) -> DataFrame:
    """Keys with low < n - rank of the first feature < high."""
    first = df.select(key, F.col(vec)[0].alias("__x"))
    n = df.count()
    return ranked(first, [], [F.col("__x"), F.col(key)]).where((n - F.col("rank") > low) & (n - F.col("rank") < high)).select(key)


def mean_vectors(df: DataFrame, by: str, vec: str) -> DataFrame:
    """Mean of each dimension in each group."""
    return exploded(df, [by], vec).groupBy(by, "dim").agg(F.avg("x").alias("mean"))


def bag_of_words(df: DataFrame, key: str, token: str, model: DataFrame, word: str, vec: str) -> DataFrame:
    """Mean vector of the words of each text that the model has."""
    return df.join(model.select(F.col(word).alias(token), F.posexplode(vec).alias("dim", "x")), token).groupBy(key, "dim").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
