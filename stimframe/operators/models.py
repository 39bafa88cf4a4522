"""Linear models from one distributed pass for the Gram matrix, and classifiers of pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: More folds than a repeat has.
FOLDS = 1000
#: Products of vectors of so many dimensions are written out.
UNROLLED = 16


#: Rows of a matrix of sums that go as one piece; bytes of matrices that a task holds before it sends them.
PIECE, HELD = 64, 1 << 28


def _numbers(col: pa.Array, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def gram(df: DataFrame, features: str, targets: str | None = None, fold: str | Sequence[str] | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """Sums of products of the row (features, targets, 1), by fold: n and a matrix of (d + t + 1) squared.

    Each task sums its own rows, so what moves is one matrix for each task and fold, whatever the number of rows, in pieces of PIECE rows of the matrix that are
    added up over Arrow; the driver gets the sums. With several fold columns, for repeated folds, all are summed in the same pass, under the numbers repeat * FOLDS + fold.
    """
    folds = [fold] if isinstance(fold, str) else list(fold or [])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            m = np.column_stack([_numbers(b.column("x"), b.num_rows), *([_numbers(b.column("y"), b.num_rows)] if targets else []), np.ones(b.num_rows)])
            for r, of in enumerate(_numbers(b.column("folds"), b.num_rows).T.astype(int)):
                for k in np.unique(of).tolist():
                    part = m[of == k]
                    if (r * FOLDS + k) in total:
                        total[r * FOLDS + k] += part.T @ part
                    else:
                        total[r * FOLDS + k] = part.T @ part
        for k, g in total.items():
            for at in range(0, len(g), PIECE):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([g[at : at + PIECE].tobytes()], pa.binary())], names=["fold", "at", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, at, m in zip(*(b.column(c).to_pylist() for c in ("fold", "at", "m"))):
                x = np.frombuffer(m, float)
                sums[k, at] = sums[k, at] + x if (k, at) in sums else x
        for (k, at), x in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["fold", "at", "m"])

    rows = df.select(
        F.col(features).cast("array<double>").alias("x"), (F.col(targets).cast("array<double>") if targets else F.array(F.lit(0.0))).alias("y"),
        F.array(*[F.col(f).cast("double") for f in folds] or [F.lit(0.0)]).alias("folds"),
    )
    schema = "fold int, at int, m binary"
    pieces: dict[int, dict[int, np.ndarray]] = {}
    for r in rows.mapInArrow(partial, schema).repartition("fold", "at").mapInArrow(add, schema).collect():
        pieces.setdefault(r.fold, {})[r["at"]] = np.frombuffer(r.m, float)
    found = {}
    for k, parts in pieces.items():
        flat = np.concatenate([parts[at] for at in sorted(parts)])
        d = round(len(flat) ** 0.5)
        g = flat.reshape(d, d)
        found[k] = (round(g[-1, -1]), g)
    return found


def lstsq(df: DataFrame, features: str, targets: str, dims: int) -> np.ndarray:
    """Weights (dims, targets) of minimum norm, without intercept or scaling."""
    (_, g), *_ = gram(df, features, targets).values()
    return np.linalg.pinv(g[:dims, :dims], hermitian=True) @ g[:dims, dims:-1]


def solved_by(df: DataFrame, by: str, features: str, targets: str, dims: int, n_targets: int = 1, alpha: float | None = None, scale: bool = True) -> DataFrame:
    """(by, weights) of a model for each group, the weights as an array by dimension of arrays by target.

    Least squares of minimum norm without intercept, or with alpha ridge with one, on z-scored features or (scale=False) centred ones. Each task sums the products of its
    rows in a matrix for each group, and sends them when it holds HELD bytes; a group's matrices are added up and solved one after the other, so that any number of groups and rows will do, and
    groups of as many dimensions as a matrix in a row holds.
    """
    size = dims + n_targets + 1
    out = T.StructType([df.schema[by], T.StructField("weights", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def row(key, g: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([g.tobytes()], pa.binary())], names=[by, "m"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = {}, None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(by).type
            m = np.column_stack([_numbers(b.column("x"), b.num_rows)[:, :dims], _numbers(b.column("y"), b.num_rows)[:, :n_targets], np.ones(b.num_rows)])
            codes = b.column(by).dictionary_encode("encode")
            keys, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                key, x = keys[of[part[0]]], m[part]
                total[key] = total[key] + x.T @ x if key in total else x.T @ x
                if len(total) * size * size * 8 > HELD:
                    for k, g in total.items():
                        yield row(k, g, kind)
                    total = {}
        for k, g in total.items():
            yield row(k, g, kind)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> pa.RecordBatch:
            g = total.reshape(size, size)
            w = np.linalg.pinv(g[:dims, :dims], hermitian=True) @ g[:dims, dims:-1] if alpha is None else _ridge(g, dims, alpha, scale)[0]
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([w.tolist()], pa.list_(pa.list_(pa.float64())))], names=[by, "weights"])

        key, total, kind = None, None, None
        for b in batches:  # in order of the groups
            kind = b.column(by).type
            for k, m in zip(b.column(by).to_pylist(), b.column("m").to_pylist()):
                if total is not None and k != key:
                    yield solved()
                    total = None
                key, total = k, np.frombuffer(m, float) + (0 if total is None else total)
        if total is not None:
            yield solved()

    rows = df.select(by, F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"))
    sums = rows.mapInArrow(partial, T.StructType([df.schema[by], T.StructField("m", T.BinaryType())]))
    return sums.repartition(by).sortWithinPartitions(by).mapInArrow(solve, out)


def predict(df: DataFrame, features: str, weights: np.ndarray, to: str = "pred", offset: np.ndarray | None = None) -> DataFrame:
    """df with the product of the features and the weights, in built-in functions."""
    offset = np.zeros(weights.shape[1]) if offset is None else offset
    if len(weights) <= UNROLLED:  # as one expression that the code generator takes
        x = [F.get(features, F.lit(i)).cast("double") for i in range(len(weights))]
        return df.withColumn(to, F.array(*[sum((a * F.lit(float(b)) for a, b in zip(x, w)), F.lit(float(o))) for w, o in zip(weights.T, offset)]))
    cols = [F.aggregate(F.zip_with(F.col(features), F.lit([float(x) for x in w]), lambda a, b: a.cast("double") * b), F.lit(float(o)), lambda a, x: a + x) for w, o in zip(weights.T, offset)]
    return df.withColumn(to, F.array(*cols))


def residuals(df: DataFrame, pred: str, true: str, to: str = "residual") -> DataFrame:
    """Predicted minus true, element by element."""
    return df.withColumn(to, F.zip_with(F.col(pred), F.col(true), lambda p, t: p - t.cast("double")))


def _ridge(g: np.ndarray, dims: int, alpha: float, scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offset in the units of the features: ridge on z-scored features, from sums of products."""
    n = g[-1, -1]
    mean = g[-1, :-1] / n
    cov = g[:-1, :-1] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:dims] / n, 0))
    sd[(sd < 1e-12) | (not scale)] = 1
    w = np.linalg.solve(cov[:dims, :dims] / np.outer(sd, sd) + alpha * np.eye(dims), cov[:dims, dims:] / sd[:, None]) / sd[:, None]
    return w, mean[dims:] - mean[:dims] @ w


def ridge_cv(df: DataFrame, features: str, targets: str, dims: int, fold: str | Sequence[str], alphas: np.ndarray | None = None) -> dict:
    """One alpha for all targets, by the mean over folds and targets of held-out R2; weights and offset refitted on all rows.

    fold is a column of folds, or several for repeated folds (see repeated_folds()), over all of which the mean is taken.

    Features are z-scored. All folds and alphas are solved from one pass: the training sums of a fold are all less its own.
    """
    alphas = np.logspace(-5, 2, 10) if alphas is None else alphas
    parts = gram(df, features, targets, fold)
    total = sum(g for k, (_, g) in parts.items() if k < FOLDS)
    scores = []
    for a in alphas:
        r2 = []
        for n, g in parts.values():
            w, o = _ridge(total - g, dims, a)
            xx, xy, sx = g[:dims, :dims], g[:dims, dims:-1], g[-1, :dims]
            yy, sy = np.diag(g)[dims:-1], g[-1, dims:-1]
            sse = yy - 2 * (np.sum(w * xy, 0) + o * sy) + np.einsum("dt,de,et->t", w, xx, w) + 2 * o * (sx @ w) + n * o * o
            r2.append(np.mean(1 - sse / (yy - sy * sy / n)))
        scores.append(float(np.mean(r2)))
    best = int(np.argmax(scores))
    w, o = _ridge(total, dims, alphas[best])
    return {"alpha": float(alphas[best]), "scores": scores, "weights": w, "offset": o}


def fold_of(df: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    """Even folds of the distinct keys: the place in a hash order, modulo k. Keys are stimuli, few against the rows."""
    from stimframe.operators.rank import ranked

    placed = ranked(df.select(key).distinct(), [], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)])
    return placed.select(key, (F.col("rank") % k).cast("int").alias("fold"))


def repeated_folds(df: DataFrame, key: str, k: int = 5, repeats: int = 3, seed: int = 1) -> DataFrame:
    """fold_of() for each repeat, with seeds of their own: columns fold0, fold1 and so on, for ridge_cv()."""
    out = fold_of(df, key, k, seed).withColumnRenamed("fold", "fold0")
    for r in range(1, repeats):
        out = out.join(fold_of(df, key, k, seed + r).withColumnRenamed("fold", f"fold{r}"), key)
    return out


def split_keys(df: DataFrame, key: str, splits: int = 5, train: float = 0.8, val: float = 0.0, seed: int = 0) -> DataFrame:
    """For each split every key as train, val or test: floors of the shares of a keyed hash order, the rest is test."""
    from stimframe.operators.rank import ranked

    keys = df.select(key).distinct()
    n = keys.count()
    each = keys.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    placed = ranked(each, ["split"], [F.xxhash64(F.lit(seed), F.col("split"), F.col(key)), F.col(key)])
    a, b = int(n * train), int(n * train) + int(n * val)
    return placed.select("split", key, F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "val").otherwise("test").alias("role"))


def take_role(df: DataFrame, splits: DataFrame, key: str, split: int, role: str) -> DataFrame:
    return df.join(splits.where((F.col("split") == split) & (F.col("role") == role)), key, "left_semi")


def pca(df: DataFrame, features: str, dims: int, k: int = 13) -> dict:
    """Mean, population SD, components (dims, k; the largest loading of each is positive) and explained-variance ratio of z-scored features."""
    (n, g), *_ = gram(df, features).values()
    g = np.delete(np.delete(g, dims, 0), dims, 1) if g.shape[0] == dims + 2 else g
    mean = g[-1, :dims] / n
    cov = g[:dims, :dims] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])
    return {"mean": mean, "sd": sd, "components": v, "ratio": values[order] / values.sum()}


def pca_transform(df: DataFrame, features: str, model: dict, to: str = "scores") -> DataFrame:
    w = model["components"] / model["sd"][:, None]
    return predict(df, features, w, to, -(model["mean"] @ w))


def svd_reduce(df: DataFrame, features: str, dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Uncentred singular values and right vectors; the projection of a row on the vectors is its reduced form."""
    (_, g), *_ = gram(df, features).values()
    values, vectors = np.linalg.eigh(g[:dims, :dims])
    order = np.argsort(values)[::-1][:k]
    v = vectors[:, order]
    return np.sqrt(np.maximum(values[order], 0)), v * np.sign(v[np.abs(v).argmax(0), range(v.shape[1])])


def logistic(df: DataFrame, features: str, label: Column, max_iter: int = 1000, c: float = 1.0):
    """Multiclass logistic model on z-scored features (population SD), with the penalty of C."""
    n = df.count()
    long = df.select(F.posexplode(features).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("d").collect()
    mean, sd = [float(r.m) for r in long], [float(r.s) or 1.0 for r in long]
    scaled = lambda d: d.withColumn("__z", array_to_vector(F.zip_with(F.zip_with(F.col(features), F.lit(mean), lambda x, m: x.cast("double") - m), F.lit(sd), lambda x, s: x / s)))
    fit = LogisticRegression(featuresCol="__z", labelCol="__y", maxIter=max_iter, regParam=1 / (c * n), standardization=False, tol=1e-9, family="auto").fit(scaled(df).withColumn("__y", label.cast("double")))
    return lambda d: fit.transform(scaled(d)).withColumn("pred", F.col("prediction").cast("int")).withColumn("proba", vector_to_array("probability")).drop("__z", "rawPrediction", "probability", "prediction")


def multilabel(df: DataFrame, features: str, labels: list[str]):
    """An independent classifier for each label column with a positive row; returns those kept and the functions that add pred_<label>."""
    sums = df.agg(*[F.sum(c).alias(c) for c in labels]).first()
    kept = [c for c in labels if (sums[c] or 0) > 0]
    fits = {c: logistic(df, features, F.col(c)) for c in kept}

    def add(d: DataFrame) -> DataFrame:
        for c, f in fits.items():
            d = f(d).withColumnRenamed("pred", f"pred_{c}").drop("proba")
        return d

    return kept, add
