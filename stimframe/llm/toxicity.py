"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import without
from stimframe.llm.shingles import WordHashes
from stimframe.session import materialise

#: Weights are hashed to 2**BITS places. At most about BOUND labelled rows of BYTES in all train, EPOCHS times.
BITS, BOUND, BYTES, EPOCHS = 20, 16_000, 1 << 28, 3
#: FTRL-proximal: rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
ADDED = ("score", "predicted")
_TRIM = b".,;:!?\"'()[]{}<>|*_-"
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Words(WordHashes):
    def __missing__(self, word: bytes) -> int:
        h = super().__missing__(word.strip(_TRIM) or word)
        if len(word) <= self.longest:
            self[word] = h
        return h


def features(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Places of the distinct words, pairs, and pairs with one or two words skipped, of the whole text in lower case; place 0 is the bias."""
    words = (text or b"").lower().split()
    h = hashes.of(words)
    spread = [(h * _KINDS[0])]
    for gap in (1, 2, 3):
        if len(h) > gap:
            spread.append((h[:-gap] * _KINDS[gap]) ^ (h[gap:] * _KINDS[0] >> np.uint64(1)))
    mixed = np.concatenate(spread)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.append(np.unique(np.maximum(mixed >> np.uint64(64 - BITS), np.uint64(1))), np.uint64(0)).astype(np.int64)


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights from the rows in order of a hash, EPOCHS times."""
    hashes, rows = _Words(), rows.sort_values(["h", "of"])
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    every = [(features(t, hashes), y) for t, y in zip(rows.text, rows.toxic)]
    for _ in range(EPOCHS):
        for x, y in every:
            w = _weights(z[x], n[x])
            w[-1] = -z[0] / ((BETA + np.sqrt(n[0])) / ALPHA)  # the bias isn't held down
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[x])
            n[x] += g * g
            z[x] += g - (np.sqrt(n[x]) - root) / ALPHA * w
    w = _weights(z, n)
    w[0] = -z[0] / ((BETA + np.sqrt(n[0])) / ALPHA)
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": at, "w": w[at]})


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", bound: int = BOUND, bound_bytes: int = BYTES) -> dict[int, float]:
    """The weights that aren't 0, from at most about `bound` of the rows of docs that have a label 0 or 1, and `bound_bytes` of their texts.

    Rows are picked by hashes of the id, and, where ids have many texts or long ones, of id and text. FTRL goes from row to row, so one task trains on this bounded sample (parts of it
    trained apart and averaged found fewer toxic texts). The result has at most 2**BITS places, with L1 about a
    thousand. An id with both labels counts as toxic; null ids have no label; a null text counts as empty; rows of one id and text count
    once, and are put together in the tasks that read them. Without labelled rows, as with an empty table on either side, the result is empty.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("double")).alias("toxic"))
    share = min(1.0, bound / max(known.count(), 1))
    known = known.withColumn("h", F.xxhash64("__id", F.lit(1))).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(known), "__id")  # the labels of about `bound` ids
    rows = materialise(texts.groupBy("__id", F.xxhash64("text", F.lit(2)).alias("of")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"), F.first("h").alias("h")), "labelled")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(1.0, bound / max(size.n, 1), bound_bytes / max(size.bytes or 0, 1))
    rows = rows.where(F.pmod(F.xxhash64("h", "of"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return {r.at: r.w for r in rows.groupBy(F.lit(0).alias("part")).applyInPandas(lambda r: _fit(r), "at long, w double").collect()}


def score_toxicity(docs: DataFrame, weights: dict[int, float], text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on).

    Every row gets a score: an empty or null text that of the bias alone. With no weights all scores are 0.5 less a
    trifle, so that nothing is called toxic. Repeated rows get equal scores; an empty table gives an empty result. Columns with an added name are replaced. No shuffle.
    """
    at = np.fromiter(weights, np.int64, len(weights))
    held = docs.sparkSession.sparkContext.broadcast((at, np.fromiter(weights.values(), np.float64, len(weights))))

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes, dense = _Words(), np.zeros(1 << BITS)
        dense[held.value[0]] = held.value[1]
        if not len(held.value[0]):
            dense[0] = -1e-6
        for texts in parts:
            total = np.array([dense[features(t, hashes)].sum() for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return without(docs, ADDED).withColumn("score", run(F.col(text_col).cast("binary"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
