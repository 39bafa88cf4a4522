"""Importance resampling: documents drawn by how much likelier their words are in a target than in the corpus."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimframe.llm.common import UPPER, without
from stimframe.operators.rank import ranked
from stimframe.session import materialise

#: A text with more copies than this share of all rows is hot: there are fewer such texts than this number, of 60 bytes each.
HOT = 10_000
ADDED = ("n_features", "weight", "score", "rank")
#: Bytes that are no part of a word (all ASCII but letters and digits) become blanks, A-Z lower case; all others stay.
_FOLD = bytes(b + 32 if chr(b) in UPPER else b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20 for b in range(256))


class _Buckets(dict):
    """Bucket of each feature, kept for a bounded number of them."""

    def __init__(self, buckets: int, bound: int = 200_000):
        super().__init__()
        self.buckets, self.bound = buckets, bound

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        b = self[feature] = zlib.crc32(feature) % self.buckets
        return b


def features(text: bytes, longest: int, buckets: _Buckets) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of all its runs of 1 to `longest` words, repeats included."""
    words = text.translate(_FOLD).split()
    runs = words if longest == 1 else [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), np.fromiter(map(buckets.__getitem__, runs), np.int32, len(runs))


def _featured(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """texts (__text binary, __copies) as __key (digest of the text), __copies, __words and __at (buckets, packed)."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            keys, counts, packed = [], [], []
            for text in batch.column("__text").to_pylist():
                n, at = features(text, longest, known)
                keys.append(hashlib.sha256(text).digest())
                counts.append(n)
                packed.append(at.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("__copies"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["__key", "__copies", "__words", "__at"])

    return texts.mapInArrow(run, "__key binary, __copies long, __words long, __at binary")


def _flat(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch of packed rows, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, a text's as often as it has copies. The driver gets one number for each bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            at, sizes = _flat(batch.column("__at"), kind)
            copies = np.repeat(batch.column("__copies").to_numpy(), sizes)
            for c in np.unique(copies).tolist():
                sums += c * np.bincount(at[copies == c], minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found], pa.int64())], names=["at", "n"])

    out = np.zeros(buckets, np.int64)
    for r in featured.select("__copies", "__at").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target over that in the corpus, one feature added to each bucket."""
    n, t, s = len(corpus), int(target.sum()), int(corpus.sum())
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (float(s) + n) / ((float(b) + 1) * (float(t) + n)))) for a, b in zip(target.tolist(), corpus.tolist())], np.int64)


def _weighed(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """featured as __key, __copies, __words, n_features and weight."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    held = featured.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = _flat(batch.column("__at"), kind)
            sums = np.concatenate(([0], np.cumsum(held.value[at])))
            ends = np.cumsum(sizes)
            weight = sums[ends] - sums[ends - sizes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__key", "__copies", "__words")), pa.array(sizes), pa.array(weight, pa.int64())], names=["__key", "__copies", "__words", "n_features", "weight"])

    return featured.mapInArrow(run, "__key binary, __copies long, __words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 * g) of a Gumbel variate g keyed by seed and id; a null id counts as the empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, carry: list[str] | None = None) -> DataFrame:
    """All rows of docs with n_features, weight, score and rank; rank (from 1) is null for rows that aren't drawn.

    Features are the runs of 1 to `longest` words (letters, digits and all beyond ASCII; A-Z lower-cased), hashed to buckets. A bucket's gain
    compares its share in target (a table with the same text column) and in docs; weight sums the gains of a document, and score adds
    Gumbel noise keyed by its id. Of the N documents with at least min_words words, the percent * N // 100 with the highest scores are
    drawn, without replacement; ties go to the smaller id.

    Equal texts are grouped by the whole text, counted in the tasks that read them before they move; features and weights are made once
    for each text, and its features count as often as it has copies. Weights go back to the rows by the digest of their texts. Texts
    with more copies than one HOT-th of all rows (fewer than HOT of them) go by broadcast, their rows take no part in the shuffle by digest
    but under keys of their own; so no task gets more than one HOT-th of the rows for one text. The driver holds the sums of the buckets alone.

    A null text counts as empty, without features and with weight 0; a null id comes after all others among ties; repeated rows and
    rows of one id are rows like others, each with a rank of its own; an empty table gives an empty result, an empty target one where rare buckets weigh
    most. Columns with an added name are replaced; carry names the columns to return if not all are wanted.
    """
    rows = without(docs, [*ADDED, "__key", "__copies", "__words", "__text", "__at", "__hot", "__rank", "__join"])
    names = carry or rows.columns
    whole = lambda df: F.coalesce(df[text_col], F.lit(""))
    texts = lambda df: df.select(whole(df).alias("__text")).groupBy("__text").agg(F.count(F.lit(1)).alias("__copies")).select(F.col("__text").cast("binary"), "__copies")
    featured = materialise(_featured(texts(rows), longest, buckets), "features")
    gain = gains(bucket_counts(_featured(texts(target), longest, buckets), buckets), bucket_counts(featured, buckets))
    weighed = materialise(_weighed(featured, gain), "weights")
    total = weighed.agg(F.sum("__copies")).first()[0] or 0
    of_text = F.struct("__words", "n_features", "weight")
    hot = weighed.where(F.col("__copies") * HOT > total).select("__key", of_text.alias("__hot"))
    # A hot row's key has fewer bytes than a digest, and so matches none.
    apart = F.monotonically_increasing_id().cast("string").cast("binary")
    keyed = rows.select(*[F.col(f"`{n}`") for n in names], F.unhex(F.sha2(whole(rows).cast("binary"), 256)).alias("__key")).join(F.broadcast(hot), "__key", "left")
    joined = keyed.withColumn("__join", F.when(F.col("__hot").isNull(), F.col("__key")).otherwise(apart)).join(weighed.select(F.col("__key").alias("__join"), of_text.alias("__cold")), "__join", "left")
    of = F.coalesce("__hot", "__cold")
    scored = joined.select(*[F.col(f"`{n}`") for n in names], of["__words"].alias("__words"), of["n_features"].alias("n_features"), of["weight"].alias("weight")).withColumn("score", F.col("weight") + noise(id_col, seed))
    scored = materialise(scored, "scores")
    enough = F.col("__words") >= min_words
    drawn = percent * scored.where(enough).count() // 100
    order = [F.desc("score"), F.col(id_col).asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = ranked(scored.where(enough), [], order, "__rank").withColumn("rank", F.when(F.col("__rank") < drawn, F.col("__rank") + 1))
    out = [*[f"`{n}`" for n in names], *ADDED]
    return placed.select(*out).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")).select(*out))
