"""Operators over all rows in blocks, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stimframe.operators import vectors
from stimframe.operators.extract import extract, extract_series
from stimframe.plans.catalogue import QUERIES, table

DIR = "/root/testdata/sf0.001"


def test_top_of_every_twentieth_vector(spark):
    rows = sorted((r.vec_id, r.embedding) for r in table(spark, DIR, "embeddings").collect())
    ids = np.array([i for i, _ in rows])
    corr = np.round(np.corrcoef(np.array([v for _, v in rows], float)), 12)
    want = {}
    for k, i in enumerate(ids):
        if i % 20 == 0:
            want[i] = ids[np.lexsort((ids, -corr[k]))[:10]].tolist()
    e = table(spark, DIR, "embeddings")
    for found in (QUERIES["topk_batch_all"](spark, DIR), vectors.top_similar_blocks(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 10, 7)):
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.query, r.r)):
            got.setdefault(r.query, []).append(r.vec_id)
        assert got == want and len(got) == sum(ids % 20 == 0)


def test_bag_of_all_words(spark):
    labels = {r.label for r in table(spark, DIR, "embeddings").select("label").distinct().collect()}
    n = table(spark, DIR, "events").where((F.col("event_id") % 12).isin(sorted(labels))).count()
    assert QUERIES["bag_of_words_all"](spark, DIR).where("dim = 0").agg(F.sum("n")).first()[0] == n


@pytest.mark.parametrize("feature", ["fbank", "mfcc", "lld"])
def test_blocks_of_frames_are_those_of_the_whole_waveform(spark, feature):
    """Series of any length, among them those that end at the edge of a block."""
    g = np.random.default_rng(1)
    values = {str(n): g.normal(size=n).astype(np.float32) for n in (1, 2, 3, 6, 7, 13, 14, 15, 16, 22, 29, 43, 44, 45, 46, 100)}
    waves = spark.createDataFrame([(s, 16_000, np.repeat(v, 160).tolist()) for s, v in values.items()], "stim string, sample_rate int, waveform array<float>")
    series = spark.createDataFrame([(s, i, float(x)) for s, v in values.items() for i, x in enumerate(v)], "stim string, i long, value double").repartition(3)
    want = {(r.stim, r.frame): r.features for r in extract(waves, feature).collect()}
    for block in (7, 2048):
        got = {(r.stim, r.frame): r.features for r in extract_series(series, feature, 160, block=block).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-7) for k in want)
