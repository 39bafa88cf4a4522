"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes an empty table to an empty result, keeps columns that it doesn't know, whatever they are called, and treats
repeated rows as rows like others until exact dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimframe.llm.common import without
from stimframe.llm.exact_dedup import drop_exact_duplicates
from stimframe.llm.minhash_dedup import drop_near_duplicates
from stimframe.llm.mixing import ADDED as MIXED
from stimframe.llm.mixing import mix_sources
from stimframe.llm.quality_rules import clean_documents
from stimframe.llm.queries import MODEL
from stimframe.llm.sentencepiece_codec import encode
from stimframe.session import materialise, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts, or are made of lines common on their host, go; the others lose those lines, counted before any document went. Null and empty texts fail; a null source is a host of its own."""
    return clean_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (a null one counts as empty) the largest doc_id stays; a null id stays only where the group has no other."""
    return drop_exact_duplicates(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the smallest doc_id stays; texts without words are linked with nothing, and stay. Null ids come last."""
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come up to 1.5 times, none less than once. A null source counts as the empty name, an empty text as one token.

    The rows are written in the order of the mix, a range of it in each file: read in order of their files they show the weights all along.
    """
    return mix_sources(docs, max_repeat=1.5).repartitionByRange("mix_at", "mix_epoch").sortWithinPartitions("mix_at", "mix_epoch").drop(*MIXED)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and mix_order, its place in the table that the stage before wrote; decoding them gives the text back. Null and empty texts have no ids.

    A document that comes up again is at another place, and so has its merges skipped elsewhere. Rows that come from no file are numbered as they come.
    """
    rows = without(docs, ["mix_order"])
    try:
        file = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).try_cast("long")
        rows = rows.withColumn("mix_order", F.shiftleft(F.coalesce(file, F.lit(0)), 33) + F.col("_metadata.row_index"))
    except AnalysisException:
        rows = rows.withColumn("mix_order", F.monotonically_increasing_id())
    return encode(rows, MODEL, dropout=0.1, occurrence="mix_order")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't express bisection, sketches or pieces; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as clear:
        for _, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), "stage")
            clear(docs)  # what the stage wrote on its way, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
