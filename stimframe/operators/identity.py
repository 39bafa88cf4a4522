"""Annotation tokens: normalisation, vocabularies, multi-hot and class targets, key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stimframe.operators.rank import ranked

#: Tokens that are noises or marks, not speech.
NOISE = ("{IG}", "{CG}", "{NS}", "SP\x7f", "BR ", "BR", "LS", "NS", "SP", "BRLS", "AH0V", "", " ")
#: The articulatory attributes of phones, in the order of their targets.
ARTICULATIONS = (
    "bilabial", "postalveolar", "alveolar", "dental", "labiodental", "velar", "glottal", "palatal", "plosive", "affricative", "fricative",
    "nasal", "lateral", "approximant", "voiced", "unvoiced", "low", "mid", "high", "front", "central", "back",
)


def normalize_token(token: Column) -> Column:
    """Upper case, without digits at either end and without outer spaces."""
    return F.trim(F.regexp_replace(F.upper(token), "^[0-9]+|[0-9]+$", ""))


def drop_noise(df: DataFrame, token: str, noise: tuple[str, ...] = NOISE) -> DataFrame:
    return df.where(~F.trim(F.col(token)).isin(*[n.strip() for n in noise]))


def build_vocabulary(df: DataFrame, token: str, order: list[str]) -> DataFrame:
    """Dense 0-based index of each token by where it is first seen."""
    first = df.where(F.col(token).isNotNull()).groupBy(F.col(token).alias("token")).agg(F.min(F.struct(*order)).alias("__first"))
    return ranked(first, [], [F.col("__first"), F.col("token")], "idx").select("token", F.col("idx").cast("int").alias("idx"))


def encode_tokens(df: DataFrame, vocabulary: DataFrame, token: str) -> DataFrame:
    """df with idx; rows whose token isn't in the vocabulary are dropped."""
    return df.withColumn("token", F.trim(F.col(token))).join(vocabulary, "token")


def attributes_of(df: DataFrame, attributes: DataFrame, token: str) -> DataFrame:
    """df with attrs, the attribute list of the token; an unknown token has one empty attribute."""
    return df.join(attributes.select(F.col("token").alias(token), "attrs"), token, "left").withColumn("attrs", F.coalesce("attrs", F.array(F.lit(""))))


def multi_hot(attrs: Column, vocabulary: Sequence[str] = ARTICULATIONS) -> Column:
    return F.array(*[F.array_contains(attrs, v).cast("int") for v in vocabulary])


def argmax(target: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(target, F.array_max(target)) - 1).cast("int")


def nonzero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: its sum, and whether a multilabel fit keeps it."""
    sums = df.agg(*[F.sum(c).cast("double").alias(c) for c in columns])
    return sums.unpivot([], columns, "target", "total").withColumn("kept", F.coalesce(F.col("total") > 0, F.lit(False)))


def name_key(path: Column) -> Column:
    """Stimulus of a file: its stem up to the first underscore."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.split_part(stem, F.lit("_"), F.lit(1))


def path_part(path: Column, place: int) -> Column:
    """The part of a path at a place, counted from 1, or from -1 at the end; NULL if it has fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(place))


def key_completeness(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys both sides have, or one alone; a cache is usable if the last two are 0."""
    a, b = left.select(key).distinct().withColumn("__a", F.lit(1)), right.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), F.count_if(F.col("__b").isNull()).alias("n_left_only"), F.count_if(F.col("__a").isNull()).alias("n_right_only")
    )
