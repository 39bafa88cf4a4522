"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six white-space characters of the contracts' word pattern.
SPACE = " \t\n\x0b\f\r"
#: The letters that lower-casing touches; others stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of these names in any case, so that an operator may add its own."""
    names = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def words(text: Column) -> Column:
    """Array of the maximal runs of other than white space; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def fenced(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with these columns behind a generator of one row, at the end.

    A later filter on them then runs on their values. Without the fence the optimizer would put their whole expressions,
    nested in each other, into the filter.
    """
    names = list(names)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
