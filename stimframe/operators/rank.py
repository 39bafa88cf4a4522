"""Ranks over large groups without a task for each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimframe.session import materialise


def ranked(df: DataFrame, by: list[str], order: list[Column], to: str = "rank") -> DataFrame:
    """df with the 0-based place of each row in its group, in an order that must be total.

    Rows are range-partitioned by group and order, so that a large group spans partitions; each partition numbers its own
    rows as it sorts them, and the rows of the group in earlier partitions are added: one exchange, and a join with a row for
    each partition and group. With by=[] the whole table is one group.
    """
    sorts = [*[F.col(b) for b in by], *order]
    dealt = df.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumn("__id", F.monotonically_increasing_id())
    # Written once: a second evaluation might draw other splitters and so other partitions. The id has the partition above 33 bits.
    held = materialise(dealt, "ranked").withColumn("__pid", F.shiftright("__id", 33))
    sizes = held.groupBy("__pid", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__of_{c}" for c in ["__pid", *by]}
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).drop("__n", "__first").withColumnsRenamed(names)
    on = _same(names)
    return held.join(before, on).withColumn(to, F.col("__id") + F.col("__before")).select(*df.columns, to)


def _same(names: dict[str, str]) -> Column:
    on = F.lit(True)
    for c, other in names.items():
        on = on & F.col(c).eqNullSafe(F.col(other))
    return on


def quantiles(df: DataFrame, by: list[str], value: str, points: Sequence[float], to: str = "q") -> DataFrame:
    """(by, to): the interpolated quantiles of each group as an array, from ranks, so that no task holds a group's values.

    Rows with a NULL value don't count; a group of such rows alone has NULLs.
    """
    held = ranked(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")), by, [F.col("__v")], "__rank")
    names = {b: f"__of_{b}" for b in by}
    n = held.groupBy(*by).agg(F.max("__rank").alias("__last")).withColumnsRenamed(names)
    place = {k: F.col("__last") * F.lit(float(p)) for k, p in enumerate(points)}
    wanted = F.lit(False)
    for h in place.values():
        wanted = wanted | (F.col("__rank") == F.floor(h)) | (F.col("__rank") == F.ceil(h))
    ends = [F.max(F.when(F.col("__rank") == end(h), F.col("__v"))).alias(f"__{name}{k}") for k, h in place.items() for name, end in (("lo", F.floor), ("hi", F.ceil))]
    found = held.join(n, _same(names)).where(wanted).groupBy(*by).agg(F.max("__last").alias("__last"), *ends)
    q = F.array(*[F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * (h - F.floor(h)) for k, h in place.items()])
    every = df.select(*by).distinct()
    return every.join(found.select(*[F.col(b).alias(names[b]) for b in by], q.alias(to)), _same(names), "left").select(*by, to)
