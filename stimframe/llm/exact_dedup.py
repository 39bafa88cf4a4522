"""Exact dedup by content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.llm.common import lower_ascii, without
from stimframe.session import materialise

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest", prefix: int = 16, carry: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Mark exact copies: all rows and columns of docs, and keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z. Spark samples splitters and range-partitions the rows by
    (first `prefix` characters, SHA-256, id) of the normalised text, each partition is sorted externally in that order,
    and every row is compared in full with its neighbour: a run of equal neighbours is a group.
    The splitters hold a short prefix, a digest and a number, so what the driver samples doesn't grow with the length of texts;
    the id as the last key lets a group with a third of all rows span many partitions. Past the prefix the order is that of the digest,
    not of the characters; all rows of a text follow each other, over as many partitions as they fill. Runs that touch a partition's edge
    are summed by digest, at most two for each partition, and their rows get the sums by (partition, digest).

    keep is "smallest" or "largest": the row of a group with that id stays, and of several rows with it only one.
    Null text counts as empty, a null id comes after all others and stays only if the whole group has no id.
    carry names the columns to return if not all are wanted; with only_kept the rows that don't stay are left out, and never held. Columns of docs that bear an added name are replaced. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    own = {"__norm", "__prefix", "__hash", "__edge", "__pid", "__text"}
    rows = without(docs, [*ADDED, *own])
    names = carry or rows.columns
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    order = F.col(id_col).asc_nulls_last() if keep == "smallest" else F.col(id_col).desc_nulls_last()
    # Each text moves once; what is compared is made again after that.
    dealt = (
        rows.select(*[F.col(f"`{n}`") for n in names], *([] if text_col in names else [F.col(text_col).alias("__text")]), F.substring(norm, 1, prefix).alias("__prefix"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("__hash"))
        .repartitionByRange("__prefix", "__hash", order)
        .withColumn("__norm", lower_ascii(F.coalesce(F.col(text_col if text_col in names else "__text"), F.lit(""))))
        .withColumn("text_sha256", F.lower(F.hex("__hash")))
        .sortWithinPartitions("__prefix", "__hash", order)
        .select(*[F.col(f"`{n}`") for n in names], "__norm", "text_sha256")
    )
    id_type = rows.schema[id_col].dataType
    out = T.StructType(
        [*[rows.schema[n] for n in names], T.StructField("text_sha256", T.StringType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType())]
        + [T.StructField("kept", T.BooleanType()), T.StructField("__edge", T.BooleanType()), T.StructField("__pid", T.IntegerType())]
    )
    runs = materialise(dealt.mapInArrow(_mark_runs(id_col, only_kept), T.StructType([T.StructField(f.name, f.dataType, True) for f in out])), "exact-runs")
    heads = runs.where("__edge and kept").select("text_sha256", "__pid", "group_size", F.col(id_col).alias("__keep"))
    at_edges = heads.groupBy("text_sha256").agg(F.sum("group_size").alias("__size"), F.min_by("__keep", "__pid").alias("__keep"), F.min("__pid").alias("__first"))
    # By partition too, so that a group with most rows is no single key where there are too many partitions to broadcast this.
    at_edges = materialise(heads.select("text_sha256", "__pid").distinct().join(at_edges, "text_sha256"), "exact-edges")
    inner = runs.where("not __edge").select(*names, *ADDED)
    edge = runs.where("__edge").join(at_edges, ["__pid", "text_sha256"]).select(
        *[F.col(f"`{n}`") for n in names],
        F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("kept") & (F.col("__pid") == F.col("__first"))).alias("kept"), "text_sha256",
    )
    return inner.unionByName(edge)


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """docs without the rows that exact_dedup() wouldn't keep; the columns of docs."""
    aside = {c: f"__own_{c}" for c in docs.columns if c.lower() in ADDED}
    marked = exact_dedup(docs.withColumnsRenamed(aside), text_col, id_col, keep, only_kept=True)
    return marked.where("kept").drop(*ADDED).withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])


def _mark_runs(id_col: str, only_kept: bool):
    """For mapInArrow over sorted rows: the size and first id of each run of equal __norm.

    A run is held until it ends, and so never more than a partition; with only_kept no more than its first row.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, held, at_start, extra = TaskContext.get().partitionId(), None, [], True, 0  # extra: rows of the run that aren't held

        def hold(b: pa.RecordBatch) -> None:
            nonlocal extra
            if only_kept and held:
                extra += b.num_rows
            else:
                held.append(b.slice(0, 1) if only_kept else b)
                extra += b.num_rows - held[-1].num_rows

        def emit(edge: bool) -> Iterator[pa.RecordBatch]:
            """The run that is held, whole."""
            nonlocal extra
            size, first = extra + sum(b.num_rows for b in held), held[0].column(id_col)[0]
            extra = 0
            for i, b in enumerate(held):
                yield finish(b, pa.repeat(first, b.num_rows), pa.repeat(pa.scalar(size, pa.int64()), b.num_rows), pa.array([i == 0 and j == 0 for j in range(b.num_rows)]), pa.repeat(pa.scalar(edge), b.num_rows))

        def finish(b: pa.RecordBatch, first: pa.Array, size: pa.Array, kept: pa.Array, edge: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*b.columns, first.cast(b.column(id_col).type), size, kept, edge, pa.repeat(pa.scalar(pid, pa.int32()), b.num_rows)],
                names=[*b.schema.names, "keep_id", "group_size", "kept", "__edge", "__pid"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            norm = batch.column("__norm")
            inside = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
            starts = [i + 1 for i in inside.nonzero()[0].tolist()]
            rest = batch.drop_columns(["__norm"])
            if last is None or norm[0].as_py() != last:
                starts = [0, *starts]
            last = norm[len(norm) - 1].as_py()
            if not starts:
                hold(rest)
                continue
            if starts[0]:
                hold(rest.slice(0, starts[0]))
            if held:
                yield from emit(at_start)
                held.clear()
                at_start = False
            # Whole runs inside this batch go out together; the last one may go on.
            if len(starts) > 1:
                if at_start:
                    hold(rest.slice(starts[0], starts[1] - starts[0]))
                    yield from emit(True)
                    held.clear()
                    at_start, starts = False, starts[1:]
            if len(starts) > 1:
                lens = [b - a for a, b in zip(starts, starts[1:])]
                run = pa.array([k for k, n in enumerate(lens) for _ in range(n)], pa.int32())
                part = rest.slice(starts[0], starts[-1] - starts[0])
                heads = pa.array([a - starts[0] for a in starts[:-1]], pa.int32())
                kept = pa.array([j == 0 for n in lens for j in range(n)])
                if only_kept:
                    yield finish(part.take(heads), part.column(id_col).take(heads), pa.array(lens, pa.int64()), pa.repeat(pa.scalar(True), len(lens)), pa.repeat(pa.scalar(False), len(lens)))
                else:
                    yield finish(part, part.column(id_col).take(heads).take(run), pa.array(lens, pa.int64()).take(run), kept, pa.repeat(pa.scalar(False), part.num_rows))
            held.clear()
            hold(rest.slice(starts[-1]))
        if held:
            yield from emit(True)

    return mark
