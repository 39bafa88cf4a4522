"""Sequential recurrences over long series, block by block.

A series is packed into rows of a block of frames each, a matrix of (frames, values) with the frames before (lead) and after it (trail)
that a step needs. A scan then has three steps: every block is summarised by itself; the summaries of a series, one for each block and of
fixed size, are chained in order; every block is finished from its entry. So no task holds a series, and a scan is equal to a
loop over the frames, whatever the size of the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.session import materialise

BLOCK = 2048
_PACKED = ("block", "lead", "trail", "m")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by these columns to as many tasks as the cluster runs at once, or as a shuffle has.

    Kernels take long over few bytes; sized by bytes, blocks would be put together in a few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def matrix(m: bytes, width: int) -> np.ndarray:
    return np.frombuffer(m, float).reshape(-1, width)


def _fields(df: DataFrame, by: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in by]


def packed_schema(df: DataFrame, by: list[str]) -> T.StructType:
    return T.StructType([*_fields(df, by), T.StructField("block", T.LongType()), T.StructField("lead", T.IntegerType()), T.StructField("trail", T.IntegerType()), T.StructField("m", T.BinaryType())])


def pack(df: DataFrame, by: list[str], frame: str, values: str, block: int = BLOCK, lead: int = 0, trail: int = 0) -> DataFrame:
    """(by, block, lead, trail, m): rows with a frame number (from 0, without gaps) and an array of values, as blocks of frames.

    lead and trail say how many frames of m are before and after the block's own: fewer than asked for at the ends of a series.
    An empty table gives an empty result; a null series is one of its own; NULL values become NaN.
    """
    at = F.col(frame).cast("long")
    to = lambda x: F.floor(x / block)
    dealt = df.select(*by, at.alias("__f"), F.col(values).cast("array<double>").alias("__v"), F.explode(F.sequence(F.greatest(to(at - trail), F.lit(0)), to(at + lead))).alias("block"))
    rows = spread(dealt, *by, "block").groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("__f", "__v"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, leads, trails, out = [], [], [], []
            for i, (b, r) in enumerate(zip(batch.column("block").to_pylist(), batch.column("rows"))):
                f = r.values.field("__f").to_numpy()
                before, after = int((f < b * block).sum()), int((f >= (b + 1) * block).sum())
                if before + after == len(f):
                    continue  # the series has no frame in this block
                v = r.values.field("__v")
                keep.append(i)
                leads.append(before)
                trails.append(after)
                out.append(v.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes())
            kept = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in by), kept.column("block"), pa.array(leads, pa.int32()), pa.array(trails, pa.int32()), pa.array(out, pa.binary())], names=[*by, *_PACKED])

    return rows.mapInArrow(run, packed_schema(df, by))


def unpack(packed: DataFrame, by: list[str], width: int, frame: str = "frame", to: str = "features", block: int = BLOCK) -> DataFrame:
    """(by, frame, to): packed() undone, without lead and trail."""
    schema = T.StructType([*_fields(packed, by), T.StructField(frame, T.LongType()), T.StructField(to, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (b, lead, trail, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in _PACKED))):
                x = matrix(m, width)
                yield frame_rows(batch, by, [i], [b * block], [x[lead : len(x) - trail]], frame, to)

    return packed.mapInArrow(run, schema)


def frame_rows(batch: pa.RecordBatch, by: list[str], rows: list[int], firsts: list[int], parts: list[np.ndarray], frame: str = "frame", to: str = "features") -> pa.RecordBatch:
    """(by, frame, to) rows of the matrices that belong to these rows of the batch, from the frame `firsts` of each on."""
    x = np.ascontiguousarray(np.concatenate(parts))
    arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
    same = batch.select(by).take(pa.array(np.repeat(rows, [len(p) for p in parts]), pa.int32()))  # not the matrices, too
    frames = np.concatenate([f + np.arange(len(p)) for f, p in zip(firsts, parts)])
    return pa.RecordBatch.from_arrays([*(same.column(c) for c in by), pa.array(frames, pa.int64()), arrays], names=[*by, frame, to])


def each_block(packed: DataFrame, by: list[str], kernel: Callable[..., np.ndarray], *more: str, keep: bool = False) -> DataFrame:
    """packed with the matrix that kernel(m, lead, trail, *more) gives for each block, of its own frames (or, with keep, of all); m and the `more` columns come as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, trail = batch.column("lead"), batch.column("trail")
            out = [np.ascontiguousarray(kernel(*row), float).tobytes() for row in zip(*(batch.column(c).to_pylist() for c in ("m", "lead", "trail", *more)))]
            none = pa.repeat(pa.scalar(0, pa.int32()), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), batch.column("block"), lead if keep else none, trail if keep else none, pa.array(out, pa.binary())], names=[*by, *_PACKED])

    return packed.select(*by, *_PACKED, *more).mapInArrow(run, packed_schema(packed, by))


def with_block(packed: DataFrame, by: list[str], other: DataFrame, column: str, to: str) -> DataFrame:
    """packed with the column of the other table's row of the same series and block."""
    names = {c: f"__of_{c}" for c in [*by, "block"]}
    on = F.lit(True)
    for c, o in names.items():
        on = on & F.col(c).eqNullSafe(F.col(o))
    return packed.join(other.select(*[F.col(c).alias(o) for c, o in names.items()], F.col(column).alias(to)), on).drop(*names.values())


def scan(packed: DataFrame, by: list[str], summarise: Callable[..., np.ndarray], chain: Callable[[list[np.ndarray]], list[np.ndarray]], finish: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """packed, which must be a written table, with each block's matrix replaced by finish(m, lead, trail, entry, *more).

    summarise(m, lead, trail) gives an array for a block, chain() from those of a series in order an array for each block: its entry.
    `more` names other columns of packed that finish() needs.
    """
    sums = each_block(packed, by, summarise)
    schema = T.StructType([*_fields(packed, by), T.StructField("block", T.LongType()), T.StructField("entry", T.BinaryType())])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        entries = chain([np.frombuffer(m, float) for m in rows["m"]])
        return pd.DataFrame({**{c: rows[c] for c in by}, "block": rows["block"], "entry": [np.ascontiguousarray(e, float).tobytes() for e in entries]})

    entries = sums.groupBy(*by).applyInPandas(lambda rows: link(rows), schema)
    return each_block(with_block(packed, by, entries, "entry", "entry"), by, lambda m, lead, trail, e, *rest: finish(m, lead, trail, np.frombuffer(e, float), *rest), "entry", *more)


def filtered(x: np.ndarray, lead: int, feedback: float, taps: tuple[float, ...]) -> np.ndarray:
    """What recurrence() makes of the rows of x after the first `lead` ones, if y is 0 before them."""
    x = np.concatenate((np.repeat(x[:1], len(taps) - 1 - lead, 0), x))
    n = len(x) - len(taps) + 1
    y = sum(t * x[len(taps) - 1 - k : len(taps) - 1 - k + n] for k, t in enumerate(taps))
    for t in range(1, n):
        y[t] += feedback * y[t - 1]
    return y


def carried(y: np.ndarray, entry: np.ndarray, feedback: float) -> np.ndarray:
    """filtered() rows with what the value before them, entry, adds."""
    return y + entry[None] * feedback ** np.arange(1, len(y) + 1)[:, None]


def recurrence(packed: DataFrame, by: list[str], width: int, feedback: float, taps: tuple[float, ...]) -> DataFrame:
    """packed filtered by y[t] = feedback * y[t - 1] + sum of taps[k] * x[t - k], each of the width values by itself.

    packed needs a lead of len(taps) - 1 frames; before a series its first frame stands in, and y is 0. A block's summary is what it makes of
    no input before it, and its length: y at its end is that and feedback**length times y at its beginning.
    """

    def summarise(m: bytes, lead: int, trail: int) -> np.ndarray:
        y = filtered(matrix(m, width), lead, feedback, taps)
        return np.append(y[-1], feedback ** len(y))

    def chain(sums: list[np.ndarray]) -> list[np.ndarray]:
        y, out = np.zeros(width), []
        for s in sums:
            out.append(y)
            y = s[:-1] + s[-1] * y
        return out

    def finish(m: bytes, lead: int, trail: int, entry: np.ndarray) -> np.ndarray:
        return carried(filtered(matrix(m, width), lead, feedback, taps), entry, feedback)

    return scan(packed, by, summarise, chain, finish)


Costs = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def best_path(local: np.ndarray, step: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs (rows, states) after all frames, and of each frame and state the state before it, (frames, rows, states), for rows of costs before the first frame."""
    costs, back = entry, np.empty((len(local), *entry.shape), np.int16)
    for t in range(len(local)):
        ways = costs[:, :, None] + step[t][None]
        back[t] = ways.argmin(1)
        costs = ways.min(1) + local[t]
    return costs, back


def walked(local: np.ndarray, step: np.ndarray, entry: np.ndarray, last: int | None = None) -> np.ndarray:
    """The states of the path of least cost from a row of costs before the first frame to the state `last`, or the cheapest one."""
    costs, back = best_path(local, step, entry[None])
    at = int(costs[0].argmin()) if last is None else last
    path = np.empty(len(local), int)
    for t in range(len(local) - 1, -1, -1):
        path[t] = at
        at = back[t, 0, at]
    return path


def chained(ways: list[np.ndarray]) -> np.ndarray:
    """The states of the path of least cost before, between and after parts of a series, of which `ways` gives the least costs from each state before one to each at its end."""
    before = [np.zeros(len(ways[0]))]
    for w in ways:
        before.append((before[-1][:, None] + w).min(0))
    out = [int(before[-1].argmin())]
    for w, b in zip(reversed(ways), reversed(before[:-1])):
        out.append(int((b + w[:, out[-1]]).argmin()))
    return np.array(out[::-1])


def least_cost_path(packed: DataFrame, by: list[str], width: int, states: int, costs: Costs, pick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """packed with the states of the path of least cost through each series, as a matrix of one column, or with pick(frames, states) of each block.

    costs(x) gives for a matrix of frames the cost of each state, (frames, states), and of each step into a frame, (frames, states,
    states); the step into a series' first frame is free. packed needs a lead of one frame. A block's summary is the matrix of least costs from each
    state before it to each state at its end; those of a series are combined by sums and minima, forward for the costs and back for the states at
    the blocks' edges; then each block finds the path between its two. Costs are those of a loop over all frames; of paths
    that cost the same one is taken.
    """
    none = np.where(np.eye(states, dtype=bool), 0.0, np.inf)

    def of(m: bytes, lead: int, trail: int) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(m, width)
        local, step = costs(x[: len(x) - trail])
        if not lead:
            step = np.concatenate((np.zeros((1, states, states)), step[1:]))
        return local[lead:], step[lead:]

    def summarise(m: bytes, lead: int, trail: int) -> np.ndarray:
        return best_path(*of(m, lead, trail), none)[0].ravel()

    def chain(sums: list[np.ndarray]) -> list[np.ndarray]:
        at = chained([s.reshape(states, states) for s in sums])
        return [at[k : k + 2] for k in range(len(sums))]

    def finish(m: bytes, lead: int, trail: int, entry: np.ndarray) -> np.ndarray:
        first, at = entry.astype(int)
        local, step = of(m, lead, trail)
        path = walked(local, step, none[first], at)
        return path[:, None] if pick is None else pick(matrix(m, width)[lead : lead + len(path)], path)

    return scan(packed, by, summarise, chain, finish)


#: The taps of rasta() and its feedback.
RASTA, FEEDBACK = (0.2, 0.1, 0.0, -0.1, -0.2), 0.98


def rasta(packed: DataFrame, by: list[str], width: int, feedback: float = FEEDBACK) -> DataFrame:
    """packed band-passed over time: 0.1 * (2 + z**-1 - z**-3 - 2 * z**-4) / (1 - feedback * z**-1) on each value; needs a lead of four frames (Hermansky and Morgan 1994)."""
    return recurrence(packed, by, width, feedback, RASTA)


def smooth(x: np.ndarray, lead: int, trail: int, nz: np.ndarray, same: np.ndarray) -> np.ndarray:
    """smoothed() of the rows of a matrix but for the first `lead` and the last `trail`, which are 0 or 1; nz and same say it of each column."""
    counts = np.where(nz[None], x != 0, True).astype(float)
    pad = lambda a: np.concatenate((np.zeros((1 - lead, a.shape[1])), a, np.zeros((1 - trail, a.shape[1]))))
    v, c = pad(x * counts), pad(counts)
    total, n = v[:-2] + v[1:-1] + v[2:], c[:-2] + c[1:-1] + c[2:]
    own = x[lead : len(x) - trail]
    return np.where(same[None] | nz[None] & (own == 0), own, total / np.maximum(n, 1))


def smoothed(packed: DataFrame, by: list[str], width: int, nonzero: tuple[int, ...] = (), plain: tuple[int, ...] = ()) -> DataFrame:
    """packed with the mean of three frames; of the `nonzero` columns zeros don't count and stay zero, the `plain` ones stay as they are. Needs a lead and a trail of one frame."""
    nz, same = np.isin(np.arange(width), nonzero), np.isin(np.arange(width), plain)

    return each_block(packed, by, lambda m, lead, trail: smooth(matrix(m, width), lead, trail, nz, same))


def slopes(x: np.ndarray, lead: int, trail: int, reach: int = 2) -> np.ndarray:
    """deltas() of the rows of a matrix but for the first `lead` and the last `trail`, at most reach."""
    x = np.concatenate((np.repeat(x[:1], reach - lead, 0), x, np.repeat(x[-1:], reach - trail, 0)))
    n = len(x) - 2 * reach
    return sum(k * (x[reach + k : reach + k + n] - x[reach - k : reach - k + n]) for k in range(1, reach + 1)) / (2 * sum(k * k for k in range(1, reach + 1)))


def deltas(packed: DataFrame, by: list[str], width: int, reach: int = 2) -> DataFrame:
    """packed with the regression slope over `reach` frames on either side; beyond an end the last frame stands in. Needs a lead and a trail of reach frames."""

    return each_block(packed, by, lambda m, lead, trail: slopes(matrix(m, width), lead, trail, reach))


def written(packed: DataFrame) -> DataFrame:
    return materialise(packed, "packed")


def turning(v: np.ndarray) -> np.ndarray:
    """Places of the turns of a contour: see turns()."""
    x, y, z = v[:-2], v[1:-1], v[2:]
    return np.flatnonzero((y > x) & (y >= z) | (y < x) & (y <= z)) + 1


def between_turns(where: np.ndarray, high: np.ndarray, least: float) -> np.ndarray:
    """Number, mean and squares about it of the rising slopes between turns at these places and of these values, and of the falling ones; those of `least` or less don't count."""
    dv, dt = np.diff(high), np.diff(where)
    kept = np.abs(dv) > least
    parts = [dv[kept & up] / dt[kept & up] for up in (dv > 0, dv < 0)]
    return np.array([x for s in parts for x in (len(s), s.mean() if len(s) else 0.0, ((s - s.mean()) ** 2).sum() if len(s) else 0.0)])


def turns(packed: DataFrame, by: list[str], width: int, column: int, spread: str, least: float = 0.1, nonzero: bool = False) -> DataFrame:
    """Of each block: how many steps between turns rise by more than `least` of the spread, the mean of their slopes (a frame is a step of time) and the sum of squares about it; the same of those that fall; as a matrix of one row.

    A turn is a value over the one before and not under the one after, or the other way round; with nonzero zeros are passed over. A step goes from
    one turn to the next, and belongs to the block in which that is decided. spread names a column of packed, a written table without lead and trail. What a block
    needs of earlier ones are two values and the last turn, which blocks of any size pass on.
    """
    none = np.nan
    turn = lambda x, y, z: (y > x and y >= z) or (y < x and y <= z)

    def own(m: bytes) -> np.ndarray:
        v = matrix(m, width)[:, column]
        return v[v != 0] if nonzero else v

    def summarise(m: bytes, lead: int, trail: int) -> np.ndarray:
        v = own(m)
        at = turning(v)
        first, last = (v[0], v[-1]) if len(v) else (none, none)
        second, before = (v[1], v[-2]) if len(v) > 1 else (none, none)
        return np.array([len(v), first, second, before, last, at[-1] if len(at) else none, v[at[-1]] if len(at) else none])

    def chain(sums: list[np.ndarray]) -> list[np.ndarray]:
        a, b, pos, at, value = none, none, 0.0, none, none
        out = []
        for n, first, second, before, last, inner, high in sums:
            out.append(np.array([a, b, pos, at, value]))
            if n and turn(a, b, first):  # comparisons with NaN are false
                at, value = pos - 1, b
            if n > 1 and turn(b, first, second):
                at, value = pos, first
            if not np.isnan(inner):
                at, value = pos + inner, high
            a, b = (b, last) if n == 1 else (before, last) if n else (a, b)
            pos += n
        return out

    def finish(m: bytes, lead: int, trail: int, entry: np.ndarray, width_of_range: float | None) -> np.ndarray:
        a, b, pos, at, value = entry
        head = [x for x in (a, b) if not np.isnan(x)]
        v = np.concatenate((head, own(m)))
        k = turning(v)
        where, high = pos - len(head) + k, v[k]
        if not np.isnan(at):
            where, high = np.append(at, where), np.append(value, high)
        return between_turns(where, high, least * (width_of_range or 0.0))[None]

    return scan(packed, by, summarise, chain, finish, spread)
