"""Functionals of many contours at once, from states of blocks that merge.

A first pass finds number, mean and range of each contour of a series; a second summarises every block by a state of fixed size
(centred sums, sums over time, products at lags, runs and turns with open edges); the states of a series are merged in order. Percentiles come
from distributed ranks. No task holds a contour, and the figures are those of the whole contour at any size of block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.functions import signal
from stimframe.operators import scans
from stimframe.operators.rank import quantiles
from stimframe.session import materialise

LAGS = 5
POINTS = (0.01, 0.25, 0.5, 0.75, 0.99)
LEVELS = (0.25, 0.5, 0.75, 0.9)
#: Shares of the range at whose crossings a segment ends, and by how much of it turns must differ.
CROSSED, LEAST = (0.25, 0.75), 0.1
_SUMS = ("n", "s1", "s2", "s3", "s4", "y1", "y2", "a0", "a1", "q", "pos", "npos", "log", "nnz", *[f"up{k}" for k in range(len(LEVELS))], "rise", "left", *[f"r{k}" for k in range(LAGS + 1)])
_AT = {name: k for k, name in enumerate(_SUMS)}
_PLACES = len(_SUMS)
_HEAD = _PLACES + 2
_TAIL = _HEAD + LAGS
#: Runs: length and class of the first and of the last, whether they are one; of those between, for each class: number, sum, squares, least, largest length.
_RUNS = _TAIL + LAGS
_CLASSES = len(CROSSED) + 1
#: Turns: place, value and kind of the first, place and value of the last; then what _steps() gives.
_TURNS = _RUNS + 5 + 5 * _CLASSES
_NO_STEPS = np.array([0, 0, -np.inf, np.inf, np.nan, np.nan, 0, 0, 0, 0, -np.inf, np.inf, 0, 0, 0, 0, 0, 0], float)
SIZE = _TURNS + 5 + len(_NO_STEPS)
#: What functionals() gives of each contour.
FIGURES = (
    "amean", "posamean", "rqmean", "flatness", "range", "maxPos", "minPos", "stddev", "skewness", "kurtosis", "linregc1", "linregc2", "linregerrQ", "qregc1", "qregc2", "qregc3", "qregerrQ", "centroid",
    *[f"upleveltime{round(100 * q)}" for q in LEVELS], "risetime", "leftctime", "lpgain", *[f"lpc{k}" for k in range(LAGS)], "meanSegLen", "maxSegLen", "minSegLen", "segLenStddev", "meanHighLen", "maxHighLen", "minHighLen", "highLenStddev",
    "meanPeakDist", "peakDistStddev", "peakRangeAbs", "peakRangeRel", "peakMeanAbs", "peakMeanMeanDist", "peakMeanRel", "minRangeRel", "meanRisingSlope", "stddevRisingSlope", "meanFallingSlope", "stddevFallingSlope",
    "quartile1", "quartile2", "quartile3", "iqr1-2", "iqr2-3", "iqr1-3", "percentile1.0", "percentile99.0", "pctlrange0-1",
)


def _steps(dv: np.ndarray, dt: np.ndarray, at: np.ndarray, value: np.ndarray, top: np.ndarray, least: float) -> np.ndarray:
    """Of steps to turns (at, value, top) that differ from the turn before by more than `least`: of maxima number, sum, largest, smallest, first and last place, number, sum and squares of
    their distances; of minima number, largest, smallest; number, sum and squares of rising and of falling slopes."""
    kept = np.abs(dv) > least
    up, down = kept & top, kept & ~top
    out, peaks = _NO_STEPS.copy(), at[up]
    if len(peaks):
        gaps = np.diff(peaks).astype(float)
        out[:9] = len(peaks), value[up].sum(), value[up].max(), value[up].min(), peaks[0], peaks[-1], len(gaps), gaps.sum(), (gaps**2).sum()
    if down.any():
        out[9:12] = down.sum(), value[down].max(), value[down].min()
    for k, way in ((12, kept & (dv > 0)), (15, kept & (dv < 0))):
        slopes = dv[way] / dt[way]
        out[k : k + 3] = len(slopes), slopes.sum(), (slopes**2).sum()
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_steps() of what two parts, in order, tell together."""
    out = a + b
    for k, pick in ((2, max), (3, min), (10, max), (11, min)):
        out[k] = pick(a[k], b[k])
    out[4], out[5] = (b[4] if np.isnan(a[4]) else a[4]), (a[5] if np.isnan(b[5]) else b[5])
    if a[0] and b[0]:
        gap = b[4] - a[5]
        out[6:9] += 1, gap, gap * gap
    return out


def block_state(v: np.ndarray, mean: float, lo: float, hi: float) -> np.ndarray:
    """The state of a block's values of one contour, whose mean and range over all blocks are known."""
    return block_states(v[:, None], np.array([len(v)]), *(np.array([x], float) for x in (mean, lo, hi)))[0]


def compacted(x: np.ndarray, nonzero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of x without their zeros where `nonzero`, moved up, with zeros after them; and how many values each has."""
    x, out = np.asarray(x, float), np.array(x, float)
    there = x[:, nonzero] != 0
    out[:, nonzero] = np.take_along_axis(x[:, nonzero], np.argsort(~there, 0, kind="stable"), 0)
    counts = np.full(x.shape[1], len(x))
    counts[nonzero] = there.sum(0)
    return out, counts


def block_states(v: np.ndarray, count: np.ndarray, mean: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(contours, SIZE): block_state() of each column of v, of which the first `count` values count and zeros follow."""
    most, c = v.shape
    out = np.zeros((c, SIZE))
    out[:, _TURNS : _TURNS + 5], out[:, _TURNS + 5 :] = np.nan, _NO_STEPS
    if not most:
        out[:, _TURNS:] = 0.0
        return out
    lo, hi = (np.where(count > 0, x, 0.0) for x in (lo, hi))
    i, spread = np.arange(most, dtype=float)[:, None], hi - lo
    live = i < count
    y, size, up = np.where(live, v - np.where(count > 0, mean, 0.0), 0.0), np.abs(v), v > 0
    u, y2 = i - (count - 1) / 2, y * y
    d = np.diff(v, axis=0)
    over = lambda q: live & (v > lo + q * spread)
    there = size > 0
    logs = np.log(np.where(there, size, 1.0))
    sums = [
        count, _added(y), _added(y2), _added(y2 * y), _added(y2 * y2), _added(u * y), _added(u * u * y), _added(size), _added(i * size), _added(v * v), _added(np.where(up, v, 0.0)), up.sum(0), _added(logs), there.sum(0),
        *[over(q).sum(0) for q in LEVELS], ((d > 0) & live[1:]).sum(0), ((np.diff(d, axis=0) > 0) & live[2:]).sum(0), *[_added(v[k:] * v[: max(0, most - k)]) for k in range(LAGS + 1)],
    ]
    out[:, :_PLACES] = np.stack(sums, 1)
    for k, end in enumerate((hi, lo)):
        where = live & (v == end)
        out[:, _PLACES + k] = np.where(where.any(0), where.argmax(0), np.nan)
    out[:, _HEAD : _HEAD + min(most, LAGS)] = v[:LAGS].T
    last = count - LAGS + np.arange(LAGS)[:, None]
    out[:, _TAIL : _TAIL + LAGS] = np.where(last >= 0, np.take_along_axis(v, np.maximum(last, 0), 0), 0.0).T
    own = sum(over(q).astype(int) for q in CROSSED)
    begins = live.copy()
    begins[1:] &= own[1:] != own[:-1]
    col, start = np.nonzero(begins.T)  # by contour and place
    if len(col):
        kind, first, final = own[start, col], np.append(True, col[1:] != col[:-1]), np.append(col[1:] != col[:-1], True)
        lengths = np.where(final, count[col], np.append(start[1:], 0)) - start.astype(float)
        out[col[first], _RUNS], out[col[first], _RUNS + 1] = lengths[first], kind[first]
        out[col[final], _RUNS + 2], out[col[final], _RUNS + 3], out[col[final], _RUNS + 4] = lengths[final], kind[final], first[final]
        for k in range(_CLASSES):
            at = ~first & ~final & (kind == k)
            out[:, _RUNS + 5 + 5 * k : _RUNS + 10 + 5 * k] = np.stack([*_tally(col[at], lengths[at], c), *_ends(col[at], lengths[at], c)], 1)
    x, y, z = v[:-2], v[1:-1], v[2:]
    top = (y > x) & (y >= z)
    col, at = np.nonzero(((top | (y < x) & (y <= z)) & live[2:]).T)
    if len(col):
        top, at = top[at, col], at + 1
        value, first, final = v[at, col], np.append(True, col[1:] != col[:-1]), np.append(col[1:] != col[:-1], True)
        out[col[first], _TURNS : _TURNS + 3] = np.stack((at[first], value[first], top[first]), 1)
        out[col[final], _TURNS + 3 : _TURNS + 5] = np.stack((at[final], value[final]), 1)
        near = ~first[1:]
        out[:, _TURNS + 5 :] = _steps_of(col[1:][near], np.diff(value)[near], np.diff(at)[near], at[1:][near], value[1:][near], top[1:][near], LEAST * spread, c)
    out[count == 0] = 0.0
    return out


def _added(x: np.ndarray) -> np.ndarray:
    """Sums of columns, each by itself in memory, where numpy adds in pairs."""
    return np.ascontiguousarray(x.T).sum(1)


def _tally(col: np.ndarray, x: np.ndarray, c: int) -> list[np.ndarray]:
    """Number, sum and squares of the values of each contour."""
    return [np.bincount(col, minlength=c).astype(float), np.bincount(col, x, c), np.bincount(col, x * x, c)]


def _ends(col: np.ndarray, x: np.ndarray, c: int) -> list[np.ndarray]:
    """Least and largest value of each contour, whose values stand together."""
    low, high = np.full(c, np.inf), np.full(c, -np.inf)
    if len(col):
        begin = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
        low[col[begin]], high[col[begin]] = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    return [low, high]


def _steps_of(col: np.ndarray, dv: np.ndarray, dt: np.ndarray, at: np.ndarray, value: np.ndarray, top: np.ndarray, least: np.ndarray, c: int) -> np.ndarray:
    """(contours, steps): _steps() of the steps of each contour, which stand together in their order."""
    kept = np.abs(dv) > least[col]
    up, down = kept & top, kept & ~top
    number, total, _ = _tally(col[up], value[up], c)
    low, high = _ends(col[up], value[up], c)
    first, last = _ends(col[up], at[up].astype(float), c)
    peaks, of = at[up].astype(float), col[up]
    near = of[1:] == of[:-1]
    bottom, highest = _ends(col[down], value[down], c)
    none = number == 0
    out = [number, total, high, low, np.where(none, np.nan, first), np.where(none, np.nan, last), *_tally(of[1:][near], np.diff(peaks)[near], c), np.bincount(col[down], minlength=c), highest, bottom]
    for way in (kept & (dv > 0), kept & (dv < 0)):
        out += _tally(col[way], dv[way] / dt[way], c)
    return np.stack(out, 1)


def _edges(states: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the edges between the blocks of one contour add: to rises, left curves and products at lags; all runs by class; all steps between turns."""
    added, runs, steps = np.zeros(3 + LAGS), np.tile([0, 0, 0, np.inf, -np.inf], (_CLASSES, 1)), _NO_STEPS.copy()
    tail, length, kind, turn, pos = np.empty(0), 0.0, None, None, 0

    def close() -> None:
        r = runs[int(kind)]
        r[:] = r[0] + 1, r[1] + length, r[2] + length**2, min(r[3], length), max(r[4], length)

    def reach(at: float, value: float, top: bool) -> None:
        nonlocal turn, steps
        if turn is not None:
            one = _steps(np.array([value - turn[1]]), np.array([at - turn[0]]), np.array([at]), np.array([value]), np.array([top], bool), least)
            steps = _joined(steps, one)
        turn = (at, value)

    for s in states:
        n = int(s[0])
        if not n:
            continue
        head = s[_HEAD : _HEAD + min(n, LAGS)]
        near = np.concatenate((tail, head))
        cut = len(tail)
        if cut:
            added[0] += near[cut] > near[cut - 1]
            for k in range(max(0, cut - 2), min(cut, len(near) - 2)):
                added[1] += near[k + 2] - near[k + 1] > near[k + 1] - near[k]
            for lag in range(1, LAGS + 1):
                for k in range(cut, min(cut + lag, len(near))):
                    added[2 + lag] += near[k] * near[k - lag] if k >= lag else 0.0
        for k in (cut - 1, cut):
            if 1 <= k < len(near) - 1 and cut:
                x, y, z = near[k - 1 : k + 2]
                if y > x and y >= z or y < x and y <= z:
                    reach(pos - cut + k, y, y > x)
        first, value, top, last, after = s[_TURNS : _TURNS + 5]
        if not np.isnan(first):
            reach(pos + first, value, bool(top))
            own = s[_TURNS + 5 :].copy()
            own[4:6] += pos
            steps, turn = _joined(steps, own), (pos + last, after)
        a, a_kind, z, z_kind, one = s[_RUNS : _RUNS + 5]
        if kind is not None and kind != a_kind:
            close()
            length = 0.0
        length, kind = length + a, a_kind
        if not one:
            close()
            inner = s[_RUNS + 5 : _TURNS].reshape(_CLASSES, 5)
            runs[:, :3] += inner[:, :3]
            runs[:, 3], runs[:, 4] = np.minimum(runs[:, 3], inner[:, 3]), np.maximum(runs[:, 4], inner[:, 4])
            length, kind = z, z_kind
        tail = near[-LAGS:] if n < LAGS else s[_TAIL : _TAIL + LAGS]
        pos += n
    if kind is not None:
        close()
    return added, runs, steps


def interpolated(v: np.ndarray, points: tuple[float, ...]) -> np.ndarray:
    """The quantiles that rank.quantiles() gives of these values, at least one."""
    v = np.sort(v)
    h = (len(v) - 1) * np.array(points)
    k, up = np.floor(h).astype(int), np.ceil(h).astype(int)
    return v[k] + (v[up] - v[k]) * (h - k)


def _lengths(runs: np.ndarray, step: float) -> list[np.ndarray]:
    """Mean, largest, smallest and SD of the lengths of runs, (contours, classes, 5)."""
    n, total, squares = runs[:, :, :3].sum(1).T
    return [np.where(n > 0, step * x, 0.0) for x in (_share(total, n), runs[:, :, 4].max(1), runs[:, :, 3].min(1), _spread(n, total, squares))]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    return np.divide(a, b, out=np.zeros(b.shape), where=b != 0)


def _spread(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, _share(squares, n) - _share(total, n) ** 2))


def _whole(state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_edges() of contours of one block, (contours, SIZE): nothing is added, and the first and the last run are closed."""
    runs = state[:, _RUNS + 5 : _TURNS].reshape(-1, _CLASSES, 5).copy()
    rows, inner = np.arange(len(state)), state[:, _RUNS + 4] == 0
    for at, own in ((_RUNS, rows), (_RUNS + 2, rows[inner])):
        length, kind = state[own, at], state[own, at + 1].astype(int)
        r = runs[own, kind]
        runs[own, kind] = np.stack((r[:, 0] + 1, r[:, 1] + length, r[:, 2] + length**2, np.minimum(r[:, 3], length), np.maximum(r[:, 4], length)), 1)
    return np.zeros((len(state), 3 + LAGS)), runs, state[:, _TURNS + 5 :]


def figures(states: np.ndarray, mean: float, lo: float, hi: float, step: float) -> list[float]:
    """FIGURES, but for percentiles, of a contour from its blocks' states (blocks, SIZE) in order; zeros if it has no values."""
    return figures_of(states[:, None], *(np.array([x], float) for x in (mean, lo, hi)), step)[0].tolist()


def figures_of(states: np.ndarray, mean: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: float) -> np.ndarray:
    """figures() of many contours, (contours, figures), from the states (blocks, contours, SIZE)."""
    out = np.zeros((states.shape[1], len(FIGURES) - 9))
    some = states[:, :, 0].sum(0) > 0
    if some.any():
        out[some] = np.stack(_figures(states[:, some], mean[some], lo[some], hi[some], step), 1)
    return out


def _figures(states: np.ndarray, mean: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: float) -> list[np.ndarray]:
    """Each of figures(), of contours that have values."""
    spread = hi - lo
    if len(states) == 1:
        added, runs, steps = _whole(states[0])
    else:
        added, runs, steps = (np.stack(x) for x in zip(*(_edges(states[:, k], LEAST * spread[k]) for k in range(len(mean)))))
    own = states[:, :, 0]
    n = own.sum(0)
    before = np.cumsum(own, 0) - own
    s = dict(zip(_SUMS, states[:, :, :_PLACES].sum(0).T))
    h, c = (n - 1) / 2, (n * n - 1) / 12
    off = before + (own - 1) / 2 - h
    b_s1, b_y1, b_y2 = (states[:, :, _AT[k]] for k in ("s1", "y1", "y2"))
    y1, y2 = (b_y1 + off * b_s1).sum(0), (b_y2 + 2 * off * b_y1 + off * off * b_s1).sum(0)
    middle = mean + s["s1"] / n
    cubic = n * (n * n - 1) * (n * n - 4) / 180
    line, bend = _share(y1, n * c), _share(y2 - c * s["s1"], cubic)
    squares = s["s2"] - s["s1"] ** 2 / n
    error = np.maximum(0.0, squares - line**2 * n * c) / n
    sd = np.where(spread != 0, np.sqrt(np.maximum(0.0, squares) / n), 0.0)
    places = states[:, :, _PLACES : _PLACES + 2]
    found = np.where((own[:, :, None] > 0) & ~np.isnan(places), before[:, :, None] + places, n[:, None]).min(0)
    first = (np.minimum(found, n[:, None]) % n[:, None] / n[:, None]).T  # 0 if no value is at that end of the range
    lags = np.stack([s[f"r{k}"] + (added[:, 2 + k] if k else 0.0) for k in range(LAGS + 1)], 1)
    lpc, gain = signal.levinson_all(lags, LAGS)
    geometric = np.where(s["nnz"] > 0, np.exp(_share(s["log"], s["nnz"])), 0.0)
    out = [
        middle, _share(s["pos"], s["npos"]), np.sqrt(s["q"] / n), _share(geometric, _share(s["a0"], s["nnz"])), spread, *first, sd, _share(s["s3"] / n, sd**3), _share(s["s4"] / n, sd**4),
        line, middle - line * h, error, bend, line - 2 * bend * h, middle - line * h + bend * (h * h - c), np.maximum(0.0, error - bend**2 * (n * n - 1) * (n * n - 4) / 180), _share((states[:, :, _AT["a1"]] + before * states[:, :, _AT["a0"]]).sum(0), s["a0"]),
        *[s[f"up{k}"] / n for k in range(len(LEVELS))], _share(s["rise"] + added[:, 0], n - 1), _share(s["left"] + added[:, 1], np.maximum(0, n - 2)), gain, *lpc.T,
        *_lengths(runs, step), *_lengths(runs[:, -1:], step),
    ]
    tops, total, most, fewest, _, _, gaps, gap, gap_squares, bottoms, highest, lowest = steps[:, :12].T
    peak = _share(total, tops)
    some, ranged = tops > 0, lambda a, b, there: np.subtract(a, b, out=np.zeros(len(a)), where=there)
    reached = ranged(most, fewest, some)
    out += [_share(gap, gaps) * step, _spread(gaps, gap, gap_squares) * step, reached, _share(reached, spread), peak, np.where(some, peak - middle, 0.0), _share(peak, middle), _share(ranged(highest, lowest, bottoms > 0), spread)]
    for k in (12, 15):
        out += [_share(steps[:, k + 1], steps[:, k]) / step, _spread(*steps[:, k : k + 3].T) / step]
    return out


def _with_points(most: np.ndarray, q: np.ndarray) -> np.ndarray:
    """FIGURES of contours from those without percentiles and the values of POINTS."""
    low, one, two, three, high = q.T
    return np.column_stack((most, one, two, three, two - one, three - two, three - one, low, high, high - low))


def _columns(x: np.ndarray, counted: np.ndarray, flags: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """compacted() contours, with those of the flags after them."""
    every = np.column_stack((x, (x[:, list(flags)] != 0).astype(float)))
    return compacted(every, np.append(counted, np.zeros(len(flags), bool)))


def _own_ends(v: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Number, mean, least and largest value of each contour, (4, contours)."""
    live = np.arange(len(v))[:, None] < count
    return np.stack((count, _added(v) / np.maximum(count, 1), np.where(live, v, np.inf).min(0, initial=np.inf), np.where(live, v, -np.inf).max(0, initial=-np.inf)))


def whole(x: np.ndarray, step: float, nonzero: tuple[int, ...] = (), flags: tuple[int, ...] = ()) -> np.ndarray:
    """(contours, FIGURES) of a series whose contours, (frames, width), are all there; functionals() gives the same, and says what the parameters are."""
    v, count = _columns(x, np.isin(np.arange(x.shape[1]), nonzero), flags)
    ends = _own_ends(v, count)[1:]
    ends[1:, x.shape[1] :] = [[0.0], [1.0]]
    most = figures_of(block_states(v, count, *ends)[None], *ends, step)
    v = np.sort(np.where(np.arange(len(v))[:, None] < count, v, np.inf), 0)
    h = np.maximum(count - 1, 0) * np.array(POINTS)[:, None]
    a, b = (np.take_along_axis(v, f(h).astype(int), 0) for f in (np.floor, np.ceil))
    q = np.where(count > 0, a + (np.where(count > 0, b, 0) - np.where(count > 0, a, 0)) * (h - np.floor(h)), 0.0)
    q[:, x.shape[1] :] = 0.0  # flags have no percentiles
    return _with_points(most, q.T)


def functionals(packed: DataFrame, by: list[str], width: int, step: float, nonzero: tuple[int, ...] = (), flags: tuple[int, ...] = (), block: int = scans.BLOCK) -> DataFrame:
    """(by, figures): FIGURES of each of the width contours of a series in packed, a written table without lead and trail, one contour after the other.

    Of `nonzero` contours zeros are left out, as if the others followed each other. After the contours come those of `flags`, as 1 where they aren't zero and 0 elsewhere, with a range from 0 to 1. A frame takes
    `step` seconds, the unit of lengths, distances and slopes; regressions count frames, shares are of the contour's length. Segments are the stretches between
    crossings of the shares CROSSED of the range, `High` ones those over the last. Turns differ from the turn before by more than LEAST of the
    range. What a contour has none of is 0; a null series is one of its own; an empty table gives an empty result.
    """
    counted, count = np.isin(np.arange(width), nonzero), width + len(flags)

    def ends(m: bytes, lead: int, trail: int) -> np.ndarray:
        return _own_ends(*_columns(scans.matrix(m, width), counted, flags)).T

    fields = [T.StructField(c, packed.schema[c].dataType) for c in by]
    first = lambda rows: {c: rows[c].iloc[:1] for c in by}

    def merge_ends(rows: pd.DataFrame) -> pd.DataFrame:
        e = np.stack([np.frombuffer(m, float).reshape(count, 4) for m in rows["m"]])
        n = e[:, :, 0].sum(0)
        out = np.stack(((e[:, :, 0] * e[:, :, 1]).sum(0) / np.maximum(n, 1), e[:, :, 2].min(0), e[:, :, 3].max(0)))
        out[1:, width:] = [[0.0], [1.0]]
        return pd.DataFrame({**first(rows), "ends": [out.tobytes()]})

    known = materialise(scans.each_block(packed, by, ends).groupBy(*by).applyInPandas(lambda rows: merge_ends(rows), T.StructType([*fields, T.StructField("ends", T.BinaryType())])), "ends")

    def state(m: bytes, lead: int, trail: int, e: bytes) -> np.ndarray:
        return block_states(*_columns(scans.matrix(m, width), counted, flags), *np.frombuffer(e, float).reshape(3, count))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        states = np.stack([np.frombuffer(m, float).reshape(count, SIZE) for m in rows["m"]])
        return pd.DataFrame({**first(rows), "most": [figures_of(states, *np.frombuffer(rows["ends"].iloc[0], float).reshape(3, count), step).ravel()]})

    summed = _joined_by(scans.each_block(_joined_by(packed, known, by), by, state, "ends"), known, by)
    merged = summed.groupBy(*by).applyInPandas(lambda rows: merge(rows), T.StructType([*fields, T.StructField("most", T.ArrayType(T.DoubleType()))]))

    values = scans.unpack(packed, by, width, block=block).select(*by, F.posexplode("features").alias("k", "v"))
    if nonzero:
        values = values.where(~F.col("k").isin(*nonzero) | (F.col("v") != 0))
    points = quantiles(values, [*by, "k"], "v", POINTS, "q").groupBy(*by).agg(F.collect_list(F.struct("k", "q")).alias("points"))

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for most, found in zip(rows["most"], rows["points"]):
                q = np.zeros((count, len(POINTS)))
                for p in [] if found is None else found:
                    q[p["k"]] = p["q"]
                out.append(_with_points(np.reshape(most, (count, -1)), q).ravel())
            yield pd.DataFrame({**{c: rows[c] for c in by}, "figures": out})

    return _joined_by(merged, points, by).mapInPandas(finish, T.StructType([*fields, T.StructField("figures", T.ArrayType(T.DoubleType()))]))


def _joined_by(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    names = {c: f"__of_{c}" for c in by}
    on = F.lit(True)
    for c, o in names.items():
        on = on & F.col(c).eqNullSafe(F.col(o))
    return left.join(right.withColumnsRenamed(names), on, "left").drop(*names.values())
