"""Voice descriptors of long recordings, by blocks of frames: the sets of 25 (eGeMAPS) and 65 (ComParE) low-level descriptors, and the functionals of both.

Values are cut into blocks of frames once, with the samples of a few frames on either side. A stimulus of one block is done where that is. Of longer
ones every block is summarised by itself (least costs of pitch, filters' ends), the summaries of a stimulus are chained, and each block is
finished from its entry, the frames around it too, as smoothing and slopes need them: no task holds a stimulus, and no contour moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.functions import signal, voice
from stimframe.operators import scans, summaries
from stimframe.operators.extract import samples, value_blocks
from stimframe.operators.rank import quantiles
from stimframe.session import materialise

RATE, LENGTH, SHIFT = 16_000, 400, 320
#: Frames around a block that its own depend on once the pitch is known: one of smoothing, two of slopes.
REACH = 3
#: Frames before a block that it is given, as filters need some before those, and samples after its last frame: periods of the lowest pitch are followed so far.
LEAD, AFTER = REACH + len(scans.RASTA) - 1, 2400 + REACH * SHIFT
#: Root mean square up to which a frame has no pitch.
SILENT = 0.001
CANDIDATES = 6
_F3 = [f"F{k}{w}" for k in (1, 2, 3) for w in ("frequency", "bandwidth", "amplitudeLogRelF0")]
#: The names of the eGeMAPS set's low-level descriptors.
EGEMAPS = ("Loudness", "alphaRatio", "hammarbergIndex", "slope0-500", "slope500-1500", "spectralFlux", "mfcc1", "mfcc2", "mfcc3", "mfcc4", "F0semitoneFrom27.5Hz", "jitterLocal", "shimmerLocaldB", "HNRdBACF", "logRelF0-H1-H2", "logRelF0-H1-A3", *_F3)
#: The names of the ComParE set's low-level descriptors.
COMPARE = (
    "audspec_lengthL1norm", "audspecRasta_lengthL1norm", "pcm_RMSenergy", "pcm_zcr", *[f"audSpec_Rfilt[{k}]" for k in range(26)], "pcm_fftMag_fband250-650", "pcm_fftMag_fband1000-4000",
    *[f"pcm_fftMag_spectralRollOff{q}" for q in ("25.0", "50.0", "75.0", "90.0")], *[f"pcm_fftMag_{w}" for w in ("spectralFlux", "spectralCentroid", "spectralEntropy", "spectralVariance", "spectralSkewness", "spectralKurtosis", "spectralSlope", "psySharpness", "spectralHarmonicity")],
    *[f"mfcc[{k}]" for k in range(1, 15)], "F0final", "voicingFinalUnclipped", "jitterLocal", "jitterDDP", "shimmerLocal", "logHNR",
)


@dataclass(frozen=True)
class Settings:
    """Of a set: the pitch range, how far a period may differ from the pitch, and the kernels before and after the pitch is known."""

    low: float
    high: float
    reach: float
    before: Callable[[np.ndarray], np.ndarray]
    after: Callable[..., np.ndarray]


def _flux(mag: np.ndarray) -> np.ndarray:
    p = mag / np.maximum(mag.sum(1, keepdims=True), 1e-12)
    return np.append(0.0, np.sqrt(((p[1:] - p[:-1]) ** 2).sum(1)))


def _egemaps_before(f: np.ndarray) -> np.ndarray:
    """rms, loudness, alpha, hammarberg, two slopes, flux, mfcc 1 to 4, three formants' frequencies and bandwidths."""
    power, weight = voice.mel_power(f, RATE)
    level = signal.band_levels(f, RATE)
    hz, width = voice.formants(f, RATE)
    mag = np.abs(np.fft.rfft(f * signal.window("hamming", LENGTH), 512))
    return np.column_stack((signal.rms(f), ((power * weight) ** 0.33).sum(1), *(level[c] for c in ("alpha", "hammarberg", "slope_0_500", "slope_500_1500")), _flux(mag), voice.mel_cepstrum(f, RATE), hz[:, :3], width[:, :3]))


def _egemaps_after(x: np.ndarray, f: np.ndarray, at: np.ndarray, m: np.ndarray, reach: float) -> np.ndarray:
    """The columns of EGEMAPS, and the energy, from f0, voicing and the columns of _egemaps_before()."""
    out = np.zeros((len(m), len(EGEMAPS) + 1))
    out[:, :10] = m[:, 3:13]
    out[:, -1] = m[:, 2] ** 2
    formants, widths = m[:, 13:16], m[:, 16:19]
    out[:, 16:25:3], out[:, 17:25:3] = formants, widths
    for k in np.flatnonzero(m[:, 0] > 0).tolist():
        f0, s = m[k, 0], int(at[k])
        lengths, sizes = voice.periods(x, s, f0, RATE, reach=reach)
        levels = voice.harmonic_levels(f[k], f0, RATE, formants[k])
        out[k, 10:16] = 12 * np.log2(f0 / 27.5), voice.jitter(lengths)[0], voice.shimmer(sizes)[1], voice.noise_ratio(x[s : s + max(LENGTH, int(3 * RATE / f0))], f0, RATE), levels[0], levels[1]
        out[k, 18:25:3] = levels[2:]
    return out


def _compare_before(f: np.ndarray) -> np.ndarray:
    """rms, sum of the auditory spectrum, zero crossings, logs of 26 mel bands, and what the spectrum gives."""
    power, weight = voice.mel_power(f, RATE)
    shape, level = signal.spectral_shape(f, RATE), signal.band_levels(f, RATE)
    mag = np.abs(np.fft.rfft(f * signal.window("hamming", LENGTH), 512))
    names = ("rolloff25", "rolloff50", "rolloff75", "rolloff90", "flux", "centroid", "entropy", "variance", "skewness", "kurtosis", "slope")
    more = (level["band_250_650"], level["band_1000_4000"], *(shape[n] for n in names), voice.sharpness(mag, np.fft.rfftfreq(512, 1 / RATE)), voice.harmonicity(mag), voice.mel_cepstrum(f, RATE, 1, 14))
    return np.column_stack((signal.rms(f), ((power * weight) ** 0.33).sum(1), signal.zero_crossings(f), np.log(np.maximum(power, 1e-8)), *more))


def _compare_after(x: np.ndarray, f: np.ndarray, at: np.ndarray, m: np.ndarray, reach: float) -> np.ndarray:
    """The columns of COMPARE but for those of RASTA, from f0, voicing and the columns of _compare_before(); the logs of mel bands stay in their place."""
    out = np.zeros((len(m), len(COMPARE)))
    out[:, 0], out[:, 2:4] = m[:, 3], m[:, [2, 4]]
    out[:, 4:59] = m[:, 5:60]
    out[:, 59:61] = m[:, :2]
    for k in np.flatnonzero(m[:, 0] > 0).tolist():
        f0, s = m[k, 0], int(at[k])
        lengths, sizes = voice.periods(x, s, f0, RATE, reach=reach)
        out[k, 61:65] = *voice.jitter(lengths), voice.shimmer(sizes)[0], voice.noise_ratio(x[s : s + max(LENGTH, int(3 * RATE / f0))], f0, RATE)
    return out


SETS = {"egemaps": Settings(55.0, 1000.0, 0.10, _egemaps_before, _egemaps_after), "compare": Settings(52.0, 620.0, 0.25, _compare_before, _compare_after)}

_STATES = CANDIDATES + 1
_NONE = np.where(np.eye(_STATES, dtype=bool), 0.0, np.inf)
#: Of what _compare_before() gives: the logs of mel bands, which are filtered over time.
_LOGS = {"egemaps": slice(0, 0), "compare": slice(3, 29)}


@dataclass(frozen=True)
class Frames:
    """Of a block with the frames around it: samples, frames, how many are before the block and its own, what the set's kernel gives before the pitch is known, and pitch candidates with their costs."""

    x: np.ndarray
    f: np.ndarray
    lead: int
    own: int
    more: np.ndarray
    f0: np.ndarray
    voicing: np.ndarray
    local: np.ndarray
    step: np.ndarray


def _frames(kind: str, b: int, first: int, values: np.ndarray, hold: int, block: int) -> Frames | None:
    """None if the block has no whole frame."""
    chosen = SETS[kind]
    lead, wave = samples(b, first, values, hold, block, LENGTH, SHIFT, LEAD, AFTER)
    if not len(wave):
        return None
    x = wave.astype(float)
    f = signal.frames(x, LENGTH, SHIFT)[: lead + block + REACH]
    f0, voicing = voice.pitch_candidates(f, RATE, CANDIDATES, chosen.low, chosen.high)
    local, step = voice.pitch_costs(f0, voicing)
    if not lead:
        step[0] = 0.0
    return Frames(x, f, lead, min(block, len(f) - lead), chosen.before(f), f0, voicing, local, step)


def _cuts(own: int, block: int) -> np.ndarray:
    """Where a block is parted: what is within REACH frames of an edge is walked by the block on the other side too, from the same states."""
    return np.minimum((0, REACH, block - REACH, block), own)


def _summary(kind: str, b: int, first: int, values: np.ndarray, hold: int, block: int) -> np.ndarray | None:
    """Least costs through the three parts of a block; its length; the filtered logs, from nothing before it, at the second cut (0 if it ends before) and at its end."""
    at = _frames(kind, b, first, values, hold, block)
    if at is None:
        return None
    cuts = _cuts(at.own, block)
    ways = [scans.best_path(at.local[at.lead + a : at.lead + z], at.step[at.lead + a : at.lead + z], _NONE)[0].ravel() for a, z in zip(cuts, cuts[1:])]
    before = min(at.lead, len(scans.RASTA) - 1)
    y = scans.filtered(at.more[at.lead - before : at.lead + at.own, _LOGS[kind]], before, scans.FEEDBACK, scans.RASTA)
    return np.concatenate((*ways, [at.own], y[block - REACH - 1] if at.own >= block - REACH else np.zeros(y.shape[1]), y[-1]))


def _chain(sums: list[np.ndarray], block: int) -> list[np.ndarray]:
    """Of each block, from the summaries in order: the states at the cuts from the one before REACH frames before it to the one after REACH frames of the next, and the filtered logs before those frames; -1 and 0 where there are none."""
    n = _STATES * _STATES
    states = np.concatenate(([-1], scans.chained([w for s in sums for w in s[: 3 * n].reshape(3, _STATES, _STATES)]), [-1]))
    width = (len(sums[0]) - 3 * n - 1) // 2
    y, cut, out = np.zeros(width), np.zeros(width), []
    for k, s in enumerate(sums):
        out.append(np.concatenate((np.resize(states[3 * k : 3 * k + 6], 6), cut)))
        cut = s[3 * n + 1 : 3 * n + 1 + width] + scans.FEEDBACK ** (block - REACH) * y
        y = s[3 * n + 1 + width :] + scans.FEEDBACK ** s[3 * n] * y
    return out


def _path(at: Frames, entry: np.ndarray | None, block: int) -> np.ndarray:
    """States of the path of least cost, from REACH frames before the block on to the last of its frames."""
    if entry is None:
        return scans.walked(at.local, at.step, np.zeros(_STATES))
    states = entry[:6].astype(int)
    cuts = at.lead + np.concatenate(([-REACH if at.lead else 0], _cuts(at.own, block), [len(at.f) - at.lead]))
    parts = [scans.walked(at.local[a:z], at.step[a:z], _NONE[first], int(last)) for a, z, first, last in zip(cuts, cuts[1:], states, states[1:]) if z > a]
    return np.concatenate(parts)


def _block(kind: str, delta: bool, b: int, first: int, values: np.ndarray, entry: bytes | None, hold: int, block: int, pitch_alone: bool = False) -> np.ndarray | None:
    """The smoothed columns of the frames of a block, with their slopes if `delta`, or pitch and voicing alone; entry is that of _chain(), or None for the one block of a stimulus."""
    at = _frames(kind, b, first, values, hold, block)
    if at is None:
        return None
    entry = None if entry is None else np.frombuffer(entry, float)
    begin, n = max(0, at.lead - REACH), CANDIDATES
    path, f0, voicing, more = _path(at, entry, block), at.f0[begin:], at.voicing[begin:], at.more[begin:]
    rows, k = np.arange(len(path)), np.minimum(path, n - 1)
    there = (path < n) & (more[:, 0] > SILENT)
    known = np.column_stack((np.where(there, f0[rows, k], 0.0), np.where(path < n, voicing[rows, k], voicing.max(1)), more))
    if pitch_alone:
        return known[at.lead - begin :][: at.own, :2]
    c = SETS[kind].after(at.x, at.f[begin:], (begin + rows) * SHIFT, known, SETS[kind].reach)
    if kind == "compare":
        before = min(begin, len(scans.RASTA) - 1)
        y = scans.filtered(at.more[begin - before :, _LOGS[kind]], before, scans.FEEDBACK, scans.RASTA)
        c[:, 4:30] = (np.exp(y if entry is None else scans.carried(y, entry[6:], scans.FEEDBACK)) * voice.mel_power(np.zeros((1, LENGTH)), RATE)[1]) ** 0.33
        c[:, 1] = c[:, 4:30].sum(1)
    else:
        c = _with_voiced(c)
    # Where fewer than REACH frames follow, the stimulus ends with them.
    left, right = at.lead - begin, len(at.f) - at.lead - at.own
    a, z = int(left > 0), int(right == REACH)
    c = scans.smooth(c, a, z, *_SMOOTHED[kind])
    left, right = left - a, right - z
    own = c[left : left + at.own]
    return np.column_stack((own, scans.slopes(c, left, right))) if delta else own


def _parted(series: DataFrame, kind: str, hold: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Blocks that are all of their stimulus, and those of longer ones with their entries, or None if there are none."""
    if block < LEAD:
        raise ValueError(f"blocks need {LEAD} frames at least")
    held = materialise(value_blocks(series, hold, block, LENGTH, SHIFT, LEAD, AFTER), "values")
    whole = (F.col("block") == 0) & ((F.col("first") + F.size("values")) * hold < block * SHIFT + LENGTH)
    alone, rest = held.where(whole).withColumn("entry", F.lit(None).cast("binary")), held.where(~whole)
    if rest.isEmpty():
        return scans.spread(alone, "stim", "block"), None
    stim = T.StructField("stim", series.schema["stim"].dataType)
    sums = _each(scans.spread(rest.withColumn("entry", F.lit(None).cast("binary")), "stim", "block"), lambda b, first, values, entry: _summary(kind, b, first, values, hold, block))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame({"stim": rows["stim"], "block": rows["block"], "entry": [e.tobytes() for e in _chain([np.frombuffer(m, float) for m in rows["m"]], block)]})

    entries = sums.groupBy("stim").applyInPandas(lambda rows: link(rows), T.StructType([stim, T.StructField("block", T.LongType()), T.StructField("entry", T.BinaryType())]))
    return scans.spread(alone, "stim", "block"), scans.spread(scans.with_block(rest, ["stim"], materialise(entries, "entries"), "entry", "entry"), "stim", "block")


#: Bytes of matrices that go out of a task at once.
_AT_ONCE = 8 << 20


def _each(blocks: DataFrame, kernel: Callable[..., np.ndarray | None], to: str = "m", block: int = scans.BLOCK) -> DataFrame:
    """What kernel(block, first, values, entry) gives of the blocks: packed matrices, or with to="features" a row for each of their frames, or with "figures" (stim, features) with all of a matrix. Blocks of which it gives None are left out."""
    doubles, stim = T.ArrayType(T.DoubleType()), T.StructField("stim", blocks.schema["stim"].dataType)
    schema = scans.packed_schema(blocks, ["stim"]) if to == "m" else T.StructType([stim, *[T.StructField("frame", T.LongType())] * (to == "features"), T.StructField("features", doubles)])

    def rows_of(batch: pa.RecordBatch, rows: list[int], numbers: list[int], out: list[np.ndarray]) -> pa.RecordBatch:
        if to == "features":
            return scans.frame_rows(batch, ["stim"], rows, [b * block for b in numbers], out)
        same = batch.column("stim").take(pa.array(rows, pa.int32()))
        if to == "figures":
            ends = np.cumsum([0, *(x.size for x in out)])
            return pa.RecordBatch.from_arrays([same, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x.ravel() for x in out])))], names=["stim", "features"])
        none = pa.repeat(pa.scalar(0, pa.int32()), len(rows))
        return pa.RecordBatch.from_arrays([same, pa.array(numbers, pa.int64()), none, none, pa.array([np.ascontiguousarray(x, float).tobytes() for x in out], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, out, size = [], [], [], 0
            for i, (b, first, v, entry) in enumerate(zip(batch.column("block").to_pylist(), batch.column("first").to_pylist(), batch.column("values"), batch.column("entry").to_pylist())):
                x = kernel(b, first, v.values.to_numpy(), entry)
                if x is None:
                    continue
                rows.append(i)
                numbers.append(b)
                out.append(x)
                size += x.nbytes
                if size > _AT_ONCE:
                    yield rows_of(batch, rows, numbers, out)
                    rows, numbers, out, size = [], [], [], 0
            if rows:
                yield rows_of(batch, rows, numbers, out)

    return blocks.select("stim", "block", "first", "values", "entry").mapInArrow(run, schema)


def _every(parts: tuple[DataFrame, DataFrame | None], give: Callable[[DataFrame], DataFrame]) -> DataFrame:
    alone, rest = parts
    return give(alone) if rest is None else give(alone).unionByName(give(rest))


def pitch(series: DataFrame, kind: str = "egemaps", hold: int = 1, block: int = scans.BLOCK) -> DataFrame:
    """(stim, frame, features): pitch in Hz on the path of least cost through six candidates a frame (0: unvoiced or silent), and how voiced that frame is."""
    return _every(_parted(series, kind, hold, block), lambda blocks: _each(blocks, lambda *row: _block(kind, False, *row, hold, block, True), "features", block))


def egemaps(series: DataFrame, hold: int = 1, block: int = scans.BLOCK) -> DataFrame:
    """(stim, frame, features): the 25 columns of EGEMAPS, smoothed over three frames; zeros of what is unvoiced stay zero.

    Pitch is in semitones over 27.5 Hz. An empty table gives an empty result, as does a stimulus of less than a frame; NULL samples are 0.
    """
    give = lambda *row: _block("egemaps", False, *row, hold, block)
    own = lambda *row: None if (x := give(*row)) is None else x[:, : len(EGEMAPS)]
    return _every(_parted(series, "egemaps", hold, block), lambda blocks: _each(blocks, own, "features", block))


#: Beside the 25: formants of voiced frames, ten columns less loudness of voiced ones, five of unvoiced ones, energy.
_NZ = ("F1frequency", "F1bandwidth", "F2frequency", "F2bandwidth", "F3frequency", "F3bandwidth")
_V = ("alphaRatio", "hammarbergIndex", "slope0-500", "slope500-1500", "spectralFlux", "mfcc1", "mfcc2", "mfcc3", "mfcc4")
_ALL = len(EGEMAPS) + len(_NZ) + len(_V) + 5 + 1


#: Of each set's columns: of which zeros don't count in smoothing, and which stay as they are.
_SMOOTHED = {
    "egemaps": ((np.arange(_ALL) >= 10) & (np.arange(_ALL) < _ALL - 1), np.arange(_ALL) == _ALL - 1),
    "compare": (np.isin(np.arange(len(COMPARE)), (59, 61, 62, 63, 64)), np.zeros(len(COMPARE), bool)),
}


def _with_voiced(x: np.ndarray) -> np.ndarray:
    """The _ALL columns from those of _egemaps_after()."""
    voiced = x[:, 10:11] > 0
    formants, levels = x[:, [EGEMAPS.index(c) for c in _NZ]], x[:, [EGEMAPS.index(c) for c in _V]]
    return np.column_stack((x[:, :-1], np.where(voiced, formants, 0), np.where(voiced, levels, 0), np.where(voiced, 0, levels[:, :5]), x[:, -1]))


def _smooth_egemaps(series: DataFrame, hold: int, block: int) -> DataFrame:
    """Packed columns of the set, and those beside them, smoothed."""
    return _every(_parted(series, "egemaps", hold, block), lambda blocks: _each(blocks, lambda *row: _block("egemaps", False, *row, hold, block)))


def compare(series: DataFrame, hold: int = 1, block: int = scans.BLOCK, delta: bool = False) -> DataFrame:
    """(stim, frame, features): the 65 columns of COMPARE, smoothed over three frames, and with `delta` their slopes over two frames on either side after them.

    The auditory spectrum is filtered over time (RASTA) in the logarithm. Zeros of what is unvoiced stay zero. An empty table gives an empty result; NULL samples are 0.
    """
    contours = lambda *row: _block("compare", delta, *row, hold, block)
    return _every(_parted(series, "compare", hold, block), lambda blocks: _each(blocks, contours, "features", block))


_TEN = ("amean", "stddevNorm", "percentile20.0", "percentile50.0", "percentile80.0", "pctlrange0-2", "meanRisingSlope", "stddevRisingSlope", "meanFallingSlope", "stddevFallingSlope")
#: Names of the 88 functionals of the eGeMAPS set: ten of pitch and of loudness, mean and spread of what isn't voice alone, of voice, of voiced levels; means of unvoiced ones; rates and lengths of segments; the sound level.
EGEMAPS_FUNCTIONALS = (
    *[f"F0semitoneFrom27.5Hz_sma3nz_{x}" for x in _TEN], *[f"loudness_sma3_{x}" for x in _TEN], *[f"{c}_sma3_{x}" for c in EGEMAPS[5:10] for x in _TEN[:2]],
    *[f"{c}_sma3nz_{x}" for c in EGEMAPS[11:] for x in _TEN[:2]], *[f"{c}_sma3nz_{x}" for c in ("alphaRatioV", "hammarbergIndexV", "slopeV0-500", "slopeV500-1500", "spectralFluxV", "mfcc1V", "mfcc2V", "mfcc3V", "mfcc4V") for x in _TEN[:2]],
    *[f"{c}_sma3nz_amean" for c in ("alphaRatioUV", "hammarbergIndexUV", "slopeUV0-500", "slopeUV500-1500", "spectralFluxUV")],
    "loudnessPeaksPerSec", "VoicedSegmentsPerSec", "MeanVoicedSegmentLengthSec", "StddevVoicedSegmentLengthSec", "MeanUnvoicedSegmentLength", "StddevUnvoicedSegmentLength", "equivalentSoundLevel_dBp",
)
#: Columns of _smooth_egemaps() whose zeros don't count; that of pitch, by which frames are voiced.
_COUNTED, _PITCH = (np.arange(_ALL) >= 10) & (np.arange(_ALL) < _ALL - 1), 10


def block_state(x: np.ndarray, voiced: np.ndarray, nonzero: np.ndarray) -> np.ndarray:
    """What a block tells of each column (number, mean, squares about it, least, largest value; without zeros where `nonzero`) and of the runs of voiced and other frames; block states merge."""
    there = (x != 0) | ~nonzero[None]
    n = there.sum(0)
    mean = np.where(there, x, 0).sum(0) / np.maximum(n, 1)
    out = np.column_stack((n, mean, np.where(there, (x - mean) ** 2, 0).sum(0), np.where(there, x, np.inf).min(0, initial=np.inf), np.where(there, x, -np.inf).max(0, initial=-np.inf))).ravel()
    edges = np.flatnonzero(np.diff(voiced.astype(int))) + 1
    lengths = np.diff(np.concatenate(([0], edges, [len(voiced)])))
    on = voiced[np.concatenate(([0], edges))]
    inner, flags = lengths[1:-1], on[1:-1]
    # Runs: the first and its flag, the last and its flag, whether they are one, then of those between: number, sum, squares, voiced and not.
    runs = [lengths[0], on[0], lengths[-1], on[-1], len(lengths) == 1]
    for flag in (True, False):
        own = inner[flags == flag].astype(float)
        runs += [len(own), own.sum(), (own**2).sum()]
    return np.array([*out, *runs], float)


def merged_states(states: list[np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, 5) numbers, means, squares, least and largest values, and of runs, voiced and other: number, sum and squares of their lengths; from the states of a series' blocks in order."""
    total = np.tile([0, 0.0, 0.0, np.inf, -np.inf], (columns, 1))
    runs, open_length, open_flag = np.zeros((2, 3)), 0.0, None

    def close(length: float, flag: float) -> None:
        runs[0 if flag else 1] += (1, length, length**2)

    for s in states:
        own = s[: 5 * columns].reshape(columns, 5)
        n = total[:, 0] + own[:, 0]
        d, safe = own[:, 1] - total[:, 1], np.maximum(n, 1)
        total[:, 2] += own[:, 2] + d * d * total[:, 0] * own[:, 0] / safe
        total[:, 1] += d * own[:, 0] / safe
        total[:, 0], total[:, 3], total[:, 4] = n, np.minimum(total[:, 3], own[:, 3]), np.maximum(total[:, 4], own[:, 4])
        head, first, tail, last, one = s[5 * columns : 5 * columns + 5]
        if open_flag is not None and open_flag != first:
            close(open_length, open_flag)
            open_length = 0.0
        open_length, open_flag = open_length + head, first
        if not one:
            close(open_length, open_flag)
            runs += s[5 * columns + 5 :].reshape(2, 3)
            open_length, open_flag = tail, last
    if open_flag is not None:
        close(open_length, open_flag)
    return total, runs


def egemaps_functionals(series: DataFrame, hold: int = 1, block: int = scans.BLOCK) -> DataFrame:
    """(stim, features): the 88 values of EGEMAPS_FUNCTIONALS of each stimulus.

    A stimulus of one block is summarised where its contours are. Blocks of longer ones are by states that merge (numbers, means, squares, runs with open edges), rises and falls by a scan that passes the
    last turn on, and percentiles come from distributed ranks. Zeros don't count where the set leaves out unvoiced (or voiced) frames. Slopes
    are by the second, between turns that differ by a tenth of the contour's range. What a stimulus has none of is 0. An empty table gives an empty result.
    """
    alone, rest = _parted(series, "egemaps", hold, block)
    contours = lambda *row: _block("egemaps", False, *row, hold, block)
    found = _each(alone, lambda *row: None if (x := contours(*row)) is None else _of_one_block(x), "figures")
    return found if rest is None else found.unionByName(_of_blocks(scans.written(_each(rest, contours)), block))


#: Shares of the values of pitch and loudness whose percentiles the set takes, and of their range by how much turns must differ.
_POINTS, _LEAST = (0.2, 0.5, 0.8), 0.1


def _of_one_block(x: np.ndarray) -> np.ndarray:
    """The 88 values of a stimulus whose contours are all there."""
    total, runs = merged_states([block_state(x, x[:, _PITCH] > 0, _COUNTED)], _ALL)
    found = {"total": total, "runs": runs}
    for k in (0, _PITCH):
        v = x[x[:, k] != 0, k] if k == _PITCH else x[:, k]
        at = scans.turning(v)
        found[f"slopes{k}"] = _pooled(scans.between_turns(at, v[at], _LEAST * (total[k, 4] - total[k, 3]))[None])
        found[f"points{k}"] = summaries.interpolated(v, _POINTS) if len(v) else None
    return np.array(_vector(found))


def _of_blocks(smooth: DataFrame, block: int) -> DataFrame:
    """(stim, features): the 88 values from the written contours of stimuli of any number of blocks."""
    by = ["stim"]

    def state(m: bytes, lead: int, trail: int) -> np.ndarray:
        x = scans.matrix(m, _ALL)
        return block_state(x, x[:, _PITCH] > 0, _COUNTED)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        total, runs = merged_states([np.frombuffer(m, float) for m in rows["m"]], _ALL)
        return pd.DataFrame({"stim": rows["stim"].iloc[:1], "total": [total.ravel()], "runs": [runs.ravel()]})

    stim = T.StructField("stim", smooth.schema["stim"].dataType)
    doubles = T.ArrayType(T.DoubleType())
    totals = scans.each_block(smooth, by, state).groupBy("stim").applyInPandas(lambda rows: merge(rows), T.StructType([stim, T.StructField("total", doubles), T.StructField("runs", doubles)]))
    totals = materialise(totals, "totals")
    spread = lambda k: (F.col("total")[5 * k + 4] - F.col("total")[5 * k + 3]).alias(f"spread{k}")
    with_range = scans.written(_by_stim(smooth, totals.select("stim", spread(0), spread(_PITCH))))
    found = totals
    for k in (0, _PITCH):
        steps = scans.turns(with_range, by, _ALL, k, f"spread{k}", _LEAST, k == _PITCH).groupBy("stim").applyInPandas(lambda rows: _slopes(rows), T.StructType([stim, T.StructField("slopes", doubles)]))
        found = _by_stim(found, steps.withColumnRenamed("slopes", f"slopes{k}"))
    frames = scans.unpack(smooth, by, _ALL, block=block)
    values = frames.select("stim", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("features")[k].alias("v")) for k in (0, _PITCH)])).alias("x")).select("stim", "x.k", "x.v").where("k = 0 or v <> 0")
    points = quantiles(values, ["stim", "k"], "v", _POINTS, "q")
    for k in (0, _PITCH):
        found = _by_stim(found, points.where(F.col("k") == k).select("stim", F.col("q").alias(f"points{k}")))

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame({"stim": rows["stim"], "features": [_vector(r) for r in rows.to_dict("records")]})

    return found.mapInPandas(finish, T.StructType([stim, T.StructField("features", doubles)]))


def _by_stim(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.withColumnRenamed("stim", "__stim")
    return left.join(other, F.col("stim").eqNullSafe(F.col("__stim")), "left").drop("__stim")


def _slopes(rows: pd.DataFrame) -> pd.DataFrame:
    """Number, mean and SD of rising and of falling slopes, from those of the blocks."""
    return pd.DataFrame({"stim": rows["stim"].iloc[:1], "slopes": [_pooled(np.stack([np.frombuffer(m, float) for m in rows["m"]]))]})


def _pooled(parts: np.ndarray) -> list[float]:
    out = []
    for n, mean, squares in (parts[:, :3].T, parts[:, 3:].T):
        total = n.sum()
        middle = (n * mean).sum() / total if total else 0.0
        out += [total, middle, np.sqrt((squares.sum() + (n * (mean - middle) ** 2).sum()) / total) if total else 0.0]
    return out


def _vector(r: dict) -> list[float]:
    """The 88 values from a stimulus' merged states, slopes and percentiles."""
    total, runs = np.asarray(r["total"], float).reshape(-1, 5), np.asarray(r["runs"], float).reshape(2, 3)
    seconds, step = total[0, 0] * SHIFT / RATE, SHIFT / RATE
    mean = lambda k: float(total[k, 1])
    norm = lambda k: float(np.sqrt(total[k, 2] / total[k, 0]) / abs(total[k, 1])) if total[k, 0] and total[k, 1] else 0.0
    out: list[float] = []
    for k in (_PITCH, 0):
        q, s = r[f"points{k}"], np.asarray(r[f"slopes{k}"], float)
        q = np.zeros(3) if q is None else np.asarray(q, float)
        out += [mean(k), norm(k), *q.tolist(), float(q[2] - q[0]), *(s[[1, 2, 4, 5]] / step).tolist()]
    n = len(EGEMAPS)
    voiced = [n + _NZ.index(c) if c in _NZ else EGEMAPS.index(c) for c in EGEMAPS[11:]]
    at = n + len(_NZ)
    for k in (*range(5, 10), *voiced, *range(at, at + len(_V))):
        out += [mean(k), norm(k)]
    out += [mean(k) for k in range(at + len(_V), _ALL - 1)]
    peaks = float(np.asarray(r["slopes0"])[0])
    lengths = [(float(s / c) * step, float(np.sqrt(max(0.0, q / c - (s / c) ** 2))) * step) if c else (0.0, 0.0) for c, s, q in runs]
    out += [peaks / seconds, float(runs[0, 0]) / seconds, *lengths[0], *lengths[1], float(10 * np.log10(max(total[-1, 1], 1e-12)))]
    return out


#: The figures that the ComParE set takes of a contour, of its groups of contours.
_RANGES = ("range", "maxPos", "minPos", "quartile1", "quartile2", "quartile3", "iqr1-2", "iqr2-3", "iqr1-3", "percentile1.0", "percentile99.0", "pctlrange0-1", "stddev", "skewness", "kurtosis")
_TIMES = ("upleveltime25", "upleveltime50", "upleveltime75", "upleveltime90", "risetime", "leftctime", "lpgain", "lpc0", "lpc1", "lpc2", "lpc3", "lpc4")
_SEGMENTS = ("meanSegLen", "maxSegLen", "minSegLen", "segLenStddev")
_LINES = ("linregc1", "linregc2", "linregerrQ", "qregc1", "qregc2", "qregc3", "qregerrQ", "centroid")
_PEAKS = ("meanPeakDist", "peakDistStddev", "peakRangeAbs", "peakRangeRel", "peakMeanAbs", "peakMeanMeanDist", "peakMeanRel", "minRangeRel", "meanRisingSlope", "stddevRisingSlope", "meanFallingSlope", "stddevFallingSlope")
#: Contours of COMPARE whose zeros count; the others are those of voice.
_LEVELS = 59


def _compare_plan() -> list[tuple[str, int, str]]:
    """Name, contour and figure of each functional of the ComParE set; contour 130 says where there is a pitch."""
    n, names = len(COMPARE), [f"{c}_sma{'' if k < _LEVELS else '3nz'}{d}" for d in ("", "_de") for k, c in enumerate(COMPARE)]
    of = lambda columns, figures: [(f"{names[k]}_{f}", k, f) for k in columns for f in figures]
    levels, slopes = range(_LEVELS), range(n, n + _LEVELS)
    voice_alone = (*range(_LEVELS, n), *range(n + _LEVELS, 2 * n))
    pitch = [("F0final_sma3nz_nnz", 2 * n, "amean"), *[(f"F0final_sma3nz_{f}", 2 * n, high) for f, high in zip(_SEGMENTS, ("meanHighLen", "maxHighLen", "minHighLen", "highLenStddev"))]]
    return [
        *of((*levels, *slopes), (*_RANGES, *_SEGMENTS, *_TIMES)), *of(voice_alone, ("amean", "posamean", "rqmean", "flatness", *_RANGES, *_LINES, *_TIMES)), *pitch,
        *of(levels, ("amean", "rqmean", "flatness", *_LINES, *_PEAKS)), *of(slopes, ("posamean", "rqmean", "flatness", *_PEAKS)),
    ]


_PLAN = _compare_plan()
#: Names of the 6,373 functionals of the ComParE set.
COMPARE_FUNCTIONALS = tuple(name for name, _, _ in _PLAN)


def compare_functionals(series: DataFrame, hold: int = 1, block: int = scans.BLOCK) -> DataFrame:
    """(stim, features): the 6,373 values of COMPARE_FUNCTIONALS of each stimulus.

    They are figures of summaries.functionals(), which says what each is; those of a stimulus of one block are taken where its contours are. Zeros of what describes voice don't count, in
    slopes neither; segments are those of the contour as it is, without a further running mean. What a stimulus has none of is 0. An empty table gives an empty result, as
    does a stimulus of less than a frame; NULL samples are 0.
    """
    n, k = len(COMPARE), len(summaries.FIGURES)
    nonzero = (*range(_LEVELS, n), *range(n + _LEVELS, 2 * n))
    at = np.array([c * k + summaries.FIGURES.index(f) for _, c, f in _PLAN])
    alone, rest = _parted(series, "compare", hold, block)
    contours = lambda *row: _block("compare", True, *row, hold, block)
    found = _each(alone, lambda *row: None if (x := contours(*row)) is None else summaries.whole(x, SHIFT / RATE, nonzero, (_LEVELS,)).ravel()[at], "figures")
    if rest is None:
        return found
    every = summaries.functionals(scans.written(_each(rest, contours)), ["stim"], 2 * n, SHIFT / RATE, nonzero, (_LEVELS,), block)

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield pd.DataFrame({"stim": rows["stim"], "features": [np.asarray(x)[at] for x in rows["figures"]]})

    return found.unionByName(every.mapInPandas(pick, T.StructType([every.schema["stim"], T.StructField("features", T.ArrayType(T.DoubleType()))])))
