"""Framewise features of waveforms: an extractor is a function of one waveform, run on the rows of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimframe.functions import signal
from stimframe.operators import scans
from stimframe.session import materialise

#: An extractor takes a waveform and its rate and gives a (frames, features) matrix and the (frames, 2) times in seconds.
Extractor = Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]
EXTRACTORS: dict[str, Callable[..., Extractor]] = {}


def register(name: str):
    """Make a factory of extractors known by name; neural encoders join the same way, loading their weights inside."""

    def add(factory: Callable[..., Extractor]):
        EXTRACTORS[name] = factory
        return factory

    return add


def _times(n: int, length: int, shift: int, rate: int) -> np.ndarray:
    start = np.arange(n) * shift / rate
    return np.column_stack((start, start + length / rate))


@register("fbank")
def fbank(bands: int = 23, length_ms: float = 25.0, shift_ms: float = 20.0) -> Extractor:
    def run(wave: np.ndarray, rate: int):
        m = signal.log_mel(wave, rate, bands, length_ms, shift_ms)
        return m, _times(len(m), int(rate * length_ms / 1000), int(rate * shift_ms / 1000), rate)

    return run


@register("mfcc")
def mfcc(n_mfcc: int = 20, hop: int = 512) -> Extractor:
    def run(wave: np.ndarray, rate: int):
        m = signal.mfcc(wave, rate, n_mfcc, hop=hop).T
        return m, _times(len(m), hop, hop, rate)

    return run


@register("lld")
def low_level(length_ms: float = 25.0, shift_ms: float = 20.0) -> Extractor:
    """RMS, zero crossings, pitch (0 if unvoiced) and the shape of the spectrum."""

    def run(wave: np.ndarray, rate: int):
        n, shift = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
        f = signal.frames(np.asarray(wave, float), n, shift)
        if not len(f):
            return np.empty((0, 14)), np.empty((0, 2))
        shape = signal.spectral_shape(f, rate)
        return np.column_stack((signal.rms(f), signal.zero_crossings(f), signal.pitch(f, rate), *shape.values())), _times(len(f), n, shift, rate)

    return run


#: Names of the voice extractor's columns, in their order.
VOICE = ("f0", "loudness", "band_250_650", "band_1000_4000", "alpha", "hammarberg", "slope_0_500", "slope_500_1500")


@register("voice")
def voice(length_ms: float = 25.0, shift_ms: float = 20.0) -> Extractor:
    """Pitch by subharmonic summation, and levels and slopes of bands: the columns VOICE."""

    def run(wave: np.ndarray, rate: int):
        n, shift = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
        f = signal.frames(np.asarray(wave, float), n, shift)
        if not len(f):
            return np.empty((0, len(VOICE))), np.empty((0, 2))
        return np.column_stack((signal.pitch_shs(f, rate), *signal.band_levels(f, rate).values())), _times(len(f), n, shift, rate)

    return run


def select_outputs(features: DataFrame, names: tuple[str, ...], wanted: tuple[str, ...]) -> DataFrame:
    """features with the wanted columns alone, in that order."""
    return features.withColumn("features", F.array(*[F.col("features")[names.index(w)] for w in wanted]))


def extract(waves: DataFrame, feature: str, min_samples: int = 1, module: str = "out", **parameters) -> DataFrame:
    """(stim, module, frame, features, t_start, t_end) of (stim, sample_rate, waveform) rows.

    Stimuli shorter than min_samples have no frames. One waveform at a time is held, and its frames go out in pieces.
    """
    if feature not in EXTRACTORS:
        raise ValueError(f"no extractor named {feature!r}; there are {sorted(EXTRACTORS)}")
    run = EXTRACTORS[feature](**parameters)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for stim, rate, wave in zip(part["stim"], part["sample_rate"], part["waveform"]):
                if wave is None or len(wave) < min_samples:
                    continue
                m, t = run(np.asarray(wave, float), int(rate))
                for at in range(0, len(m), 10_000):
                    k = slice(at, at + 10_000)
                    yield pd.DataFrame({"stim": stim, "module": module, "frame": np.arange(at, at + len(m[k]), dtype=np.int32), "features": list(m[k]), "t_start": t[k, 0], "t_end": t[k, 1]})

    return waves.select("stim", "sample_rate", "waveform").mapInPandas(rows, "stim string, module string, frame int, features array<double>, t_start double, t_end double")


#: Of the extractors that work by blocks of frames: samples of a frame and of its shift, zeros before and after the waveform, frames before a block that it needs, values of a frame.
SHAPES = {"fbank": (400, 320, 0, 0, 23), "mfcc": (2048, 512, 1024, 0, 128), "lld": (400, 320, 0, 1, 14), "voice": (400, 320, 0, 0, len(VOICE))}


def value_blocks(series: DataFrame, hold: int = 1, block: int = scans.BLOCK, length: int = 400, shift: int = 320, lead: int = 0, after: int = 0, pad: int = 0) -> DataFrame:
    """(stim, block, first, values): the values that the samples of each block come from, as 32-bit floats, and the place of the first; samples() lays them out. Parameters are those of wave_blocks()."""
    low = F.col("i") * hold + pad  # counted from the padding
    first = F.floor((low - after - length) / shift / block)
    last = F.floor((F.floor((low + hold - 1) / shift) + lead) / block)
    dealt = series.select("stim", "i", F.coalesce(F.col("value"), F.lit(0.0)).cast("float").alias("value"), F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("block"))
    rows = scans.spread(dealt, "stim", "block").groupBy("stim", "block").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("rows"))
    return rows.select("stim", "block", F.col("rows")[0]["i"].cast("long").alias("first"), F.col("rows")["value"].alias("values"))


def samples(b: int, first: int, values: np.ndarray, hold: int, block: int, length: int, shift: int, lead: int = 0, after: int = 0, pad: int = 0) -> tuple[int, np.ndarray]:
    """Of a row of value_blocks(): how many frames are before the block, and the samples from there on; none if they have no whole frame of the block."""
    own = min(lead, b * block)
    begin, end = (b * block - own) * shift - pad, (b * block + block - 1) * shift + length + after - pad
    at = first * hold
    held = np.repeat(values, hold)
    wave = np.concatenate((np.zeros(max(0, at - begin), np.float32), held[max(0, begin - at) :]))[: end - begin]
    if pad and at + len(held) < end:  # the stimulus ends here
        wave = np.concatenate((wave, np.zeros(min(pad, end - at - len(held)), np.float32)))
    return own, wave.astype(np.float32) if len(wave) >= own * shift + length else np.empty(0, np.float32)


def wave_blocks(series: DataFrame, hold: int = 1, block: int = scans.BLOCK, length: int = 400, shift: int = 320, lead: int = 0, after: int = 0, pad: int = 0) -> DataFrame:
    """(stim, block, lead, trail, m, wave): the samples of each block of frames, as 32-bit floats, of (stim, i, value) rows.

    Value i of a stimulus (from 0, without gaps) is held for `hold` samples; there are `pad` zeros before the first and after the last. The samples go
    `lead` frames back and `after` samples on, as far as the stimulus does. A block without a whole frame is left out; NULL values are 0. m is empty: kernels fill it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, leads, waves = [], [], []
            for k, (b, first, v) in enumerate(zip(batch.column("block").to_pylist(), batch.column("first").to_pylist(), batch.column("values"))):
                own, wave = samples(b, first, v.values.to_numpy(), hold, block, length, shift, lead, after, pad)
                if len(wave):
                    keep.append(k)
                    leads.append(own)
                    waves.append(wave.tobytes())
            kept = batch.take(pa.array(keep, pa.int32()))
            n = len(keep)
            yield pa.RecordBatch.from_arrays([kept.column("stim"), kept.column("block"), pa.array(leads, pa.int32()), pa.repeat(pa.scalar(0, pa.int32()), n), pa.array([b""] * n, pa.binary()), pa.array(waves, pa.binary())], names=["stim", "block", "lead", "trail", "m", "wave"])

    rows = value_blocks(series, hold, block, length, shift, lead, after, pad)
    return rows.mapInArrow(run, T.StructType([*scans.packed_schema(series.withColumn("block", F.lit(0)), ["stim"]), T.StructField("wave", T.BinaryType())]))


def extract_series(series: DataFrame, feature: str, hold: int, rate: int = 16_000, block: int = 2048) -> DataFrame:
    """(stim, frame, features) of (stim, i, value) rows, value i of a stimulus held for `hold` samples, with the default parameters.

    Equal to extract() on whole waveforms, but works on blocks of frames with the samples that they overlap, so that no
    task and no row holds a whole stimulus. The top that MFCC needs is joined back from an aggregate.
    """
    length, shift, pad, lead, width = SHAPES[feature]
    run = signal.mel_db if feature == "mfcc" else EXTRACTORS[feature]()

    def kernel(m: bytes, ahead: int, trail: int, wave: bytes) -> np.ndarray:
        out = run(np.frombuffer(wave, np.float32).astype(float), rate)
        return (out if feature == "mfcc" else out[0])[ahead : ahead + block]

    packed = scans.each_block(wave_blocks(series, hold, block, length, shift, lead, 0, pad), ["stim"], kernel, "wave")
    if feature == "mfcc":
        packed = materialise(packed, "mel")
        highest = scans.each_block(packed, ["stim"], lambda m, lead, trail: np.frombuffer(m, float).max(keepdims=True))
        top = scans.unpack(highest, ["stim"], 1).groupBy(F.col("stim").alias("__stim")).agg(F.max(F.col("features")[0]).alias("top"))
        packed = packed.join(top, F.col("stim").eqNullSafe(F.col("__stim"))).drop("__stim")
        packed = scans.each_block(packed, ["stim"], lambda m, lead, trail, top: np.maximum(scans.matrix(m, 128), top - 80) @ signal.dct(128, 20).T, "top")
        width = 20
    return scans.unpack(packed, ["stim"], width, block=block).select("stim", F.col("frame").cast("int").alias("frame"), "features")


def pad_silence(waves: DataFrame, samples: int) -> DataFrame:
    """waves with that many zeros in front; unpad() takes the time off again."""
    return waves.withColumn("waveform", F.concat(F.array_repeat(F.lit(0.0).cast("float"), samples), "waveform"))


def unpad(features: DataFrame, seconds: float) -> DataFrame:
    """features without the frames that end in the padding, on the unpadded clock."""
    return features.where(F.col("t_end") > seconds).withColumns({"t_start": F.greatest(F.col("t_start") - seconds, F.lit(0.0)), "t_end": F.col("t_end") - seconds})


def snippet_waves(waves: DataFrame, chunk: int, context: int, full: bool = True, stride: int | None = None) -> DataFrame:
    """A row for each window of a waveform: (stim, snip, s_start, s_end, sample_rate, waveform); with a stride windows of that length move on by it."""
    from stimframe.operators.align import snippets, with_stride

    chunk, context = with_stride(chunk, context, stride)

    cut = waves.select("stim", "sample_rate", "waveform", F.posexplode(snippets(F.size("waveform"), chunk, context, full)).alias("snip", "w"))
    return cut.select("stim", "snip", "w.s_start", "w.s_end", "sample_rate", F.slice("waveform", F.col("w.s_start") + 1, F.col("w.s_end") - F.col("w.s_start")).alias("waveform"))
