"""Kernels of voice quality for the frames of one waveform: pitch candidates, periods, harmonics-to-noise ratio, formants, harmonics."""

from __future__ import annotations

import numpy as np

from stimframe.functions import signal

_TINY = 1e-12


def enhanced(mag: np.ndarray, at: np.ndarray, reach: int = 2) -> np.ndarray:
    """Magnitudes on an octave axis, (frames, points), smoothed over three points, zero beyond `reach` points from a local maximum, and weighted as the ear does low tones.

    The weight rises with the octave, as an arc tangent from 65 Hz on; so subharmonic summation sees partials and not what lies between.
    """
    x = np.pad(mag, ((0, 0), (1, 1)), "edge")
    x = 0.25 * x[:, :-2] + 0.5 * x[:, 1:-1] + 0.25 * x[:, 2:]
    top = np.zeros(x.shape, bool)
    top[:, 1:-1] = (x[:, 1:-1] >= x[:, :-2]) & (x[:, 1:-1] > x[:, 2:])
    near = top.copy()
    for k in range(1, reach + 1):
        near[:, k:] |= top[:, :-k]
        near[:, :-k] |= top[:, k:]
    return x * near * (0.5 + np.arctan(3 * np.log2(at / 65.0)) / np.pi)


def pitch_candidates(f: np.ndarray, rate: int, n: int = 6, low: float = 55.0, high: float = 1000.0, harmonics: int = 15, compression: float = 0.85, per_octave: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(frames, n) frequencies of the highest subharmonic sums between low and high, highest first, and how voiced each is; 0 where a frame has fewer.

    Voicing is 1 less the mean sum over the candidate's, from 0 to 1. Peaks are refined by a parabola through their neighbours.
    """
    if not len(f):
        return np.zeros((0, n)), np.zeros((0, n))
    n_fft = 4 << (f.shape[1] - 1).bit_length()
    mag = np.abs(np.fft.rfft((f - f.mean(1, keepdims=True)) * signal.window("gauss", f.shape[1]), n_fft))
    span = int(np.ceil(np.log2(high / low) * per_octave)) + 3
    reach = int(np.ceil(np.log2(harmonics) * per_octave))
    spectrum, at = signal.octave_spectrum(mag, np.fft.rfftfreq(n_fft, 1 / rate), low * 2 ** (-1 / per_octave), per_octave, span + reach + 1)
    spectrum = enhanced(spectrum, at)
    sums = sum(compression ** (k - 1) * spectrum[:, (s := round(np.log2(k) * per_octave)) : s + span] for k in range(1, harmonics + 1))
    inner = sums[:, 1:-1]
    peak = np.where((inner > sums[:, :-2]) & (inner >= sums[:, 2:]), inner, 0.0)
    best = np.argsort(-peak, 1, kind="stable")[:, :n] + 1
    rows = np.arange(len(f))[:, None]
    a, b, c = sums[rows, best - 1], sums[rows, best], sums[rows, best + 1]
    bend = a - 2 * b + c
    shift = np.clip(np.where(bend < 0, (a - c) / np.where(bend < 0, 2 * bend, 1), 0.0), -0.5, 0.5)
    there = peak[rows, best - 1] > _TINY
    voicing = np.clip(1 - sums.mean(1, keepdims=True) / np.maximum(b, _TINY), 0, 1)
    return np.where(there, at[0] * 2 ** ((best + shift) / per_octave), 0.0), np.where(there, voicing, 0.0)


#: Weights of the pitch smoother (jumps between voiced frames, between voiced and unvoiced ones, between unvoiced ones; voicing under or over the threshold; voicing; frequency range), and the threshold of voicing.
WEIGHTS = {"vv": 10.0, "vuv": 10.0, "uu": 0.0, "threshold": 4.0, "local": 2.0, "range": 1.0}
CUTOFF = 0.7


def pitch_costs(f0: np.ndarray, voicing: np.ndarray, weights: dict[str, float] = WEIGHTS, cutoff: float = CUTOFF, usual: tuple[float, float] = (75.0, 500.0)) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the states of each frame, (frames, n + 1), and of each step into a frame, (frames, n + 1, n + 1); the last state is unvoiced.

    A voiced state costs what its voicing lacks, more under the cutoff, and the octaves by which it leaves the usual range; the
    unvoiced one costs what the best candidate has over the cutoff. Steps between voiced states cost the octaves between them. What isn't a candidate costs infinitely.
    """
    w, n = weights, f0.shape[1]
    there = f0 > 0
    tone = np.log2(np.where(there, f0, 1.0))
    away = np.maximum(0, np.maximum(np.log2(usual[0]) - tone, tone - np.log2(usual[1])))
    local = np.empty((len(f0), n + 1))
    local[:, :n] = np.where(there, w["local"] * (1 - voicing) + w["threshold"] * np.maximum(0, cutoff - voicing) + w["range"] * away, np.inf)
    local[:, n] = w["threshold"] * np.maximum(0, voicing.max(1, initial=0) - cutoff) + w["local"] * np.where(voicing.max(1, initial=0) > cutoff, 1.0, 0.0)
    step = np.full((len(f0), n + 1, n + 1), w["vuv"])
    if len(f0):
        step[0, :n, :n] = 0.0
        step[1:, :n, :n] = w["vv"] * np.abs(tone[:-1, :, None] - tone[1:, None, :])
    step[:, n, n] = w["uu"]
    return local, step


def periods(wave: np.ndarray, start: int, f0: float, rate: int, count: int = 4, reach: float = 0.1, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (in samples) and peak-to-peak amplitudes of up to `count` periods in a row from about `start` on.

    The first period is laid around the largest sample of the first period length. Each is as long as the lag, within `reach` of the expected one, at which a
    period's length of samples correlates best with what follows, refined by a parabola; a period that correlates by less than `least` ends the row.
    """
    t0 = rate / f0
    n, lo, hi = int(round(t0)), int(np.floor(t0 * (1 - reach))), int(np.ceil(t0 * (1 + reach)))
    head = wave[start : start + n]
    if not len(head):
        return np.empty(0), np.empty(0)
    p = float(max(0, start + int(np.abs(head).argmax()) - int(0.3 * t0)))
    lengths, sizes = [], []
    while len(lengths) < count:
        k = int(round(p))
        if k + hi + 1 + n > len(wave):
            break
        a = wave[k : k + n] - wave[k : k + n].mean()
        b = np.lib.stride_tricks.sliding_window_view(wave[k + lo - 1 : k + hi + 1 + n], n)
        b = b - b.mean(1, keepdims=True)
        cc = b @ a / np.sqrt(np.maximum((b * b).sum(1) * (a @ a), _TINY))
        at = 1 + int(cc[1:-1].argmax())
        if cc[at] < least:
            break
        x, y, z = cc[at - 1 : at + 2]
        bend = x - 2 * y + z
        length = lo - 1 + at + (float(np.clip((x - z) / (2 * bend), -0.5, 0.5)) if bend < 0 else 0.0)
        lengths.append(length)
        sizes.append(_top(wave[k : k + n]) + _top(-wave[k : k + n]))
        p += length
    return np.array(lengths), np.array(sizes)


def _top(x: np.ndarray) -> float:
    """The largest value, by a parabola through its neighbours."""
    k = int(x.argmax())
    if not 0 < k < len(x) - 1:
        return float(x[k])
    a, b, c = x[k - 1 : k + 2]
    bend = a - 2 * b + c
    return float(b - (a - c) ** 2 / (8 * bend)) if bend < 0 else float(b)


def jitter(lengths: np.ndarray) -> tuple[float, float]:
    """Mean change from one period to the next, and mean change of that change, as shares of the mean period; 0 with too few periods."""
    mean = lengths.mean() if len(lengths) else 0.0
    d = np.diff(lengths)
    return (float(np.abs(d).mean() / mean) if len(d) else 0.0), (float(np.abs(np.diff(d)).mean() / mean) if len(d) > 1 else 0.0)


def shimmer(sizes: np.ndarray) -> tuple[float, float]:
    """Mean change of amplitude from one period to the next, as a share of the mean amplitude and in dB; 0 with too few periods."""
    if len(sizes) < 2 or sizes.min() <= 0:
        return 0.0, 0.0
    return float(np.abs(np.diff(sizes)).mean() / sizes.mean()), float(np.abs(np.diff(20 * np.log10(sizes))).mean())


def noise_ratio(x: np.ndarray, f0: float, rate: int) -> float:
    """Harmonics-to-noise ratio in dB, from the normalised correlation of the samples with those a period on; within -60 to 60."""
    t0 = rate / f0
    best = 0.0
    for lag in range(max(1, int(t0 * 0.95)), int(np.ceil(t0 * 1.05)) + 1):
        a, b = x[:-lag] - x[:-lag].mean(), x[lag:] - x[lag:].mean()
        best = max(best, float(a @ b / np.sqrt(max((a @ a) * (b @ b), _TINY))))
    best = min(max(best, 1e-6), 1 - 1e-6)
    return 10 * np.log10(best / (1 - best))


def levinson_rows(r: np.ndarray, order: int) -> np.ndarray:
    """signal.levinson() for many rows of autocorrelations at once: prediction coefficients, (rows, order)."""
    a, error = np.zeros((len(r), order + 1)), r[:, 0].copy()
    a[:, 0] = 1.0
    for i in range(1, order + 1):
        live = error > _TINY
        k = np.where(live, -(a[:, :i] * r[:, i:0:-1]).sum(1) / np.where(live, error, 1.0), 0.0)
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i]
        error = error * (1 - k * k)
    return a[:, 1:]


def formants(f: np.ndarray, rate: int, n: int = 5, order: int = 11, to: int = 11_000, low: float = 50.0, high: float = 5450.0) -> tuple[np.ndarray, np.ndarray]:
    """(frames, n) formant frequencies, ascending, and bandwidths in Hz; 0 where a frame has fewer.

    Frames are resampled by their spectra, predicted linearly by `order` coefficients, and the roots of the prediction polynomials are
    the eigenvalues of their companion matrices, found for all frames at once.
    """
    if not len(f):
        return np.zeros((0, n)), np.zeros((0, n))
    length = max(order + 2, int(round(f.shape[1] * to / rate)))
    spectrum = np.fft.rfft(f * signal.window("hamming", f.shape[1]))
    bins = length // 2 + 1
    spectrum = np.pad(spectrum, ((0, 0), (0, max(0, bins - spectrum.shape[1]))))[:, :bins]
    x = np.fft.irfft(spectrum, length)
    power = np.abs(np.fft.rfft(x, 2 * length)) ** 2
    a = levinson_rows(np.fft.irfft(power)[:, : order + 1], order)
    companion = np.zeros((len(f), order, order))
    companion[:, 0] = -a
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1.0
    roots = np.linalg.eigvals(companion)
    hz = np.angle(roots) * to / (2 * np.pi)
    width = -np.log(np.maximum(np.abs(roots), _TINY)) * to / np.pi
    ok = (roots.imag > 1e-9) & (hz >= low) & (hz <= high)
    by = np.argsort(np.where(ok, hz, np.inf), 1, kind="stable")[:, :n]
    rows = np.arange(len(f))[:, None]
    return np.where(ok[rows, by], hz[rows, by], 0.0), np.where(ok[rows, by], width[rows, by], 0.0)


def harmonic_levels(x: np.ndarray, f0: float, rate: int, at: np.ndarray, reach: float = 0.2) -> np.ndarray:
    """Of a frame with that pitch: H1 over H2, H1 over the strongest harmonic at the third formant, and the strongest harmonic at each formant over H1, in dB.

    A harmonic is the largest magnitude within a quarter of the pitch about its frequency. At a formant are the harmonics within `reach` of its frequency, or the nearest one. Formants of 0 give 0.
    """
    n_fft = 4 << (len(x) - 1).bit_length()
    mag = np.abs(np.fft.rfft(x * signal.window("gauss", len(x)), n_fft))
    step = rate / n_fft
    n = max(2, int((rate / 2 - f0 / 4) / f0))
    wide = max(1, int(f0 / 4 / step))
    k = np.round(np.arange(1, n + 1) * f0 / step).astype(int)[:, None] + np.arange(-wide, wide + 1)[None]
    level = 20 * np.log10(np.maximum(np.where(k < len(mag), mag[np.minimum(k, len(mag) - 1)], 0.0).max(1), _TINY))
    hz = np.arange(1, n + 1) * f0
    over = []
    for formant in at[:3]:
        if formant <= 0:
            over.append(0.0)
            continue
        near = np.abs(hz - formant) <= reach * formant
        over.append(float((level[near].max() if near.any() else level[np.abs(hz - formant).argmin()]) - level[0]))
    return np.array([level[0] - level[1], -over[2] if len(over) > 2 else 0.0, *over])


def mel_cepstrum(f: np.ndarray, rate: int, first: int = 1, last: int = 4, bands: int = 26, lifter: int = 22, low: float = 20.0, high: float = 8000.0) -> np.ndarray:
    """Cepstral coefficients first to last of each frame, (frames, last - first + 1): power spectrum, HTK mels, natural log (of at least 1e-8), DCT, liftered."""
    n_fft = 1 << (f.shape[1] - 1).bit_length()
    power = np.abs(np.fft.rfft(f * signal.window("hamming", f.shape[1]), n_fft)) ** 2
    logs = np.log(np.maximum(power @ signal.mel_bank(bands, n_fft, rate, low, min(high, rate / 2)).T, 1e-8))
    k = np.arange(first, last + 1)
    basis = np.sqrt(2 / bands) * np.cos(np.pi / bands * (np.arange(bands) + 0.5)[None] * k[:, None])
    return logs @ basis.T * (1 + lifter / 2 * np.sin(np.pi * k / lifter))


def equal_loudness(hz: np.ndarray) -> np.ndarray:
    """Weight of a power at a frequency, after the 40-phon curve of perceptual linear prediction (Hermansky 1990)."""
    w = (2 * np.pi * np.asarray(hz, float)) ** 2
    return (w + 56.8e6) * w**2 / ((w + 6.3e6) ** 2 * (w + 0.38e9))


def mel_power(f: np.ndarray, rate: int, bands: int = 26, low: float = 20.0, high: float = 8000.0) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bands) power in mel bands, and the weight of equal loudness at each band's centre, largest 1."""
    n_fft = 1 << (f.shape[1] - 1).bit_length()
    top = min(high, rate / 2)
    power = np.abs(np.fft.rfft(f * signal.window("hamming", f.shape[1]), n_fft)) ** 2 @ signal.mel_bank(bands, n_fft, rate, low, top).T
    centre = signal.mel_to_hz(np.linspace(signal.hz_to_mel(low), signal.hz_to_mel(top), bands + 2)[1:-1])
    w = equal_loudness(centre)
    return power, w / w.max()


def harmonicity(mag: np.ndarray) -> np.ndarray:
    """Of each spectrum: the mean drop from local maxima to the minima after them, as a share of the mean magnitude."""
    left, mid, right = mag[:, :-2], mag[:, 1:-1], mag[:, 2:]
    top, low = (mid > left) & (mid >= right), (mid < left) & (mid <= right)
    n = np.minimum(top.sum(1), low.sum(1))
    drop = np.where(top, mid, 0).sum(1) / np.maximum(top.sum(1), 1) - np.where(low, mid, 0).sum(1) / np.maximum(low.sum(1), 1)
    return np.where(n > 0, drop / np.maximum(mag.mean(1), _TINY), 0.0)


def sharpness(mag: np.ndarray, hz: np.ndarray) -> np.ndarray:
    """Centroid in Bark of each spectrum's power, the bands over 15 Bark weighted more (Zwicker)."""
    z = 6 * np.arcsinh(hz / 600)
    g = np.where(z < 15, 1.0, 0.066 * np.exp(0.171 * z))
    power = mag**2
    return power @ (z * g) / np.maximum(power.sum(1), _TINY)
