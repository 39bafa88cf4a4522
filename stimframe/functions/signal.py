"""Spectral kernels for one waveform, with numpy; Spark calls them on the rows of Arrow batches."""

from __future__ import annotations

import numpy as np


def frame_count(n: int, length: int, shift: int) -> int:
    """Whole frames in n samples."""
    return 0 if n < length else 1 + (n - length) // shift


def frames(wave: np.ndarray, length: int, shift: int) -> np.ndarray:
    """A view of the whole frames of a waveform, one in each row."""
    k = frame_count(len(wave), length, shift)
    return np.lib.stride_tricks.sliding_window_view(wave, length)[::shift][:k] if k else np.empty((0, length))


def window(kind: str, n: int, sigma: float = 0.4) -> np.ndarray:
    t = np.arange(n)
    if kind == "povey":
        return (0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1))) ** 0.85
    if kind == "hamming":
        return np.hamming(n)
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * t / n)
    if kind == "gauss":
        half = (n - 1) / 2
        return np.exp(-0.5 * ((t - half) / (sigma * half)) ** 2)
    raise ValueError(f"no window named {kind!r}")


def hz_to_mel(hz, scale: str = "htk"):
    """HTK: 1127 ln(1 + f / 700); slaney: linear to 1000 Hz, logarithmic above."""
    hz = np.asarray(hz, float)
    if scale == "htk":
        return 1127.0 * np.log1p(hz / 700.0)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def mel_to_hz(mel, scale: str = "htk"):
    mel = np.asarray(mel, float)
    if scale == "htk":
        return 700.0 * np.expm1(mel / 1127.0)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(np.log(6.4) * (mel - 15) / 27))


def mel_bank(bands: int, n_fft: int, rate: int, low: float, high: float, scale: str = "htk", area: bool = False) -> np.ndarray:
    """Triangular filters over the bins of a spectrum, (bands, bins). HTK triangles are straight in mel, Slaney's in Hz with unit area."""
    hz = np.fft.rfftfreq(n_fft, 1 / rate)
    edges = np.linspace(hz_to_mel(low, scale), hz_to_mel(high, scale), bands + 2)
    x = hz_to_mel(hz, scale)
    if scale != "htk":
        x, edges = hz, mel_to_hz(edges, scale)
    up = (x[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - x[None]) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    return bank * (2 / (edges[2:] - edges[:-2]))[:, None] if area else bank


def log_mel(wave: np.ndarray, rate: int = 16_000, bands: int = 23, length_ms: float = 25.0, shift_ms: float = 20.0, preemphasis: float = 0.97, low: float = 20.0) -> np.ndarray:
    """Log-mel filterbank, (frames, bands): mean removed from each frame, pre-emphasis, Povey window, power spectrum, HTK mels, natural log."""
    n, shift = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
    f = frames(np.asarray(wave, float), n, shift)
    if not len(f):
        return np.empty((0, bands))
    f = f - f.mean(1, keepdims=True)
    f = np.column_stack((f[:, :1] * (1 - preemphasis), f[:, 1:] - preemphasis * f[:, :-1])) * window("povey", n)
    n_fft = 1 << (n - 1).bit_length()
    power = np.abs(np.fft.rfft(f, n_fft)) ** 2
    return np.log(np.maximum(power @ mel_bank(bands, n_fft, rate, low, rate / 2).T, np.finfo(np.float32).eps))


def dct(n: int, k: int) -> np.ndarray:
    """Orthonormal DCT-II, (k, n)."""
    m = np.cos(np.pi / n * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None]) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def mel_db(padded: np.ndarray, rate: int = 16_000, n_fft: int = 2048, hop: int = 512, bands: int = 128, high: float = 8000.0) -> np.ndarray:
    """Slaney mels in dB, (frames, bands), of a waveform with its padding."""
    power = np.abs(np.fft.rfft(frames(padded, n_fft, hop) * window("hann", n_fft))) ** 2
    return 10 * np.log10(np.maximum(power @ mel_bank(bands, n_fft, rate, 0.0, high, "slaney", True).T, 1e-10))


def mfcc(wave: np.ndarray, rate: int = 16_000, n_mfcc: int = 20, n_fft: int = 2048, hop: int = 512, bands: int = 128, high: float = 8000.0) -> np.ndarray:
    """MFCCs, (n_mfcc, frames): centred frames, Hann window, power, Slaney mels, dB within 80 of the top, DCT."""
    db = mel_db(np.pad(np.asarray(wave, float), n_fft // 2), rate, n_fft, hop, bands, high)
    return dct(bands, n_mfcc) @ np.maximum(db, db.max() - 80).T if len(db) else np.empty((n_mfcc, 0))


def rms(f: np.ndarray) -> np.ndarray:
    return np.sqrt((f * f).mean(1))


def zero_crossings(f: np.ndarray) -> np.ndarray:
    """Share of neighbouring samples of different sign."""
    return (np.signbit(f[:, 1:]) != np.signbit(f[:, :-1])).mean(1)


def spectral_shape(f: np.ndarray, rate: int, kind: str = "hamming") -> dict[str, np.ndarray]:
    """Centroid, variance, skewness, kurtosis, entropy, slope, flux and roll-off points of the magnitude spectrum of each frame."""
    mag = np.abs(np.fft.rfft(f * window(kind, f.shape[1])))
    hz = np.fft.rfftfreq(f.shape[1], 1 / rate)
    total = np.maximum(mag.sum(1, keepdims=True), 1e-12)
    p = mag / total
    centroid = p @ hz
    dev = hz[None] - centroid[:, None]
    var = (p * dev**2).sum(1)
    sd = np.sqrt(np.maximum(var, 1e-12))
    out = {"centroid": centroid, "variance": var, "skewness": (p * dev**3).sum(1) / sd**3, "kurtosis": (p * dev**4).sum(1) / sd**4}
    out["entropy"] = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    x = hz - hz.mean()
    out["slope"] = (mag - mag.mean(1, keepdims=True)) @ x / (x @ x)
    out["flux"] = np.concatenate((np.zeros(1), np.sqrt(((p[1:] - p[:-1]) ** 2).sum(1)))) if len(p) else np.empty(0)
    energy = np.cumsum(mag**2, 1)
    for q in (0.25, 0.5, 0.75, 0.9):
        out[f"rolloff{round(q * 100)}"] = hz[(energy >= q * energy[:, -1:]).argmax(1)]
    return out


def pitch(f: np.ndarray, rate: int, low: float = 55.0, high: float = 620.0, least: float = 0.45, silence: float = 0.001) -> np.ndarray:
    """Fundamental frequency by the first of the highest peaks of the normalised autocorrelation; 0 for frames that are silent or without a clear peak."""
    n = f.shape[1]
    x = f - f.mean(1, keepdims=True)
    ac = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2)[:, :n]
    ac = ac / np.maximum(ac[:, :1], 1e-12) * (n / np.maximum(n - np.arange(n), 1))
    a, b = int(rate / high), min(int(rate / low), n // 2)
    if b <= a or not len(f):
        return np.zeros(len(f))
    part = ac[:, a:b]
    peak = (part >= ac[:, a - 1 : b - 1]) & (part >= ac[:, a + 1 : b + 1]) & (part >= 0.9 * part.max(1, keepdims=True))
    at = np.where(peak.any(1), peak.argmax(1), part.argmax(1))  # of multiples of a period the shortest
    clear = (ac[np.arange(len(f)), a + at] >= least) & (rms(f) > silence)
    return np.where(clear, rate / (a + at), 0.0)


def octave_spectrum(mag: np.ndarray, hz: np.ndarray, low: float = 25.0, per_octave: int = 48, points: int = 384) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes on a logarithmic axis of frequencies, (frames, points), by linear interpolation, and the frequencies; 0 above the spectrum."""
    at = low * 2.0 ** (np.arange(points) / per_octave)
    step = hz[1] - hz[0]
    k = np.minimum((at / step).astype(int), len(hz) - 2)
    part = at / step - k
    return np.where(at <= hz[-1], mag[:, k] * (1 - part) + mag[:, k + 1] * part, 0.0), at


def pitch_shs(f: np.ndarray, rate: int, low: float = 55.0, high: float = 620.0, harmonics: int = 15, compression: float = 0.85, least: float = 3.0, silence: float = 0.001) -> np.ndarray:
    """Fundamental frequency by subharmonic summation; 0 for frames that are silent or whose best sum is under `least` times the mean sum.

    The spectrum on an octave axis is shifted by log2 of each harmonic and summed with weights compression**(n - 1); the
    best sum between low and high, refined by a parabola through its neighbours, is the pitch.
    """
    n_fft = 4 << (f.shape[1] - 1).bit_length()
    mag = np.abs(np.fft.rfft((f - f.mean(1, keepdims=True)) * window("hann", f.shape[1]), n_fft))
    hz, per = np.fft.rfftfreq(n_fft, 1 / rate), 48
    span = int(np.ceil(np.log2(high / low) * per)) + 3
    reach = int(np.ceil(np.log2(harmonics) * per))
    spectrum, at = octave_spectrum(mag, hz, low * 2 ** (-1 / per), per, span + reach + 1)
    sums = sum(compression ** (n - 1) * spectrum[:, (k := round(np.log2(n) * per)) : k + span] for n in range(1, harmonics + 1))
    if not len(f):
        return np.zeros(0)
    best = sums[:, 1:-1].argmax(1) + 1
    rows = np.arange(len(f))
    a, b, c = sums[rows, best - 1], sums[rows, best], sums[rows, best + 1]
    shift = np.where(a - 2 * b + c < 0, (a - c) / np.where(a - 2 * b + c < 0, 2 * (a - 2 * b + c), 1), 0.0)
    clear = (b >= least * np.maximum(sums.mean(1), 1e-12)) & (rms(f) > silence)
    return np.where(clear, at[0] * 2 ** ((best + np.clip(shift, -0.5, 0.5)) / per), 0.0)


def band_levels(f: np.ndarray, rate: int, kind: str = "hamming") -> dict[str, np.ndarray]:
    """Of each frame: loudness, band sums, alpha ratio, Hammarberg index and spectral slopes, of its power spectrum.

    loudness is the sum of 26 mel bands' power to the 0.3. alpha is the level of 50 to 1000 Hz over that of 1 to 5 kHz; hammarberg that of the strongest
    line under 2 kHz over that of 2 to 5 kHz; slopes are those of lines through the levels in dB, per Hz.
    """
    n_fft = 1 << (f.shape[1] - 1).bit_length()
    power = np.abs(np.fft.rfft(f * window(kind, f.shape[1]), n_fft)) ** 2
    hz, tiny = np.fft.rfftfreq(n_fft, 1 / rate), 1e-12
    band = lambda low, high: power[:, (hz >= low) & (hz < high)]
    ratio = lambda a, b: 10 * np.log10(np.maximum(a, tiny) / np.maximum(b, tiny))
    out = {"loudness": (np.maximum(power @ mel_bank(26, n_fft, rate, 20.0, min(8000.0, rate / 2)).T, 0) ** 0.3).sum(1)}
    out |= {"band_250_650": band(250, 650).sum(1), "band_1000_4000": band(1000, 4000).sum(1)}
    out["alpha"] = ratio(band(50, 1000).sum(1), band(1000, 5000).sum(1))
    out["hammarberg"] = ratio(band(0, 2000).max(1), band(2000, 5000).max(1))
    for low, high in ((0, 500), (500, 1500)):
        x = hz[(hz >= low) & (hz < high)]
        level = 10 * np.log10(np.maximum(band(low, high), tiny))
        out[f"slope_{low}_{high}"] = (level - level.mean(1, keepdims=True)) @ (x - x.mean()) / ((x - x.mean()) ** 2).sum()
    return out


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Linear-prediction coefficients and gain from autocorrelations."""
    a, error = np.zeros(order + 1), float(r[0])
    a[0] = 1.0
    for i in range(1, order + 1):
        if error <= 0:
            break
        k = -(a[:i] @ r[i:0:-1]) / error
        a[1 : i + 1] += k * a[i - 1 :: -1][:i]
        error *= 1 - k * k
    return a[1:], error


def levinson_all(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """levinson() of many rows of autocorrelations: coefficients, (rows, order), and gains."""
    a, error = np.zeros((len(r), order + 1)), r[:, 0].astype(float)
    a[:, 0] = 1.0
    live = np.ones(len(r), bool)
    for i in range(1, order + 1):
        live = live & (error > 0)
        k = np.where(live, -(a[:, :i] * r[:, i:0:-1]).sum(1) / np.where(live, error, 1.0), 0.0)
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i]
        error = error * (1 - k * k)
    return a[:, 1:], error


def resample(wave: np.ndarray, rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc resampling; the waveform itself if the rates match."""
    if rate == to or not len(wave):
        return np.asarray(wave, float)
    n = int(np.floor(len(wave) * to / rate))
    cut = min(1.0, to / rate)
    width = int(np.ceil(zeros / cut))
    out = np.empty(n)
    for at in range(0, n, 4096):  # blocks bound the memory, whatever the length
        t = np.arange(at, min(at + 4096, n)) * rate / to
        k = np.floor(t).astype(int)[:, None] + np.arange(-width + 1, width + 1)[None]
        d = (t[:, None] - k) * cut
        w = np.sinc(d) * np.where(np.abs(d) < zeros, 0.5 + 0.5 * np.cos(np.pi * d / zeros), 0) * cut
        out[at : at + len(t)] = (w * np.where((k >= 0) & (k < len(wave)), np.asarray(wave, float)[np.clip(k, 0, len(wave) - 1)], 0)).sum(1)
    return out
