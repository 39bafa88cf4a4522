"""FLAC streams written by hand, one for each kind of subframe."""

import hashlib

import numpy as np
import pytest

from stimframe.sources import files, flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits += [x >> k & 1 for k in range(n - 1, -1, -1)]

    def rice(self, x, width):
        u = x << 1 if x >= 0 else (-x << 1) - 1
        self.bits += [0] * (u >> width) + [1]
        self.put(u & (1 << width) - 1, width)

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def residual(w, r, order, size, parts=0, width=3, method=0, raw=None):
    w.put(method, 2)
    w.put(parts, 4)
    each, at = size >> parts, 0
    for k in range(1 << parts):
        n = each - (order if k == 0 else 0)
        if raw is not None and k == 0:
            w.put((15, 31)[method], 4 + method)
            w.put(raw, 5)
            for x in r[at : at + n]:
                w.put(x, raw)
        else:
            w.put(width, 4 + method)
            for x in r[at : at + n]:
                w.rice(int(x), width)
        at += n


def subframe(w, x, depth, how):
    """x is a list of ints."""
    kind, wasted = how[0], how[-1] if how[0] == "wasted" else 0
    if kind == "wasted":
        x, depth, kind, how = [v >> wasted for v in x], depth - wasted, how[1][0], how[1]
    code = {"constant": 0, "verbatim": 1, "fixed": 8, "lpc": 31}[kind] + (how[1] if kind == "fixed" else len(how[1]) if kind == "lpc" else 0)
    w.put(0, 1)
    w.put(code, 6)
    if wasted:
        w.put(1, 1)
        w.bits += [0] * (wasted - 1) + [1]
    else:
        w.put(0, 1)
    if kind == "constant":
        w.put(x[0], depth)
    elif kind == "verbatim":
        for v in x:
            w.put(v, depth)
    elif kind == "fixed":
        for v in x[: how[1]]:
            w.put(v, depth)
        residual(w, np.diff(np.array(x), how[1]).tolist(), how[1], len(x), **how[2])
    else:
        weights, shift = how[1], how[2]
        order = len(weights)
        for v in x[:order]:
            w.put(v, depth)
        w.put(12 - 1, 4)
        w.put(shift, 5)
        for c in weights:
            w.put(c, 12)
        residual(w, [x[t] - (sum(c * x[t - 1 - k] for k, c in enumerate(weights)) >> shift) for t in range(order, len(x))], order, len(x), **how[3])


def stream(blocks, depth=16, rate=16_000, channels=1, digest=True, longest=True, total=True):
    """blocks: (layout, [samples as coded], [how], samples as heard)."""
    frames, heard = [], []
    for k, (layout, coded, how, out) in enumerate(blocks):
        w, size = Writer(), len(coded[0])
        w.put(0x3FFE, 14)
        w.put(0, 2)
        w.put(7, 4)
        w.put(0, 4)
        w.put(layout, 4)
        w.put(0, 4)
        w.put(k if k < 128 else 0xC280 + k - 128, 8 if k < 128 else 16)
        w.put(size - 1, 16)
        w.put(0, 8)
        for c, (x, h) in enumerate(zip(coded, how)):
            subframe(w, [int(v) for v in x], depth + (layout in (8, 10) and c == 1 or layout == 9 and c == 0), h)
        w.bits += [0] * (-len(w.bits) % 8 + 16)
        frames.append(w.bytes())
        heard.append(np.column_stack(out))
    heard = np.concatenate(heard)
    raw = heard.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (depth + 7) // 8].tobytes()
    info = Writer()
    info.put(16, 16)
    info.put(4096, 16)
    info.put(0, 24)
    info.put(max(map(len, frames)) if longest else 0, 24)
    info.put(rate, 20)
    info.put(channels - 1, 3)
    info.put(depth - 1, 5)
    info.put(len(heard) if total else 0, 36)
    tag = b"\x84\x00\x00\x02ab"  # a comment block, the last
    return b"fLaC\x00\x00\x00\x22" + info.bytes() + (hashlib.md5(raw).digest() if digest else bytes(16)) + tag + b"".join(frames), heard


def signal(n, depth=16, seed=1):
    g = np.random.default_rng(seed)
    return (np.sin(np.arange(n) / 9) * (1 << (depth - 3)) + g.integers(-9, 10, n)).astype(int)


KINDS = [
    ("constant",), ("verbatim",), *[("fixed", k, {"parts": 2, "width": 5}) for k in range(5)], ("fixed", 2, {"parts": 1, "width": 4, "raw": 14}), ("fixed", 1, {"method": 1, "width": 6}),
    ("lpc", [1900, -1000], 10, {"parts": 1, "width": 7}), ("lpc", [500, 300, 200, -100, 60, -30, 20, 10], 10, {"width": 9}), ("wasted", ("fixed", 1, {"width": 5}), 3),
]


@pytest.mark.parametrize("how", KINDS, ids=str)
@pytest.mark.parametrize("depth", [16, 24])
def test_each_kind_of_subframe(how, depth):
    x = signal(64, 16)
    x = np.full(64, -77) if how[0] == "constant" else x >> 3 << 3 if how[0] == "wasted" else x
    data, heard = stream([(0, [x], [how], [x])] * 3, depth)
    rate, got_depth, got = flac.decode(data)
    assert (rate, got_depth) == (16_000, depth) and np.array_equal(got, heard)


def test_channels_of_every_layout():
    a, b = signal(48, seed=2), signal(48, seed=3) >> 1
    fixed = ("fixed", 2, {"width": 7})
    blocks = [(1, [a, b], [fixed, fixed], [a, b]), (8, [a, a - b], [fixed, fixed], [a, b]), (9, [a - b, b], [fixed, fixed], [a, b]), (10, [a + b >> 1, a - b], [fixed, fixed], [a, b])]
    for options in ({}, {"longest": False}, {"digest": False}, {"total": False}):
        data, heard = stream(blocks, channels=2, **options)
        assert np.array_equal(flac.decode(data)[2], heard)


def test_many_frames_and_numbers_of_two_bytes():
    x = signal(16)
    data, heard = stream([(0, [x], [("verbatim",)], [x])] * 200)
    assert np.array_equal(flac.decode(data)[2], heard)


@pytest.mark.parametrize("spoil,why", [(lambda d: d[:60], "ends early"), (lambda d: b"RIFF" + d[4:], "no FLAC"), (lambda d: d[:26] + bytes([d[26] ^ 1]) + d[27:], "digest"), (lambda d: d[:48] + b"\0\0" + d[50:], "mark"), (lambda d: d[:4], "ends early")])
def test_what_cannot_be_read_says_why(spoil, why):
    x = signal(64)
    data, _ = stream([(0, [x], [("fixed", 1, {"width": 5})], [x])])
    with pytest.raises(ValueError, match=why):
        flac.decode(spoil(data))


def test_stimuli(spark, tmp_path):
    x = signal(1600)
    data, _ = stream([(0, [x], [("fixed", 2, {"width": 5})], [x])])
    (tmp_path / "tone.flac").write_bytes(data)
    (tmp_path / "bad.flac").write_bytes(data[:100])
    rows = {r.stim: r for r in files.read_audio(files.select_stimuli(spark, str(tmp_path)), keep_failed=True).collect()}
    assert np.allclose(rows["tone"].waveform, x / 32768) and rows["bad"].waveform is None and "early" in rows["bad"].error
