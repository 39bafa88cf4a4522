"""Samples of a FLAC stream (RFC 9639), with numpy; Spark calls it on a file's bytes."""

from __future__ import annotations

import hashlib
from operator import mul

import numpy as np

#: Sample rates and sizes that a frame header names by number; block sizes follow a rule.
RATES = (0, 88_200, 176_400, 192_000, 8_000, 16_000, 22_050, 24_000, 32_000, 44_100, 48_000, 96_000)
SIZES = (0, 8, 12, 0, 16, 20, 24, 32)


class _Bits:
    """Bits of a stream from a byte on, read in order; next_one finds the end of a unary number at once."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(self.bits)
        at = np.where(self.bits, np.arange(n), n)
        self.next_one = np.minimum.accumulate(at[::-1])[::-1] if n else at
        self.pos = 0

    def take(self, n: int) -> int:
        if self.pos + n > len(self.bits):
            raise ValueError("the stream ends early")
        out = int.from_bytes(np.packbits(self.bits[self.pos : self.pos + n]).tobytes(), "big") >> (-n % 8) if n else 0
        self.pos += n
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        if self.pos >= len(self.bits) or self.next_one[self.pos] >= len(self.bits):
            raise ValueError("the stream ends early")
        n = int(self.next_one[self.pos]) - self.pos
        self.pos += n + 1
        return n

    def fields(self, starts: np.ndarray, width: int) -> np.ndarray:
        """The unsigned numbers of `width` bits at these places."""
        if width and len(starts) and int(starts.max()) + width > len(self.bits):
            raise ValueError("the stream ends early")
        out = np.zeros(len(starts), np.int64)
        for k in range(width):
            out = out << 1 | self.bits[starts + k]
        return out

    def rice(self, count: int, width: int) -> np.ndarray:
        """Signed numbers: a unary quotient and `width` bits each."""
        after, step, pos, end = self.next_one, width + 1, self.pos, len(self.bits)
        quotients, starts = [0] * count, [0] * count
        for i in range(count):
            if pos >= end:
                raise ValueError("the stream ends early")
            one = int(after[pos])
            quotients[i], starts[i] = one - pos, one + 1
            pos = one + step
        if pos > end:
            raise ValueError("the stream ends early")
        self.pos = pos
        x = np.array(quotients, np.int64) << width | self.fields(np.array(starts, np.int64), width)
        return x >> 1 ^ -(x & 1)


def _residual(b: _Bits, size: int, order: int) -> np.ndarray:
    method = b.take(2)
    if method > 1:
        raise ValueError("a reserved coding of residuals")
    parts = 1 << b.take(4)
    if size % parts or size // parts < order:
        raise ValueError("partitions don't fit the block")
    out = []
    for k in range(parts):
        n, width = size // parts - (order if k == 0 else 0), b.take(4 + method)
        if width == (15, 31)[method]:
            raw = b.take(5)
            x = b.fields(b.pos + raw * np.arange(n), raw)
            out.append(np.where(x >> max(raw - 1, 0) & 1, x - (1 << raw), x) if raw else x)
            b.pos += raw * n
        else:
            out.append(b.rice(n, width))
    return np.concatenate(out)


def _subframe(b: _Bits, size: int, depth: int) -> np.ndarray:
    if b.take(1):
        raise ValueError("a subframe begins with a one")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = np.full(size, b.signed(depth), np.int64)
    elif kind == 1:
        x = b.fields(b.pos + depth * np.arange(size), depth)
        x = np.where(x >> (depth - 1), x - (1 << depth), x)
        b.pos += depth * size
    elif 8 <= kind <= 12:
        order = kind - 8
        head = np.array([b.signed(depth) for _ in range(order)], np.int64)
        x = _residual(b, size, order)
        for k in range(order - 1, -1, -1):  # the k-th difference of the head comes before the next sums
            x = np.cumsum(np.concatenate((np.diff(head, k)[-1:], x)))[1:]
        x = np.concatenate((head, x))
    elif kind >= 32:
        order = kind - 31
        head = [b.signed(depth) for _ in range(order)]
        precision, shift = b.take(4) + 1, b.signed(5)
        if precision == 16 or shift < 0:
            raise ValueError("a reserved predictor")
        weights = [b.signed(precision) for _ in range(order)][::-1]
        out = head
        for r in _residual(b, size, order).tolist():
            out.append(r + (sum(map(mul, weights, out[-order:])) >> shift))
        x = np.array(out, np.int64)
    else:
        raise ValueError("a reserved kind of subframe")
    return x << wasted


def _frame(b: _Bits, rate: int, depth: int) -> np.ndarray:
    """(size, channels) of the frame at the stream's place."""
    if b.take(14) != 0x3FFE:
        raise ValueError("a frame without its mark")
    b.take(2)
    size, speed, layout, bits = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)  # a number in UTF-8
    for _ in range(0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1):
        b.take(8)
    size = b.take(8 if size == 6 else 16) + 1 if size in (6, 7) else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    if speed > 11:
        b.take(8 if speed == 12 else 16)
    b.take(8)
    depth = SIZES[bits] or depth
    if layout > 10:
        raise ValueError("a reserved layout of channels")
    channels = layout + 1 if layout < 8 else 2
    x = [_subframe(b, size, depth + (layout in (8, 10) and c == 1 or layout == 9 and c == 0)) for c in range(channels)]
    if layout == 8:
        x[1] = x[0] - x[1]
    elif layout == 9:
        x[0] = x[0] + x[1]
    elif layout == 10:
        mid = x[0] << 1 | x[1] & 1
        x = [mid + x[1] >> 1, mid - x[1] >> 1]
    b.pos += -b.pos % 8 + 16
    return np.column_stack(x)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, bits of a sample, and the samples, (n, channels), of a stream; a ValueError says why it can't be read.

    The digest in the stream's header, where there is one, is held against the samples.
    """
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, last = 4, None, False
    while not last:
        if at + 4 > len(data):
            raise ValueError("the stream ends early")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        raise ValueError("no stream header")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    found, n = [], 0
    longest = int.from_bytes(info[7:10], "big") or 1 << 20
    while n < total or not total and at < len(data):
        take = longest + 64
        while True:
            b = _Bits(data[at : at + take])
            try:
                x = _frame(b, rate, depth)
                break
            except (ValueError, IndexError) as e:  # perhaps the header names no longest frame, or too short a one
                if at + take >= len(data) or take > longest << 6:
                    raise ValueError(str(e)) from e
                take <<= 1
        if x.shape[1] != channels:
            raise ValueError("channels differ between frames")
        found.append(x)
        at, n = at + b.pos // 8, n + len(x)
    samples = np.concatenate(found) if found else np.empty((0, channels), np.int64)
    width = (depth + 7) // 8
    raw = samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()
    if any(info[18:34]) and hashlib.md5(raw, usedforsecurity=False).digest() != info[18:34]:
        raise ValueError("the samples differ from the stream's digest")
    return rate, depth, samples
