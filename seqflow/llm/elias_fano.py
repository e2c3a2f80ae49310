"""Elias-Fano coded sequences and bit-packed numbers over plain bytes, read in place."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


PACK_ROWS = 1 << 13  # numbers packed at once, a multiple of 8


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of non-negative numbers: bytes of equal weight together, as many as the largest needs, compressed."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c, dtype="<u8")
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 0
        parts += [struct.pack("<QB", len(c), width), c.view(np.uint8).reshape(len(c), 8)[:, :width].T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    data, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    while at < len(data):
        n, width = struct.unpack("<QB", data[at:at + 9].tobytes())
        at += 9
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = data[at:at + n * width].reshape(width, n).T
        out.append(wide.view("<u8").reshape(n))
        at += n * width
    return out


def gaps(rising: np.ndarray) -> np.ndarray:
    """Differences of a sequence that never falls; ``np.cumsum`` brings it back."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, one after another."""
    if not width or not len(values):
        return b""
    out, shifts = [], np.arange(width, dtype=np.uint64)
    for at in range(0, len(values), PACK_ROWS):  # blocks end on whole bytes
        bits = (values[at:at + PACK_ROWS].astype(np.uint64)[:, None] >> shifts) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Numbers at the given places of packed bytes (which need eight spare bytes at the end)."""
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.int64) * width
    first, shift = bit >> 3, (bit & 7).astype(np.uint64)
    out = np.zeros(len(at), np.uint64)
    for k in range(min(8, (width + 14) // 8)):  # the first bit is one of eight
        out |= data[first + k].astype(np.uint64) << np.uint64(8 * k)
    out >>= shift
    if width > 56:  # the number can reach into a ninth byte
        high = data[first + 8].astype(np.uint64)
        out |= np.where(shift > 0, high << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return out & np.uint64((1 << width) - 1)


class EliasFano:
    """A sequence of numbers that never falls: high parts as unary gaps, low parts packed.

    n numbers up to u take about ``n * (2 + log2(u / n))`` bits.
    """

    HEAD = struct.Struct("<QBQ")

    def __init__(self, data: np.ndarray):
        self.n, self.low, high_bytes = self.HEAD.unpack(data[:self.HEAD.size].tobytes())
        start = self.HEAD.size
        bits = np.unpackbits(data[start:start + high_bytes], bitorder="little")
        self.highs = (np.flatnonzero(bits) - np.arange(self.n)).astype(np.uint64)  # gaps up to each number
        self.lows = data[start + high_bytes:]

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        highs = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(highs[-1]) + 1 if n else 0, np.uint8)
        bits[highs] = 1
        unary = np.packbits(bits, bitorder="little").tobytes()
        return cls.HEAD.pack(n, low, len(unary)) + unary + pack(values, low) + bytes(9)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.highs[at] << np.uint64(self.low)) | unpack(self.lows, at, self.low)

    def search(self, wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of the successor of each wanted number, the first not below it, within ``[first, last)``.

        The high part leads to the few numbers that share it; only their low parts are compared.
        """
        high = wanted.astype(np.uint64) >> np.uint64(self.low)
        lo, hi = (np.clip(np.searchsorted(self.highs, high, side), first, last) for side in ("left", "right"))
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            below = self[mid] < wanted[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
