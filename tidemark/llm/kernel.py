"""Vectorised words, lines and hashes of whole Arrow text batches (no per-word Python).

Words are runs of bytes other than 0x20 and 0x09-0x0D, so UTF-8 never splits and one pass of numpy
over the Arrow buffer finds them all. Hashes are 64-bit polynomial sums over a random byte table,
mixed at the end; equal words hash alike in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporaries take some 40 times as much. One row may be longer.
PIECE = 1 << 20
#: Longer words are hashed by BLAKE2b.
LONG_WORD = 1 << 16
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LINE = np.zeros(256, dtype=bool)
_LINE[0x0A] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8, person=b"tidemark").digest() for i in range(256)), dtype=np.uint64).copy()
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    if base not in _POW or len(_POW[base]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        _POW[base] = np.multiply.accumulate(out)
    return _POW[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


@dataclass
class Runs:
    """Words (or lines) of some texts: hashes, byte spans, and the first run of each text."""

    data: np.ndarray
    offsets: np.ndarray  # byte offset of each text, and the end
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first run, and the end
    hashes: np.ndarray

    def owner(self) -> np.ndarray:
        """The text of each run."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each byte span; spans are ascending and apart."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _BYTES_LOWER if lower else _BYTES
    lens = ends - starts
    at = 0
    while at < len(starts):
        if lens[at] > LONG_WORD:
            raw = data[starts[at] : ends[at]]
            raw = _LOWER[raw].astype(np.uint8) if lower else raw
            out[at] = int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little")
            at += 1
            continue
        lo = int(starts[at])
        to = int(np.searchsorted(starts, lo + PIECE))
        longer = np.flatnonzero(lens[at:to] > LONG_WORD)
        to = at + int(longer[0]) if len(longer) else to
        hi = int(ends[to - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[data[lo:hi]] * powers(_R, hi - lo), out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * powers(_R_INV, hi - lo)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def runs(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False) -> Runs:
    inside = ~separators[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    begin[cut] = inside[cut]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Runs(data, offsets, starts, ends, np.searchsorted(starts, offsets), hash_spans(data, starts, ends, lower))


def words(texts: pa.Array, lower: bool = False) -> Runs:
    return runs(*buffers(texts), SPACE, lower)


def lines(data: np.ndarray, offsets: np.ndarray) -> Runs:
    return runs(data, offsets, _LINE)


def windows(hashes: np.ndarray, size: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of each ``size`` consecutive hashes, over text borders too: mask those with :func:`whole`."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if size <= 8:
        out = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            out = out * np.uint64(base) + hashes[j : j + n]
        return mix(out)
    out = np.empty(n, dtype=np.uint64)
    step = PIECE
    for at in range(0, n, step):
        to = min(n, at + step)
        part = hashes[at : to + size - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        out[at:to] = (sums[size:] - sums[:-size]) * powers(pow(base, -1, 1 << 64), to - at)
    return mix(out)


def whole(first: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` runs lie in one text."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= end


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive bounds."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(sums[bounds])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut to about ``PIECE`` bytes of text each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lens) // PIECE
        for piece in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
            yield batch.slice(int(piece[0]), len(piece))
