"""Word shingles of whole texts as 64-bit tokens, vectorised over Arrow string batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text whose arrays are held at a time (a longer text is taken alone).
CHUNK_BYTES = 1 << 20
WORDS = 5

_RNG = np.random.Generator(np.random.PCG64(20240229))
_U64 = np.uint64
#: A random number for each byte, A-Z as a-z.
_VALUE = _RNG.integers(1, 2**64 - 1, 256, dtype=_U64, endpoint=True)
_VALUE[65:91] = _VALUE[97:123]
_WHITE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_FACTOR = 0x9E3779B97F4A7C15
_PLACES = _RNG.integers(1, 2**64 - 1, WORDS, dtype=_U64, endpoint=True) | _U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, _U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the factor and of its inverse, kept up to the longest chunk so far."""

    up = powers(_FACTOR, 1 << 12)
    down = powers(pow(_FACTOR, -1, 2**64), 1 << 12)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = powers(_FACTOR, size), powers(pow(_FACTOR, -1, 2**64), size)
        return cls.up, cls.down


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes together."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word; ``starts`` are the rows' first bytes, with the end appended."""
    n = len(data)
    if not n:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    white = _WHITE[data]
    edge = np.ones(n + 1, bool)  # before byte i: white space or a new row
    edge[1:n] = white[:-1]
    edge[starts] = True
    first = np.flatnonzero(~white & edge[:-1])
    after = np.ones(n, bool)
    after[:-1] = white[1:] | edge[1:n]
    last = np.flatnonzero(~white & after) + 1
    up, down = _Powers.upto(n + 1)
    sums = np.zeros(n + 1, _U64)
    np.cumsum(_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U64))
    return hashes, np.searchsorted(starts, first, side="right") - 1


def shingle_sets(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct tokens) of every row: shingles of five words, or one of the whole sequence if shorter; empty without words."""
    data, offsets = text_buffer(col)
    for i, j in chunks(offsets):
        lo = offsets[i]
        rows = offsets[i : j + 1] - lo
        words, row = word_hashes(data[lo : offsets[j]], rows)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        tokens = np.zeros(len(words), _U64)
        for k in range(min(WORDS, len(words))):
            tokens[: len(words) - k] += words[k:] * _PLACES[k]
        tokens = mix(tokens)
        for r in range(j - i):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= WORDS:
                yield i + r, np.unique(tokens[a : b - WORDS + 1])
            elif b > a:
                part = (words[a:b] * _PLACES[: b - a]).sum(dtype=_U64) + _U64(b - a)
                yield i + r, mix(np.array([part], _U64) ^ _U64(0x5BD1E995))
            else:
                yield i + r, np.zeros(0, _U64)
