"""Vectorised hashing of words and texts, straight from Arrow string buffers.

Work goes over pieces of about PIECE bytes, so memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}

#: True at the bytes that separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers and inverse powers of an odd number modulo 2^64, and a random word for each byte."""
    if "up" not in _tables or len(_tables["up"]) < n:
        n = max(n, 2 * PIECE)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            _tables[name] = np.cumprod(powers, dtype=np.uint64)
        _tables["byte"] = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
    return _tables["up"], _tables["down"], _tables["byte"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and where each text starts and ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, size: int = PIECE, most: int = 2000) -> Iterator[tuple[int, int]]:
    """Ranges of up to `most` texts with about `size` bytes each; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, first + most, n)
        yield first, last
        first = last


def words(
    data: np.ndarray, bounds: np.ndarray, separates: np.ndarray = IS_SPACE, points: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and stops, and the number of words of each text.

    `bounds` has the start of each text and the end of the last; a word never crosses them. With
    points (bytes, bytes before), such a byte that ends a word is a word of its own.
    """
    n = len(data)
    solid = ~separates[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, final = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    final[:-1] &= ~solid[1:] | edge[1:n]
    if points and n > 1:
        apart = points[0][data[1:]] & points[1][data[:-1]] & final[1:] & ~first[1:]
        first[1:] |= apart
        final[:-1] |= apart
    starts, stops = np.flatnonzero(first), np.flatnonzero(final) + 1
    return starts, stops, np.diff(np.searchsorted(starts, bounds))


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # by pieces that end with a word
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + PIECE, "right")))
        lo, hi = starts[first], stops[last - 1]
        up, down, byte = _powers(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(byte[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[first:last] - lo, stops[first:last] - lo
        out[first:last] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    return out


def squeezed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space as one space, and their new bounds."""
    space = IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    keep[inner] = True
    out = np.where(space, np.uint8(32), data)[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[bounds]
