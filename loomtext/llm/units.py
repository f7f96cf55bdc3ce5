"""Vectorised hashing of whole texts as sequences of units (bytes or words).

A batch of texts is held as one byte array with document bounds, so every pass is a numpy pass
over the batch instead of a Python loop over documents. All hashes are 64-bit, depend on content
only and are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MUL = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(_MUL))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two spans, one after the other; the shifts between products keep it from being linear in either."""
    x = a * U64(0xBF58476D1CE4E5B9)
    x += b
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` numbers to mix hashes with."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_MUL) + U64(seed))


class Spans:
    """Hashes of spans of a sequence of units: bytes, or words as hashed by ``word_units``.

    Those of 2**k units come from those of two halves (eight bytes are one number); any other length joins its first and its
    last 2**k units, long spans one BLOCK after the other. So a hash depends on the span alone."""

    BLOCK = 4  # as a power of two

    def __init__(self, units: np.ndarray):
        self.units, self.levels = units, {}
        if units.dtype != np.uint8:
            self.levels[0] = units

    def _level(self, k: int) -> np.ndarray:
        if k not in self.levels:
            if k in (0, 3) and self.units.dtype == np.uint8:
                self.levels[k] = mix(eights(self.units)[: max(len(self.units) - 7, 0)] + U64(_MUL)) if k else _BYTES[self.units]
            else:
                step, last = 1 << (k - 1), self._level(k - 1)
                self.levels[k] = _join(last[:-step], last[step:]) if len(last) > step else last[:0]
        return self.levels[k]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each span, start to end."""
        size = end - start
        found = np.zeros(len(start), U64)
        power = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, self.BLOCK)
        for k in np.unique(power[size > 0]).tolist():
            level, mine = self._level(k), np.flatnonzero((power == k) & (size > 0))
            own = level[start[mine]]
            for at in range(1 << k, int(size[mine].max()) - (1 << k) + 1, 1 << k):
                go = np.flatnonzero(size[mine] > at + (1 << k))
                own[go] = _join(own[go], level[start[mine[go]] + at])
            found[mine] = _join(own, level[end[mine] - (1 << k)]) + size[mine].astype(U64) * U64(_MUL)
        return mix(found)

    def rolling(self, size: int) -> np.ndarray:
        """The hash of each span of ``size`` units, by start."""
        k = size.bit_length() - 1
        level, n = self._level(k), len(self.units) - size + 1
        if n <= 0:
            return np.zeros(0, U64)
        return level[:n] if size == 1 << k else _join(level[:n], level[size - (1 << k) :][:n])


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end, as one number each."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in order, and len(texts) + 1 bounds; a null is an empty text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes outside 0x20 and 0x09-0x0D within a document, and
    the len(bounds) bounds of each document's words."""
    return runs_of(~((raw == 32) | ((raw >= 9) & (raw <= 13))), bounds)


def runs_of(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of marked bytes within a document, and each document's bounds in these."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_units(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """A 64-bit hash for each word: the sum of its mixed lanes of eight bytes, each lane with its place, mixed again with the
    word's length."""
    if not len(starts):
        return np.zeros(0, U64)
    eight, sizes = eights(raw), ends - starts
    found = _lanes(eight, starts, np.minimum(sizes, 8), np.zeros(len(starts), np.int64), seed)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        word = np.repeat(np.arange(len(long)), more)
        lane = np.arange(len(word)) - np.repeat(np.cumsum(more) - more, more) + 1
        each = _lanes(eight, starts[long][word] + 8 * lane, np.minimum(sizes[long][word] - 8 * lane, 8), lane, seed)
        found[long] += np.add.reduceat(each, np.cumsum(more) - more)
    return mix(found + sizes.astype(U64) * U64(_MUL))


def _lanes(eight: np.ndarray, at: np.ndarray, size: np.ndarray, lane: np.ndarray, seed: int) -> np.ndarray:
    """Each lane's first ``size`` bytes as a number, mixed with its place."""
    own = eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - size) * 8).astype(U64))
    return mix(mix(own + U64(seed)) + lane.astype(U64) * U64(0xA24BAED4963EE407))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` values, by start."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:n], values[width - size : width - size + n]) if size < width else values[:n]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0] .. ends[0]-1, starts[1] .. ends[1]-1 and so on, in one array."""
    sizes = ends - starts
    if not sizes.sum():
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return np.arange(sizes.sum()) + shift


def pieces(bounds: np.ndarray, size: int, overlap: int):
    """Cuts a batch's units into stretches of about ``size`` units, so that passes stay in cache and
    one very long document needs no more memory than many short ones.

    Yields (first document, start, end, bounds): documents are whole in a stretch or, if longer
    than ``size``, cut so that each stretch repeats the last ``overlap`` units of the one before.
    """
    doc, n = 0, len(bounds) - 1
    while doc < n:
        if bounds[doc + 1] - bounds[doc] > size + overlap:
            for start in range(int(bounds[doc]), int(bounds[doc + 1]) - overlap, size):
                end = min(start + size + overlap, int(bounds[doc + 1]))
                yield doc, start, end, np.array([0, end - start], np.int64)
            doc += 1
            continue
        last = doc + 1
        while last < n and bounds[last + 1] - bounds[doc] <= size:
            last += 1
        yield doc, int(bounds[doc]), int(bounds[last]), bounds[doc : last + 1] - bounds[doc]
        doc = last
