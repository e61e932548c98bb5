"""Vectorised helpers over Arrow string buffers: rolling hashes, words and shingles.

A batch of texts is seen as one byte buffer with offsets, straight from Arrow,
so no Python string is made. Hashes are polynomials over random odd byte values
modulo 2**64, taken from one prefix sum and finished by a mixing step.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: One odd 64-bit value per byte.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z read as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

def _step(base: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.full((1 << 11) + 1, base, np.uint64)
    low[0] = 1
    low = np.multiply.accumulate(low)
    return low[:-1], low[-1]


_STEPS = {base: _step(base) for base in (_BASE, _BASE_INVERSE)}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, made for each buffer: a worker that keeps them holds 16 bytes for each byte of its largest one."""
    low, step = _STEPS[base]
    high = np.full(n // len(low) + 1, step, np.uint64)
    high[0] = 1
    return np.multiply.outer(np.multiply.accumulate(high), low).ravel()[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finisher: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Prefix:
    """Prefix sums of one buffer; ``span`` hashes any set of substrings."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        v = _powers(_BASE, len(buf))
        v *= values[buf]
        np.cumsum(v, out=self.sums[1:])
        del v
        self.down = _powers(_BASE_INVERSE, len(buf) + 1)

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` bytes, by its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.sums[length:] - self.sums[:n]
        h *= self.down[:n]
        return mix(h)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and, per text, the index of its first word.

    Words are maximal runs without the bytes 20 and 09-0D.
    """
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    left = edge[:-1].copy()
    left[1:] |= ~inside[:-1]
    starts = np.flatnonzero(inside & left)
    right = edge[1:].copy()
    right[:-1] |= ~inside[1:]
    ends = np.flatnonzero(inside & right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive items, by the first one."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _PLACES[0]
    for k in range(1, width):
        total += hashes[k:k + n] * _PLACES[k]
    return mix(total)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``width``-word shingles.

    Letters A-Z are read as a-z. A text with fewer words has one item, the whole
    sequence; a text without words has none.
    """
    starts, ends, first = word_spans(buf, offsets)
    words = Prefix(buf, FOLDED_VALUES).spans(starts, ends)
    shingles = combine(words, width)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(shingles[a:b - width + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif b > a:
            sets.append(mix(combine(words[a:b], b - a) + np.uint64(b - a)))
        else:
            sets.append(shingles[:0])
    return sets


def small_batches(batches, max_bytes: int, column: str):
    """Cuts Arrow batches so that the texts of each piece hold about ``max_bytes``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        _, off = text_buffer(col)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(off, off[start] + max_bytes, side="right"))
            stop = min(batch.num_rows, max(start + 1, stop - 1))
            yield batch.slice(start, stop - start)
            start = stop
