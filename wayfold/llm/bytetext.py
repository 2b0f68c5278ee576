"""Vectorised text kernels over Arrow string buffers: no Python string is made per word.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; A-Z are folded to
a-z.  Both rules touch ASCII bytes only, so they are safe on UTF-8.  A word's 64-bit value
takes in eight bytes at a time and is mixed after each step, for all words of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; bijective on uint64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Blanks and ASCII punctuation: what separates bare words.
IS_SEPARATOR = IS_SPACE.copy()
IS_SEPARATOR[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

_STEP = _U(0xD1342543DE82EF95)
#: The first k of eight bytes, by k.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer ranges are valued part by part, so that no loop is longer than a part.
_PART = 512


def range_values(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit values of byte ranges; each step is a bijection of the bytes taken in, so no pattern of bytes cancels out."""
    long = size > _PART
    if long.any():
        out = np.empty(len(size), np.uint64)
        out[~long] = range_values(data, start[~long], size[~long])
        s, n = start[long], size[long]
        count = -(-n // _PART)
        off = np.concatenate([[0], np.cumsum(count)])
        inner = (np.arange(off[-1]) - np.repeat(off[:-1], count)) * _PART
        parts = range_values(data, np.repeat(s, count) + inner, np.minimum(_PART, np.repeat(n, count) - inner))
        out[long] = mix(range_values(parts.view(np.uint8), off[:-1] * 8, count * 8) ^ mix(n.astype(np.uint64) + _GOLD))
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    value = mix(size.astype(np.uint64) * _GOLD + _U(1))
    live, at, left = slice(None), start, size
    while True:
        taken = eight[at] & _FIRST[np.minimum(left, 8)]
        value[live] = mix((value[live] ^ taken) * _STEP + _GOLD)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return value
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes; a longer text stands alone, whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, start byte, end byte) of each word and the rows' offsets into the words."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    space = is_space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ~space
    start[1:] &= space[:-1] | edge[1:n]
    end = ~space
    end[:-1] &= space[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    value = range_values(FOLD[data], s, e - s)
    return value, s, e, np.searchsorted(s, offsets).astype(np.int64)


def shingles(value: np.ndarray, word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``n``-word shingle values and row offsets; a shorter non-empty text is one shingle."""
    counts = np.diff(word_off)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(out_counts)])
    total = int(off[-1])
    if total == 0:
        return np.empty(0, np.uint64), off
    at = np.arange(total) + np.repeat(word_off[:-1] - off[:-1], out_counts)
    padded = np.concatenate([value, np.zeros(n, np.uint64)])
    length = np.repeat(np.minimum(counts, n), out_counts)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        piece = padded[at + k] + _U(k + 1)
        acc = mix(acc * _GOLD + np.where(length > k, piece, _U(0))) if k else mix(piece)
    return acc, off


def distinct_sorted(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and the new offsets."""
    counts = np.diff(off)
    if len(value) == 0:
        return value, off
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((value, row)) if len(counts) > 4000 else None
    if order is None:
        v = value.copy()
        for i in np.flatnonzero(counts > 1):
            v[off[i] : off[i + 1]].sort()
    else:
        v = value[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
    new = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(counts)))])
    return v[keep], new.astype(np.int64)
