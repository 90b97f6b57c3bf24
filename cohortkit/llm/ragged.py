"""Vectorised word and shingle hashes over the buffers of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: ASCII white space, and A-Z folded to a-z; bytes of other characters stay.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that are hashed at a time; a text may span several parts.
PART_BYTES = 1 << 19
_BASE = U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_SHINGLE = mix64(powers(64, U(0xD6E8FEB86659FD93)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of the buffer that end at a text's end or at white space."""
    a, n = 0, len(data)
    while a < n:
        b = a + PART_BYTES
        if b >= n:
            yield a, n
            return
        i = np.searchsorted(offsets, b, "right") - 1
        if offsets[i] > a:
            b = int(offsets[i])
        else:
            end = int(offsets[i + 1])
            while b < end and not IS_SPACE[data[b:min(b + 4096, end)]].any():
                b += 4096
            b = end if b >= end else b + int(np.argmax(IS_SPACE[data[b:min(b + 4096, end)]]))
        yield a, b
        a = b


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every folded word, first word of each text and the total)."""
    data, offsets = text_buffer(column)
    hashes, starts = [], []
    for a, b in _cuts(data, offsets):
        part = data[a:b]
        solid = ~IS_SPACE[part]
        new = solid.copy()
        new[1:] &= ~solid[:-1]
        first = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        new[first] |= solid[first]
        at = np.flatnonzero(new)
        if not len(at):
            continue
        where = np.flatnonzero(solid)
        begin = np.searchsorted(where, at)
        size = np.diff(np.append(begin, len(where)))
        place = np.arange(len(where)) - np.repeat(begin, size)
        table = powers(int(size.max()))
        value = (FOLD[part[where]].astype(U) + U(1)) * table[place]
        hashes.append(mix64(np.add.reduceat(value, begin) + size.astype(U) * _BASE))
        starts.append(at + a)
    if not hashes:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the n-word windows of one text; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    m = min(n, len(words))
    total = np.full(len(words) - m + 1, U(m), U)
    for j in range(m):
        total += words[j:len(words) - m + 1 + j] * _SHINGLE[j]
    return mix64(total)


def batches_of(batch: pa.RecordBatch, text_index: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text, one row at least."""
    _, offsets = text_buffer(batch.column(text_index))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
