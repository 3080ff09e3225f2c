"""Vectorised views over Arrow string columns: byte buffers, word spans, hashes.

Python workers get whole Arrow batches, so words are found and hashed with numpy
over the shared UTF-8 buffer and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; bounds the temporaries of one step.
CHUNK_BYTES = 256 << 10

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

#: ASCII white space as in [\x20\x09-\x0D].
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place where it can be."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose texts come to about ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: Rows, and bytes of text, that are worked on together; a batch from Spark may hold many more.
SLICE_ROWS, SLICE_BYTES = 2000, 1 << 30


def row_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts are so few and so short that offsets of 32 bits are enough; a longer text stands alone."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            some = whole.slice(at, SLICE_ROWS)
            if some.column(column).nbytes <= SLICE_BYTES:
                yield some
            else:
                for i, j in chunks(text_buffer(some.column(column))[1], SLICE_BYTES):
                    yield some.slice(i, j - i)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 12)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if size <= 1 << 22:
            _POWERS[base] = got
    return got[:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans ascend, do not overlap, none is empty.

    Every byte is multiplied by a power of an odd base counted from its span's
    start, so the sum depends on the span's own bytes only.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    pw = powers(base, int(lengths.max()))
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64)
    within -= np.repeat(first, lengths)
    terms = pw[within]
    within += np.repeat(starts, lengths)
    terms *= data[within].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(terms, first)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~ASCII_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and each text's first word number (len(offsets) entries).

    Words end at the text's end even where the next text starts without a space.
    """
    starts, ends = word_spans(data)
    inner = offsets[1:-1]
    if len(starts) and len(inner):
        # a word that runs over a text's end is cut there
        inner = np.unique(inner)
        at = np.searchsorted(starts, inner, side="left") - 1
        cut = inner[(at >= 0) & (ends[np.maximum(at, 0)] > inner)]
        if len(cut):
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets, side="left")
