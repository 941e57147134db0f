"""Vectorised word kernels used inside Arrow tasks.

Texts come as Arrow arrays; a chunk of whole texts is turned into one byte array, its
words into 64-bit hashes, without a Python loop over words. A text longer than a chunk
is cut at separators only, so no word is split and memory stays bounded by the chunk.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
LONG_BYTES = 1 << 22

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit words from a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed) * _U(1 << 20)) * _U(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream(256, 11)[_LOWER]
_POWER_BASE = int(stream(1, 12)[0]) | 1

#: Words between ASCII white space: [^\x20\x09-\x0D]+
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        step = _U(pow(_POWER_BASE, len(_powers), 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([_powers, _powers * step])
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def hash_words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray,
               prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words of adjoining texts and, per text, the number of its words.

    ``bounds`` are the texts' ends in ``data`` with 0 first; letters A-Z count as a-z.
    With ``prefixes``, also one row of hashes per length: of each word's first bytes.
    """
    n_docs = len(bounds) - 1
    inside = kind[data]
    if not inside.any():
        none = np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
        return (*none, np.zeros((len(prefixes), 0), np.uint64)) if prefixes else none
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] |= inside[edges]
    begins = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    start_at = np.searchsorted(at, begins)
    lengths = np.diff(np.append(start_at, len(at)))
    place = at - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE[data[at]] * _power(int(lengths.max()))[place]
        h = mix(np.add.reduceat(terms, start_at) + lengths.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    counts = np.diff(np.searchsorted(begins, bounds))
    if not prefixes:
        return h, counts
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        parts = np.stack([mix(sums[start_at + np.minimum(lengths, k)] - sums[start_at]) for k in prefixes])
    return h, counts, parts


def word_chunks(column: pa.Array, kind: np.ndarray, prefixes: tuple[int, ...] = ()) -> Iterator[tuple]:
    """(first row, end row, word hashes, words per row[, prefix hashes]) of successive chunks of whole texts."""
    data, off = text_buffer(column)
    n, row = len(off) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + CHUNK_BYTES, side="right")) - 1)
        if end == row + 1 and off[end] - off[row] > LONG_BYTES:
            parts, at, stop = [], int(off[row]), int(off[end])
            while at < stop:
                cut = min(stop, at + LONG_BYTES)
                while cut < stop and kind[data[cut]]:
                    cut += 1
                parts.append(hash_words(data[at:cut], np.array([0, cut - at]), kind, prefixes))
                at = cut
            h = np.concatenate([p[0] for p in parts])
            yield row, end, h, np.array([len(h)]), *([np.concatenate([p[2] for p in parts], axis=1)] if prefixes else [])
        else:
            yield row, end, *hash_words(data[off[row] : off[end]], off[row : end + 1] - off[row], kind, prefixes)
        row = end


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of adjoining texts and their number per text.

    A text of fewer than n words, but not none, has one: its whole sequence.
    """
    constants = stream(n, 21)
    ends = np.cumsum(counts)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    total = int(out_counts.sum())
    if not total:
        return np.zeros(0, np.uint64), out_counts
    starts = ends - counts
    base = np.repeat(starts - (np.cumsum(out_counts) - out_counts), out_counts) + np.arange(total)
    stop = np.repeat(ends, out_counts)
    h = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            at = base + j
            ok = at < stop
            h += np.where(ok, words[np.minimum(at, len(words) - 1)] * constants[j], _U(0x632BE59BD9B4E019 + j))
        h = mix(h)
    return h, out_counts


def tidied(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task; memory it has freed then goes back to the system.

    Python workers are kept for later tasks, and an idle one should hold little.
    """
    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
