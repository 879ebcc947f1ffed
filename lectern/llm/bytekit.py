"""Vectorised kernels over Arrow text columns.

Everything here works on the UTF-8 bytes of a batch of rows at once: words are
found by a byte class table, hashed from their bytes read as two numbers (no
Python object per word; words of more than 16 bytes go through a hash function
one by one) and combined into shingles.  Memory follows the slice size, and a slice is never smaller than one
text, so the longest single text sets the floor.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(kernel: Kernel) -> Kernel:
    """The kernel, with the memory that its task freed given back when it ends.

    Workers live on between tasks; without this, what allocators keep of one
    stage's temporaries adds to the next stage's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A-Z as a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Masks of the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_RUN = 1 << 16


def _class(members: Iterator[int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: Bytes inside a word when words are split at space and 0x09-0x0D.
NONSPACE = _class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes inside a word when words are ASCII letters, digits and all non-ASCII.
ALNUM = _class(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    n = len(raw)
    if not n:
        return
    _, offsets_buf, data_buf = raw.buffers()
    offsets = np.frombuffer(offsets_buf, dtype=np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and per-row first-word positions (rows + 1 entries) of all words."""
    n = len(buf)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    w = inside[buf]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = w[cut]
    end[cut - 1] = w[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z folded to a-z; words rise.

    A word of up to 16 bytes is two numbers of eight, which are mixed with its
    length; a longer one goes through xxh3.  Neither has words that meet by
    their structure.  Words go in runs of some thousand, so that temporaries
    stay small.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    folded = np.concatenate([FOLD[buf], np.zeros(16, dtype=np.uint8)])
    eights = np.ndarray((len(buf) + 9,), dtype="<u8", buffer=folded, strides=(1,))
    for lo in range(0, len(starts), _RUN):
        a = starts[lo : lo + _RUN]
        size = ends[lo : lo + _RUN] - a
        head = eights[a] & _FIRST[np.minimum(size, 8)]
        tail = eights[np.minimum(a + 8, len(buf))] & _FIRST[np.clip(size - 8, 0, 8)]
        out[lo : lo + _RUN] = mix(mix(head ^ _U(0x5851F42D4C957F2D)) + tail * _U(_PRIME) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    view = memoryview(folded)
    for i in np.flatnonzero(ends - starts > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Ordered hash of each run of `width` consecutive words, row borders ignored."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h *= _U(_PRIME)
        h += words[k : n + k]
        h ^= h >> _U(29)
    return mix(h)


def within_rows(first: np.ndarray, width: int) -> np.ndarray:
    """Positions where a run of `width` words stays inside its row, from word_spans' row positions."""
    total = int(first[-1]) - width + 1
    if total <= 0:
        return np.zeros(0, dtype=np.int64)
    ok = np.zeros(total + 1, dtype=np.int64)
    lo = first[:-1]
    hi = np.maximum(first[1:] - width + 1, lo)
    use = hi > lo
    np.add.at(ok, lo[use], 1)
    np.add.at(ok, hi[use], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def segment_unique(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and row borders (n_rows + 1); rows must be ascending."""
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    kept = [np.unique(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    borders = np.zeros(n_rows + 1, dtype=np.int64)
    if kept:
        np.cumsum([len(k) for k in kept], out=borders[1:])
    return (np.concatenate(kept) if kept else np.zeros(0, dtype=values.dtype)), borders
