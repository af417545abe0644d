"""Numpy views of Arrow text columns: word boundaries and word hashes of
whole texts, computed on the UTF-8 bytes of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts worked on at once.  The arrays of a chunk take some 50 bytes a byte of
#: text, and an executor's workers share its memory with the JVM.
CHUNK_BYTES = 1 << 20
_U = np.uint64


def _mix_tables(seed: int) -> np.ndarray:
    """One random 64-bit value per byte value (a fixed function of seed)."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def lower_ascii_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def chunks(col, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (lo, hi, bytes, offsets) for row ranges of a pyarrow string
    column.  NULL counts as the empty text.  A range holds about
    ``max_bytes``; a longer single text is one range of its own."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for start in range(0, len(col), 1024):  # copies are made of few rows at a time
        part = col.slice(start, 1024)
        if isinstance(part, pa.ChunkedArray):
            part = part.combine_chunks()
        part = pc.fill_null(part.cast(pa.large_string()), "")
        _, obuf, dbuf = part.buffers()
        offs = np.frombuffer(obuf, dtype=np.int64)[part.offset:part.offset + len(part) + 1]
        data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None else np.zeros(0, np.uint8)
        lo, n = 0, len(part)
        while lo < n:
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), n)
            yield start + lo, start + hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
            lo = hi
    pa.default_memory_pool().release_unused()  # idle workers share an executor's memory


def word_bounds(is_word: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal word runs inside each
    text, and per text the index of its first word (length texts + 1)."""
    n = len(is_word)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    first = is_word.copy()
    if n:
        first[1:] &= ~is_word[:-1] | edge[1:n]
        last = is_word.copy()
        last[:-1] &= ~is_word[1:] | edge[1:n]
    else:
        last = first
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, is_word: np.ndarray, starts: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hash of each word's bytes (position-weighted sum, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    span = np.diff(np.append(starts, len(data)))
    pos = np.arange(starts[0], len(data)) - np.repeat(starts, span)
    vals = _mix_tables(seed)[data[starts[0]:]]
    vals[~is_word[starts[0]:]] = 0
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(pos.max()) + 1, _U(0x9FB21C651E98DF25)), dtype=np.uint64)
        vals *= powers[pos]
        return mix64(np.add.reduceat(vals, starts - starts[0]))
