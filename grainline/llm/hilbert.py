"""Hilbert curve keys of integer points (Skilling's transform), vectorised."""

from __future__ import annotations

import numpy as np


def _transposed(points: np.ndarray, bits: int) -> np.ndarray:
    """The curve position's bits, dims x n: bit b of row i is bit
    ``b * dims + dims - 1 - i`` of the position."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations, highest bit first
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    return x ^ t


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``points`` (n x dims,
    integers below 2**bits); dims * bits must be at most 63."""
    dims = points.shape[1]
    if dims * bits > 63:
        raise ValueError("a key has at most 63 bits")
    x = _transposed(points, bits)
    key = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def hilbert_bytes(points: np.ndarray, bits: int) -> np.ndarray:
    """The same position of any length, as rows of bytes in order of weight."""
    x = _transposed(points, bits)
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)])  # bits x dims x n
    return np.packbits(planes.reshape(-1, len(points)).T.astype(np.uint8), axis=1)
