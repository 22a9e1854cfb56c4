"""Place of integer points on a Hilbert curve, for any number of dimensions, on whole arrays."""

from __future__ import annotations

import numpy as np


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of ``points`` (values below 2**bits); dimensions x bits is at most 63.

    The coordinates are turned, from the highest bit down, into the frame of the sub-cube they lie in; the
    Gray code of the turned bits, undone, is the index.
    """
    x = points.T.astype(np.uint64).copy()
    n = len(x)
    if n * bits > 63:
        raise ValueError("dimensions x bits must be at most 63")
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        bit = one << np.uint64(b)
        turn ^= np.where(x[n - 1] & bit, bit - one, np.uint64(0))
    x ^= turn
    index = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << one | x[i] >> np.uint64(b) & one
    return index
