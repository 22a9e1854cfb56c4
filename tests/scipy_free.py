"""Akima's cubic in numpy, from the paper."""

from __future__ import annotations

import numpy as np


def akima_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    s = np.diff(y) / np.diff(x)
    m = np.concatenate([[3 * s[0] - 2 * s[1], 2 * s[0] - s[1]], s, [2 * s[-1] - s[-2], 3 * s[-1] - 2 * s[-2]]])
    near, far = np.abs(m[3:] - m[2:-1]), np.abs(m[1:-2] - m[:-3])
    weight = near + far
    some = weight > 1e-9 * weight.max()
    t = np.where(some, (near * m[1:-2] + far * m[2:-1]) / np.where(some, weight, 1), (m[3:] + m[:-3]) / 2)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h, d = (x[k + 1] - x[k]).astype(float), at - x[k]
    return y[k] + d * (t[k] + d * ((3 * s[k] - 2 * t[k] - t[k + 1]) / h + d * (t[k] + t[k + 1] - 2 * s[k]) / h**2))
