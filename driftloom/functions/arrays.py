"""The normal distribution over numpy arrays, from the same coefficients as the column expressions."""

from __future__ import annotations

import numpy as np

from driftloom.functions import numeric


def _polynomial(coefficients, x: np.ndarray) -> np.ndarray:
    """Its value, highest power first; as ``np.polyval``, which spends most of its time elsewhere on few values."""
    first, *rest = coefficients
    y = first
    for c in rest:
        y = y * x + c
    return y


def norm_cdf(x: np.ndarray) -> np.ndarray:
    """As :func:`driftloom.functions.numeric.norm_cdf`; infinities give 0 and 1."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 40.0)
    bell = np.exp(-a * a / 2)
    top, bottom = (_polynomial(c, a) for c in numeric._HART)
    tail, wide = bell * top / bottom, ~(a < 7.07106781186547)
    if wide.any():
        far = bell / (2.506628274631 * (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))))
        tail = np.where(a > 37, 0.0, np.where(wide, far, tail))
    return np.where(x > 0, 1 - tail, tail)


def norm_ppf(p: np.ndarray, low: float = np.nan, high: float = np.nan) -> np.ndarray:
    """As :func:`driftloom.functions.numeric.norm_ppf`; ``low`` at 0 or below and ``high`` at 1 or above."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5) - 0.5
    ratio = lambda x, t: _polynomial(t[0], x) / _polynomial(t[1], x)
    z, wide = q * ratio(0.180625 - q * q, numeric._CENTRE), np.abs(q) > 0.425
    if wide.any():
        tail = np.sqrt(-np.log(np.where(inside, np.minimum(p, 1 - p), 0.5)))
        far = ratio(tail - 1.6, numeric._MIDDLE)
        if (tail > 5).any():
            far = np.where(tail <= 5, far, ratio(tail - 5.0, numeric._TAIL))
        z = np.where(wide, np.where(q < 0, -far, far), z)
    return np.where(inside, z, np.where(p <= 0, low, np.where(p >= 1, high, np.nan)))
