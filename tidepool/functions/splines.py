"""Cubic smoothing splines with knots at the data."""

from __future__ import annotations

import numpy as np


def banded_solve(diagonal: np.ndarray, first: np.ndarray, second: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a positive definite system with two diagonals on either side: factors row by row, then two substitutions."""
    n = len(diagonal)
    d, l1, l2, x = np.empty(n), np.zeros(n), np.zeros(n), np.array(b, float)
    for i in range(n):
        if i > 1:
            l2[i] = second[i - 2] / d[i - 2]
        if i:
            l1[i] = (first[i - 1] - (l2[i] * d[i - 2] * l1[i - 1] if i > 1 else 0.0)) / d[i - 1]
        d[i] = diagonal[i] - (l1[i] ** 2 * d[i - 1] if i else 0.0) - (l2[i] ** 2 * d[i - 2] if i > 1 else 0.0)
        x[i] -= (l1[i] * x[i - 1] if i else 0.0) + (l2[i] * x[i - 2] if i > 1 else 0.0)
    x /= d
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i + 1] * x[i + 1] + (l2[i + 2] * x[i + 2] if i + 2 < n else 0.0)
    return x


def smoothing_spline(x: np.ndarray, y: np.ndarray, weights: np.ndarray, stiffness: float) -> tuple[np.ndarray, np.ndarray]:
    """``values, slopes`` at the knots of the curve with the least weighted squared error plus ``stiffness`` times its integrated squared second derivative.

    ``x`` increases. The second derivatives at inner knots solve a system of five diagonals, so time is linear in the knots. Two knots give a line, one its own value.
    """
    if len(x) < 3:
        return y.astype(float), np.full(len(x), (y[-1] - y[0]) / (x[-1] - x[0]) if len(x) == 2 else 0.0)
    h = np.diff(x)
    left, right = 1 / h[:-1], 1 / h[1:]
    middle, w = -(left + right), stiffness / weights
    diagonal = (h[:-1] + h[1:]) / 3 + left**2 * w[:-2] + middle**2 * w[1:-1] + right**2 * w[2:]
    first = h[1:-1] / 6 + (left[1:] * middle[:-1]) * w[1:-2] + (middle[1:] * right[:-1]) * w[2:-1]
    second = right[:-2] * left[2:] * w[2:-2]
    bend = banded_solve(diagonal, first, second, left * y[:-2] + middle * y[1:-1] + right * y[2:])
    pull = np.zeros(len(x))
    pull[:-2] += left * bend
    pull[1:-1] += middle * bend
    pull[2:] += right * bend
    values = y - w * pull
    curve = np.concatenate([[0.0], bend, [0.0]])
    rise = np.diff(values) / h
    slopes = np.append(rise - h * (2 * curve[:-1] + curve[1:]) / 6, rise[-1] + h[-1] * (curve[-2] + 2 * curve[-1]) / 6)
    return values, slopes
