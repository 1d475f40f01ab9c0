"""Scalars of random-matrix theory: the Marchenko-Pastur law, optimal thresholds and shrinkage."""

from __future__ import annotations

import math

import numpy as np


def beta_valid(beta: float) -> bool:
    return math.isfinite(beta) and 0 < beta <= 1


def lambda_star(beta: float) -> float:
    """Optimal hard threshold for singular values in units of the noise level times sqrt(rows)."""
    if not beta_valid(beta):
        return math.nan
    return math.sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + math.sqrt(beta * beta + 14 * beta + 1)))


def mp_cdf(x: float, beta: float) -> float:
    """Distribution function of the Marchenko-Pastur law with aspect ratio beta."""
    low, high, root = (1 - math.sqrt(beta)) ** 2, (1 + math.sqrt(beta)) ** 2, math.sqrt(beta)
    if x <= low:
        return 0.0
    if x >= high:
        return 1.0
    unit = lambda v: max(-1.0, min(1.0, v))
    area = (
        math.sqrt((high - x) * (x - low))
        - (1 + beta) * math.asin(unit((2 * (1 + beta) - 2 * x) / (4 * root)))
        - (1 - beta) * math.asin(unit((2 * (1 + beta) * x - 2 * (1 - beta) ** 2) / (4 * x * root)))
    )
    return max(0.0, min(1.0, (area + math.pi * beta) / (2 * math.pi * beta)))


def mp_median(beta: float) -> float:
    """Median of the law, by halving its support."""
    if not beta_valid(beta):
        return math.nan
    low, high = (1 - math.sqrt(beta)) ** 2, (1 + math.sqrt(beta)) ** 2
    for _ in range(100):
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        low, high = (mid, high) if mp_cdf(mid, beta) < 0.5 else (low, mid)
    return 0.5 * (low + high)


def threshold_factor(beta: float) -> float:
    """Hard threshold in units of the median singular value."""
    return lambda_star(beta) / math.sqrt(mp_median(beta))


def sigma_scale(rows: int, beta: float) -> float:
    """Noise level per median singular value."""
    return 1 / math.sqrt(rows * mp_median(beta))


def shrink_weight(y: np.ndarray, beta: float) -> np.ndarray:
    """Weight of a component with singular value y, in units of the noise level times sqrt(rows)."""
    with np.errstate(all="ignore"):
        w = np.sqrt(np.maximum((y * y - beta - 1) ** 2 - 4 * beta, 0)) / (y * y)
    return np.minimum(w, 1.0)
