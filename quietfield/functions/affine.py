"""Affines of image grids (4 by 4, as 16 numbers row by row): inverse, nearest rotation, and quaternions both ways."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def inverse(affine: Sequence[float]) -> list[float]:
    """The affine that leads back; a grid without volume is refused."""
    m = np.array(affine, float).reshape(4, 4)
    if not np.isfinite(m).all() or abs(np.linalg.det(m[:3, :3])) <= 1e-12 * max(1e-300, np.prod(np.linalg.norm(m[:3, :3], axis=0))):
        raise ValueError("the affine has no inverse")
    out = np.eye(4)
    out[:3, :3] = np.linalg.inv(m[:3, :3])
    out[:3, 3] = -out[:3, :3] @ m[:3, 3]
    return out.ravel().tolist()


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to a 3 by 3 one (its polar factor), mirrored if that is."""
    u, _, vt = np.linalg.svd(np.asarray(m, float))
    return u @ vt


def to_quaternion(affine: Sequence[float]) -> tuple[float, float, float, list[float], list[float], float]:
    """(b, c, d, offset, voxel sizes, qfac) of the grid nearest to an affine that a quaternion can say: a rotation, perhaps mirrored in z.

    Axes of no length count as of length 1 along their own. Shear is lost: the nearest rotation is taken."""
    m = np.array(affine, float).reshape(4, 4)
    sizes = np.linalg.norm(m[:3, :3], axis=0)
    axes = np.where(sizes > 0, m[:3, :3] / np.where(sizes > 0, sizes, 1), np.eye(3))
    sizes = np.where(sizes > 0, sizes, 1.0)
    turn = nearest_rotation(axes)
    qfac = 1.0
    if np.linalg.det(turn) < 0:
        turn, qfac = turn * [1, 1, -1], -1.0
    # The four products with the largest component, whichever that is, so that nothing is divided by a small number.
    k = np.array([[turn[0, 0] - turn[1, 1] - turn[2, 2], 0, 0, 0], [turn[0, 1] + turn[1, 0], turn[1, 1] - turn[0, 0] - turn[2, 2], 0, 0], [turn[0, 2] + turn[2, 0], turn[1, 2] + turn[2, 1], turn[2, 2] - turn[0, 0] - turn[1, 1], 0], [turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1], np.trace(turn)]]) / 3
    b, c, d, a = np.linalg.eigh(k)[1][:, -1]  # eigh reads the lower triangle
    sign = -1.0 if a < 0 or (a == 0 and (b, c, d) < (0, 0, 0)) else 1.0
    return sign * b, sign * c, sign * d, m[:3, 3].tolist(), sizes.tolist(), qfac


def from_quaternion(b: float, c: float, d: float, offset: Sequence[float], sizes: Sequence[float], qfac: float = 1.0) -> list[float]:
    """The affine of a quaternion whose first component is what b, c and d leave to 1."""
    a2 = 1 - (b * b + c * c + d * d)
    if a2 < 1e-7:  # half a turn: rounding may have left more than 1
        n = 1 / math.sqrt(b * b + c * c + d * d)
        b, c, d, a = b * n, c * n, d * n, 0.0
    else:
        a = math.sqrt(a2)
    turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
    out = np.eye(4)
    out[:3, :3] = turn * (np.array([abs(s) or 1.0 for s in sizes]) * [1, 1, -1 if qfac < 0 else 1])
    out[:3, 3] = offset
    return out.ravel().tolist()
