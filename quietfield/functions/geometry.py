"""Patch geometry on a lattice: extents, cube and sphere neighbourhoods, tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from .randommatrix import mp_median, sigma_scale, threshold_factor

MIN_EXTENT, MAX_EXTENT, MAX_VOLUMES = 3, 27, 4096


def auto_extent(nvol: int) -> int:
    """Smallest odd k with k**3 above the number of volumes."""
    k = 3
    while k**3 <= nvol:
        k += 2
    return k


def sigma_extent(nvol: int, extent: int, cap: int) -> int:
    """Patch extent of the noise map: twice as many rows as volumes, within cap, never below the main extent."""
    k = 3
    while k**3 < 2 * nvol:
        k += 2
    while k > cap:
        k -= 2
    return max(k, extent)


def sphere_cap(nvox: int) -> int:
    """Largest odd k with k**3 at most half the image, and at least 3."""
    k = 3
    while (k + 2) ** 3 <= 0.5 * nvox:
        k += 2
    return k


def sane_spacing(spacing: tuple[float, float, float]) -> tuple[float, float, float]:
    """spacing, or isotropic where it is not positive, not finite or over 1000 times apart."""
    good = all(math.isfinite(s) and s > 0 for s in spacing) and max(spacing) <= 1000 * min(spacing)
    return tuple(float(s) for s in spacing) if good else (1.0, 1.0, 1.0)


def _ball(spacing, half, span=None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets x,y,z; squared distances) of a box of lattice points, by distance, then z, y, x."""
    low, high = ([-h for h in half], half) if span is None else ([0] * 3, span)
    z, y, x = np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(low[::-1], high[::-1], strict=True)), indexing="ij")
    off = np.column_stack([x.ravel(), y.ravel(), z.ravel()])
    d2 = (off[:, 0] * spacing[0]) ** 2 + (off[:, 1] * spacing[1]) ** 2 + (off[:, 2] * spacing[2]) ** 2
    order = np.lexsort((off[:, 0], off[:, 1], off[:, 2], d2))
    return off[order], d2[order]


@dataclass(frozen=True)
class Geometry:
    """Everything that a run's patches share."""

    dims: tuple[int, int, int]
    nvol: int
    extent: int
    shape: str = "sphere"
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    ngroups: int = 0
    radius2: float = field(init=False, default=0.0)
    rows: int = field(init=False, default=0)

    def __post_init__(self):
        k, n = self.extent, math.prod(self.dims)
        if k % 2 == 0 or not MIN_EXTENT <= k <= MAX_EXTENT:
            raise ValueError(f"the extent must be odd and {MIN_EXTENT} to {MAX_EXTENT}, not {k}")
        if not 2 <= self.nvol <= MAX_VOLUMES:
            raise ValueError(f"2 to {MAX_VOLUMES} volumes are needed, not {self.nvol}")
        if self.shape == "cube":
            if k > min(self.dims):
                raise ValueError(f"a cube of {k} does not fit an image of {self.dims}")
            rows, radius2 = k**3, 0.0
        elif self.shape == "sphere":
            least = max(k**3, self.nvol + 1)
            half = [k] * 3
            while True:
                _, d2 = _ball(self.spacing, half)
                edge = min(((h + 1) * s) ** 2 for h, s in zip(half, self.spacing, strict=True))
                if len(d2) >= least and d2[least - 1] < edge:
                    break
                short = min(range(3), key=lambda a: (half[a] + 1) * self.spacing[a])
                half[short] += max(1, half[short] // 2)
            radius2 = float(d2[least - 1])
            rows = int((d2 <= radius2).sum())
            if rows > n:
                raise ValueError(f"a sphere of {rows} voxels needs a larger image than {self.dims}")
        else:
            raise ValueError(f"unknown shape {self.shape}")
        if rows <= self.nvol:
            raise ValueError(f"a patch of {rows} voxels must hold more than {self.nvol} volumes; the automatic extent is {auto_extent(self.nvol)}")
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "radius2", radius2)

    @property
    def beta(self) -> float:
        return (self.nvol - self.ngroups) / self.rows

    @cached_property
    def omega(self) -> float:
        return threshold_factor(self.beta)

    @cached_property
    def sigma_scale(self) -> float:
        return sigma_scale(self.rows, self.beta)

    @cached_property
    def mu(self) -> float:
        return mp_median(self.beta)

    @cached_property
    def neighbours(self) -> np.ndarray:
        """Offsets, nearest first, among which every voxel finds its `rows` nearest voxels inside the image.

        A corner voxel sees the fewest, so its farthest needed distance is enough for all."""
        span = [min(d - 1, 2 * self.extent) for d in self.dims]
        while True:
            _, d2 = _ball(self.spacing, None, span)
            edge = min([((s + 1) * p) ** 2 for s, p, d in zip(span, self.spacing, self.dims, strict=True) if s < d - 1], default=math.inf)
            if len(d2) >= self.rows and d2[self.rows - 1] < edge:
                break
            span = [min(d - 1, s + max(1, s)) for s, d in zip(span, self.dims, strict=True)]
        far = d2[self.rows - 1]
        half = [min(d - 1, int(math.sqrt(far) / p) + 1) for d, p in zip(self.dims, self.spacing, strict=True)]
        off, d2 = _ball(self.spacing, half)
        return off[d2 <= far]

    @cached_property
    def reach(self) -> tuple[int, int, int]:
        """Farthest that a patch's voxel lies from its centre, along each axis."""
        if self.shape == "cube":
            return (self.extent - 1,) * 3
        return tuple(int(v) for v in np.abs(self.neighbours).max(axis=0))

    def patch_rows(self, centres: np.ndarray) -> np.ndarray:
        """Coordinates (P, rows, 3) of the patches of centres (P, 3); a cube is shifted inwards at the edges."""
        dims = np.array(self.dims)
        if self.shape == "cube":
            k = self.extent
            origin = np.clip(centres - k // 2, 0, dims - k)
            z, y, x = np.meshgrid(*[np.arange(k)] * 3, indexing="ij")
            return origin[:, None, :] + np.column_stack([x.ravel(), y.ravel(), z.ravel()])[None]
        at = centres[:, None, :] + self.neighbours[None]
        inside = ((at >= 0) & (at < dims)).all(axis=2)
        chosen = inside & (np.cumsum(inside, axis=1) <= self.rows)
        return at[chosen].reshape(len(centres), self.rows, 3)

    def tile(self, stride: int = 1, budget: int = 64 << 20) -> tuple[int, int, int]:
        """Core edge of tiles: multiples of the stride, blocks with their halo within the budget of bytes if they can."""
        edge = 24 if math.prod(-(-d // 24) for d in self.dims) >= 64 else 12  # small images in more tiles
        core = [max(stride, -(-edge // stride) * stride)] * 3
        block = lambda c: math.prod(min(d, t + 2 * r) for t, r, d in zip(c, self.reach, self.dims, strict=True)) * self.nvol * 4
        while block(core) > budget and max(core) > max(stride, 4):
            a = core.index(max(core))
            core[a] = max(stride, (core[a] // 2) // stride * stride)
        return tuple(core)


def coarse_axis(dim: int, stride: int = 4) -> tuple[int, int]:
    """(first centre, number of centres) of the noise map's grid along one axis."""
    first = min(stride // 2, (dim - 1) // 2)
    return first, 1 + (dim - 1 - first) // stride
