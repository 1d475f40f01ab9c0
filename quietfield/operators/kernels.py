"""Numpy kernels on stacks of patches; no Spark here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from quietfield.functions.geometry import Geometry
from quietfield.functions.randommatrix import shrink_weight

FILTERS = ("optshrink", "optthresh", "truncate", "mppca")
#: Filters that find a patch's noise level themselves, so no noise map is made for them.
OWN_LEVEL = ("optthresh", "mppca")


@dataclass
class Decomposition:
    """Of P patches: right singular vectors, weights of components (ascending), noise levels and ranks."""

    vectors: np.ndarray
    weights: np.ndarray
    sigma: np.ndarray
    rank: np.ndarray


def gram(y: np.ndarray) -> np.ndarray:
    """N by N products of the columns of each patch (P, rows, N)."""
    return np.matmul(y.transpose(0, 2, 1), y)


def singular_values(squares: np.ndarray) -> np.ndarray:
    """Roots of ascending eigenvalues, those that rounding alone can make being 0."""
    floor = np.maximum(squares[:, -1:], 0) * squares.shape[1] * np.finfo(float).eps
    return np.sqrt(np.where(squares > floor, squares, 0.0))


def component_weights(s: np.ndarray, sigma: np.ndarray, rows: float, beta: float, filter: str) -> np.ndarray:
    """Weights of singular values s (P, N) at noise levels sigma (P,): 0 at or below the noise edge, 1 without noise."""
    unit = (sigma * np.sqrt(rows))[:, None]
    kept = s > unit * (1 + np.sqrt(beta))
    weights = kept.astype(float)
    if filter == "optshrink":
        weights = np.where(kept & (unit > 0), shrink_weight(s / np.where(unit > 0, unit, 1.0), beta), weights)
    return weights


def edge_estimate(squares: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(noise levels, numbers of noise components) of patches from their ascending eigenvalues (P, n), both found together.

    The n smallest values are noise if they spread no wider than the law allows for their own mean; the largest such n is taken."""
    values = np.maximum(squares, 0) / rows
    n = np.arange(1, values.shape[1] + 1)
    mean = np.cumsum(values, axis=1) / n
    fits = values - values[:, :1] <= 4 * np.sqrt(n / rows) * mean
    noise = values.shape[1] - np.argmax(fits[:, ::-1], axis=1)  # one value always fits
    return np.sqrt(mean[np.arange(len(values)), noise - 1]), noise


def decompose(y: np.ndarray, g: Geometry, filter: str, known_sigma: np.ndarray | None = None) -> Decomposition:
    """Spectrum of each patch of y (P, rows, N) through its N by N Gram matrix, and what to keep of it.

    known_sigma (P,) replaces a patch's own noise level where it is positive."""
    n = y.shape[2]
    values, vectors = np.linalg.eigh(gram(y))
    s = singular_values(values)
    median = np.median(s[:, g.ngroups :], axis=1)
    sigma = median * g.sigma_scale
    if filter == "mppca":
        sigma, noise = edge_estimate(values[:, g.ngroups :], g.rows)
        weights = ((np.arange(n) >= (g.ngroups + noise)[:, None]) & (s > 0)).astype(float)
        return Decomposition(vectors, weights, sigma, (weights > 0).sum(axis=1))
    if filter == "optthresh":
        weights = ((s > 0) & (s >= (g.omega * median)[:, None])).astype(float)
    else:
        if known_sigma is not None:
            sigma = np.where(known_sigma > 0, known_sigma, sigma)
        weights = component_weights(s, sigma, g.rows, g.beta, filter)
    weights[:, np.arange(n) < g.ngroups] = 0
    above = s > (sigma * np.sqrt(g.rows))[:, None] * (1 + np.sqrt(g.beta))
    kept = weights > 0 if filter == "optthresh" else above & (np.arange(n) >= g.ngroups)
    return Decomposition(vectors, weights, sigma, kept.sum(axis=1))


def restored(y: np.ndarray, d: Decomposition) -> np.ndarray:
    """Patches rebuilt from their weighted components; those that keep nothing are 0."""
    top = y.shape[2] - int((d.weights > 0).any(axis=0).sum())  # components are ascending: what no patch keeps is left out
    kept = d.vectors[:, :, top:]
    return np.matmul(np.matmul(y, kept) * d.weights[:, None, top:], kept.transpose(0, 2, 1))


#: (estimates of patches (P, rows, N), noise levels, ranks) from patches and the noise levels known at their centres.
Estimate = Callable[[np.ndarray, "np.ndarray | None"], tuple[np.ndarray, np.ndarray, np.ndarray]]


def low_rank(g: Geometry, filter: str) -> Estimate:
    def estimate(y: np.ndarray, known: np.ndarray | None):
        d = decompose(y, g, filter, known)
        return restored(y, d), d.sigma, d.rank

    return estimate


def demeaned(series: np.ndarray, means: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(series without the means of their groups, those means by volume). means (n, groups); group -1 has mean 0."""
    full = np.concatenate([means.astype(np.float64), np.zeros((len(means), 1))], axis=1)[:, groups]
    return series - full, full


class Block:
    """A box of voxels around a tile, as a dense array with what lies outside it empty."""

    def __init__(self, g: Geometry, low: np.ndarray, high: np.ndarray, coords: np.ndarray, series: np.ndarray, means: np.ndarray | None, groups: np.ndarray | None):
        self.g, self.low, self.size = g, low, high - low
        at = self.flat(coords)
        n = int(np.prod(self.size))
        self.raw = np.zeros((n, g.nvol), np.float32)
        self.raw[at] = series
        self.data = self.raw.astype(np.float64)
        self.mean = None
        if means is not None and means.shape[1]:
            full = np.zeros((n, means.shape[1]), np.float64)
            full[at] = means
            self.data, self.mean = demeaned(self.data, full, groups)
        self.live = (self.raw != 0).any(axis=1)

    def flat(self, coords: np.ndarray) -> np.ndarray:
        c = coords - self.low
        return c[..., 0] + self.size[0] * (c[..., 1] + self.size[1] * c[..., 2])


    def rows(self, centres: np.ndarray) -> np.ndarray:
        """Places in the block of the rows (P, rows) of patches. Centres from which all offsets stay inside share one pattern."""
        g = self.g
        if g.shape == "cube":
            return self.flat(g.patch_rows(centres))
        out = np.empty((len(centres), g.rows), np.int64)
        near = g.neighbours[: g.rows]
        free = ((centres + near.min(axis=0) >= 0) & (centres + near.max(axis=0) < g.dims)).all(axis=1)
        steps = near @ np.array([1, self.size[0], self.size[0] * self.size[1]])
        out[free] = self.flat(centres[free])[:, None] + steps
        out[~free] = self.flat(g.patch_rows(centres[~free]))
        return out


def per_batch(g: Geometry, budget: int = 16 << 20) -> int:
    """Patches in one stack, so that patches and Gram matrices stay within the budget of bytes."""
    return max(1, budget // (8 * g.nvol * (2 * g.rows + 3 * g.nvol)))


def noise_level(y: np.ndarray, g: Geometry) -> np.ndarray:
    """Own noise level of patches (P, rows, N): the median singular value in units of the law's."""
    return np.median(singular_values(np.linalg.eigvalsh(gram(y)))[:, g.ngroups :], axis=1) * g.sigma_scale


def sigma_at(block: Block, centres: np.ndarray) -> np.ndarray:
    """Own noise level of the patch around each centre; 0 for an empty patch."""
    out = np.zeros(len(centres), np.float32)
    step = per_batch(block.g)
    for a in range(0, len(centres), step):
        rows = block.rows(centres[a : a + step])
        full = np.flatnonzero(block.live[rows].any(axis=1))
        if len(full):
            out[a + full] = noise_level(block.data[rows[full]], block.g)
    return out


def hits(block: Block, centres: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Number of voxels of each centre's patch that are inside a mask over the block."""
    step = per_batch(block.g)
    return np.concatenate([np.zeros(0, np.int64), *[inside[block.rows(centres[a : a + step])].sum(axis=1) for a in range(0, len(centres), step)]])


def exclusive_at(block: Block, centres: np.ndarray, filter: str, known: np.ndarray | None):
    """Each centre restored from its own patch: (series, sigma, rank), zeros for an empty patch."""
    g = block.g
    series = np.zeros((len(centres), g.nvol), np.float32)
    sigma, rank = np.zeros(len(centres), np.float32), np.zeros(len(centres), np.int32)
    step = per_batch(g)
    for a in range(0, len(centres), step):
        own = centres[a : a + step]
        rows, mid = block.rows(own), block.flat(own)
        full = np.flatnonzero(block.live[rows].any(axis=1))
        if not len(full):
            continue
        y = block.data[rows[full]]
        d = decompose(y, g, filter, None if known is None else known[a + full])
        x = np.einsum("pn,pnk->pk", block.data[mid[full]], d.vectors) * d.weights
        x = np.einsum("pk,pnk->pn", x, d.vectors)
        if block.mean is not None:
            x = x + block.mean[mid[full]]
        series[a + full], sigma[a + full], rank[a + full] = x, d.sigma, d.rank
    return series, sigma, rank


def averaged(block: Block, centres: np.ndarray, estimate: Estimate, known: np.ndarray | None, falloff: float):
    """Sums over the patches of the centres, weighted by exp(falloff * squared distance to the centre).

    Per touched voxel: (place in the block, log of the largest weight, sum of weights, weighted sums of series,
    sigma and rank), all relative to the largest weight. Weights that are 0 as products of doubles do not count.
    Patches come in the order of the centres, and a voxel's sums add up in that order."""
    g, n = block.g, len(block.raw)
    top = np.full(n, -np.inf)
    chunks = []
    step = per_batch(g)
    sp, flat = np.array(g.spacing), np.array([1, block.size[0], block.size[0] * block.size[1]])
    for a in range(0, len(centres), step):
        own = centres[a : a + step]
        rows = block.rows(own)
        full = np.flatnonzero(block.live[rows].any(axis=1))
        if not len(full):
            continue
        rows = rows[full]
        if falloff:
            away = (np.stack([rows // f % m for f, m in zip(flat, block.size, strict=True)], axis=2) + block.low - own[full][:, None, :]) * sp
            log_w = falloff * (away * away).sum(axis=2)
            counts = np.prod(np.exp(falloff * away * away), axis=2) > 0 if log_w.min() < -600 else np.ones(log_w.shape, bool)
        else:
            log_w, counts = np.zeros(rows.shape), np.ones(rows.shape, bool)
        np.maximum.at(top, rows[counts], log_w[counts])
        chunks.append((full + a, rows, log_w, counts))
    touched = np.flatnonzero(top > -np.inf)
    sums = np.zeros((len(touched), g.nvol + 3))  # weights, sigma, rank, series
    if len(touched):
        place = np.full(n, -1)
        place[touched] = np.arange(len(touched))
        for index, rows, log_w, counts in chunks:
            x, sigma, rank = estimate(block.data[rows], None if known is None else known[index])
            w = np.where(counts, np.exp(log_w - np.where(counts, top[rows], 0.0)), 0.0)
            use = np.flatnonzero(counts.ravel())
            at, w = place[rows.ravel()[use]], w.ravel()[use]
            order = np.argsort(at, kind="stable")
            w = w[order]
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            patch = use[order] // rows.shape[1]
            part = np.empty((len(w), g.nvol + 3))
            part[:, 0], part[:, 1], part[:, 2] = 1, sigma[patch], rank[patch]
            part[:, 3:] = x.reshape(-1, g.nvol)[use[order]]
            part *= w[:, None]
            sums[at[order][first]] += np.add.reduceat(part, first)
        if block.mean is not None:
            sums[:, 3:] += sums[:, :1] * block.mean[touched]
    return touched, top[touched], sums[:, 0], sums[:, 3:], sums[:, 1], sums[:, 2]


def interpolated(grid: dict[str, np.ndarray], axes: list[tuple[int, int]], coords: np.ndarray, stride: int = 4) -> np.ndarray:
    """Level at coords (n, 3) from grid points gx, gy, gz, num, den around them; only points with den > 0 weigh.

    axes: (first place, number of points) of the grid along each axis. 0 where no point weighs."""
    at, fraction = [], []
    for k, (first, n) in enumerate(axes):
        u = np.clip((coords[:, k] - first) / stride, 0, n - 1)
        at.append(np.floor(u).astype(np.int64))
        fraction.append(u - at[-1])
    low = np.array([a.min() for a in at]) if len(coords) else np.zeros(3, np.int64)
    size = np.array([a.max() + 2 for a in at]) - low if len(coords) else np.ones(3, np.int64)
    num, use = np.zeros(size), np.zeros(size, bool)
    points = np.column_stack([grid["gx"], grid["gy"], grid["gz"]]).reshape(-1, 3) - low
    near = ((points >= 0) & (points < size)).all(axis=1) & (np.asarray(grid["den"]) > 0)
    where = tuple(points[near].T)
    num[where], use[where] = np.asarray(grid["num"])[near], True
    total, weight = np.zeros(len(coords)), np.zeros(len(coords))
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                corner = tuple(a - b + d for a, b, d in zip(at, low, (dx, dy, dz), strict=True))
                w = np.prod([f if d else 1 - f for f, d in zip(fraction, (dx, dy, dz), strict=True)], axis=0) * use[corner]
                total, weight = total + w * num[corner], weight + w
    return np.divide(total, weight, out=np.zeros(len(coords)), where=weight > 0).astype(np.float32)
