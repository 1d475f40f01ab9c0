"""Patch operators over voxel tables: noise levels, exclusive and averaging denoisers.

Voxels are dealt to tiles with a halo as wide as patches reach, so one shuffle brings together all that a
tile's patches need, at a replication of ((core + 2 reach) / core)**3 instead of one copy per patch; the points
of a noise grid that a tile needs go with them. Kernels run on dense blocks. The averaging denoiser then brings its
partial sums together by the tile that a voxel lies in and adds them in the order of tiles, so results do not depend
on how rows were partitioned."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietfield.functions.geometry import Geometry, coarse_axis

from . import kernels

AXES = ("x", "y", "z")


def tiled(voxels: DataFrame, g: Geometry, core: Sequence[int], reach: Sequence[int]) -> DataFrame:
    """Each voxel once for every tile whose core, widened by the reach, holds it; columns tx, ty, tz are added."""
    out = voxels
    for axis, dim, size, far in zip(AXES, g.dims, core, reach, strict=True):
        last = -(-dim // size) - 1
        low = F.greatest(F.lit(0), F.floor((F.col(axis) - far) / size)).cast("int")
        high = F.least(F.lit(last), F.floor((F.col(axis) + far) / size)).cast("int")
        out = out.withColumn(f"t{axis}", F.explode(F.sequence(low, high)))
    return out


def _block(table: pa.Table, g: Geometry, tile: np.ndarray, core: np.ndarray, reach: np.ndarray, groups: np.ndarray | None) -> tuple[kernels.Block, np.ndarray]:
    coords = np.column_stack([table.column(a).to_numpy() for a in AXES]).astype(np.int64)
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(coords), -1)
    low = np.maximum(tile * core - reach, 0)
    high = np.minimum((tile + 1) * core + reach, g.dims)
    means = flat("means") if groups is not None and "means" in table.column_names else None
    return kernels.Block(g, low, high, coords, flat("ts"), means, groups), coords


def _centres(g: Geometry, tile: np.ndarray, core: np.ndarray, first: Sequence[int], step: Sequence[int]) -> np.ndarray:
    """Points first + k * step of the tile's core, x fastest."""
    axes = []
    for a in range(3):
        low, high = tile[a] * core[a], min((tile[a] + 1) * core[a], g.dims[a])
        k = max(0, -(-(low - first[a]) // step[a]))
        axes.append(np.arange(first[a] + k * step[a], high, step[a]))
    z, y, x = np.meshgrid(axes[2], axes[1], axes[0], indexing="ij")
    return np.column_stack([x.ravel(), y.ravel(), z.ravel()])


def _v(g: Geometry, coords: np.ndarray) -> np.ndarray:
    return coords[:, 0] + g.dims[0] * (coords[:, 1] + g.dims[1] * coords[:, 2])


def _lists(values: np.ndarray, kind) -> pa.Array:
    if values.size >= 1 << 31:
        raise ValueError("a tile holds more samples than one column of lists can; take a smaller extent or fewer volumes")
    offsets = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind))


def _columns(voxels: DataFrame, *extra: str) -> DataFrame:
    return voxels.select("img", *AXES, "ts", *[c for c in ("means", *extra) if c in voxels.columns])


def _axes(g: Geometry) -> list[tuple[int, int]]:
    return [coarse_axis(d) for d in g.dims]


TILE = ("img", "tx", "ty", "tz")


def _grid_by_tile(grid: DataFrame, g: Geometry, core: Sequence[int]) -> DataFrame:
    """Each grid point once for every tile that holds a voxel next to it."""
    out = grid.where("den > 0")
    for axis, dim, size, (first, n) in zip(AXES, g.dims, core, _axes(g), strict=True):
        at = F.col(f"g{axis}")
        low = F.when(at == 0, 0).otherwise(F.floor((first + 4 * (at - 1) + 1) / size)).cast("int")
        high = F.when(at == n - 1, (dim - 1) // size).otherwise(F.floor(F.least(F.lit(dim - 1), first + 4 * (at + 1) - 1) / size)).cast("int")
        out = out.withColumn(f"t{axis}", F.explode(F.sequence(low, high)))
    return out


def tile_tasks(voxels: DataFrame, g: Geometry, core: Sequence[int], most: int = 4096) -> int:
    """Tasks to deal the tiles of an image over: tiles weigh alike, so more tasks than cores even out."""
    tiles = int(np.prod([-(-d // int(c)) for d, c in zip(g.dims, core, strict=True)]))
    return max(int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles, most))


def by_tile(voxels: DataFrame, g: Geometry, core: Sequence[int], reach: Sequence[int], run, schema: str, grid: DataFrame | None = None) -> DataFrame:
    """run(img, tile, table, grid points or None) over every tile with its halo, a task for a tile as far as hashes allow."""
    parts = tile_tasks(voxels, g, core)
    dealt = tiled(voxels, g, [int(c) for c in core], [int(r) for r in reach]).repartition(parts, *TILE).groupBy(*TILE)
    part = lambda key: (key[0].as_py(), np.array([k.as_py() for k in key[1:]]))
    if grid is None:
        return dealt.applyInArrow(lambda key, table: run(*part(key), table, None), schema)
    points = lambda t: {c: t.column(c).to_numpy() for c in ("gx", "gy", "gz", "num", "den")}

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<float>": pa.list_(pa.float32()), "array<double>": pa.list_(pa.float64())}
    columns = [c.split() for c in schema.replace("`", "").split(", ")]
    nothing = pa.table({name: pa.array([], kinds[kind]) for name, kind in columns})

    def both(key, table, own):
        return run(*part(key), table, points(own)) if table.num_rows else nothing

    return dealt.cogroup(_grid_by_tile(grid, g, [int(c) for c in core]).repartition(parts, *TILE).groupBy(*TILE)).applyInArrow(both, schema)


def coarse_sigma(voxels: DataFrame, g: Geometry, groups: Sequence[int] | None = None) -> DataFrame:
    """(img, gx, gy, gz, sigma) on every fourth voxel of each axis: the patch's own noise level, 0 if empty."""
    axes = _axes(g)
    core, reach = np.array(g.tile(4)), np.array(g.reach)
    own = None if groups is None else np.array(groups)

    def run(img, tile, table, _):
        centres = _centres(g, tile, core, [c for c, _ in axes], [4] * 3)
        block, _ = _block(table, g, tile, core, reach, own)
        sigma = kernels.sigma_at(block, centres)
        grid = (centres - [c for c, _ in axes]) // 4
        return pa.table({"img": pa.array([img] * len(grid), pa.string()), **{f"g{a}": pa.array(grid[:, k], pa.int32()) for k, a in enumerate(AXES)}, "sigma": pa.array(sigma.astype(np.float64))})

    return by_tile(_columns(voxels), g, core, reach, run, "img string, gx int, gy int, gz int, sigma double")


def with_level(voxels: DataFrame, grid: DataFrame, g: Geometry, name: str) -> DataFrame:
    """voxels with a float column: the level interpolated from the grid points around each."""
    core = np.array(g.tile(4))

    def run(img, tile, table, points):
        coords = np.column_stack([table.column(a).to_numpy() for a in AXES])
        return table.select(names).append_column(name, pa.array(kernels.interpolated(points, _axes(g), coords)))

    names = voxels.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.schema)
    return by_tile(voxels, g, core, [0] * 3, run, f"{schema}, {name} float", grid)


def _known(g: Geometry, block: kernels.Block, table: pa.Table, coords: np.ndarray, centres: np.ndarray, points) -> np.ndarray | None:
    """Noise levels known at the centres: of the grid, or of a column `known`."""
    if points is not None:
        return kernels.interpolated(points, _axes(g), centres).astype(np.float64)
    if "known" not in table.column_names:
        return None
    level = np.zeros(len(block.raw))
    level[block.flat(coords)] = table.column("known").to_numpy(zero_copy_only=False)
    return level[block.flat(centres)]


#: sigma and rank are 0 and ts is 0 where a voxel is not wanted. own is the column `own` of the voxels.
OUT = "img string, v long, ts array<float>, sigma double, rank int, own double, state int"
#: States of a voxel: not wanted, done, wanted but covered by no patch.
UNWANTED, DONE, MISSING = 0, 1, 2


def _result(img, v, series, sigma, rank, own, state) -> pa.Table:
    return pa.table({"img": pa.array([img] * len(v), pa.string()), "v": v, "ts": _lists(series, pa.float32()), "sigma": np.asarray(sigma, np.float64), "rank": np.asarray(rank, np.int32), "own": own, "state": np.asarray(state, np.int32)})


def _flags(table: pa.Table, name: str | None) -> np.ndarray:
    return np.ones(table.num_rows, bool) if name is None else table.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _own(table: pa.Table) -> np.ndarray:
    return table.column("own").to_numpy(zero_copy_only=False).astype(np.float64) if "own" in table.column_names else np.zeros(table.num_rows)


def denoise_exclusive(voxels: DataFrame, g: Geometry, filter: str, groups: Sequence[int] | None = None, wanted: str | None = None, grid: DataFrame | None = None) -> DataFrame:
    """OUT of every voxel, those where the boolean column `wanted` holds from their own patch.

    Noise levels of the grid, or of a column `known`, replace the patch's own where positive."""
    core, reach = np.array(g.tile(1)), np.array(g.reach)
    shells = None if groups is None else np.array(groups)

    def run(img, tile, table, points):
        block, coords = _block(table, g, tile, core, reach, shells)
        inner = np.flatnonzero(((coords // core) == tile).all(axis=1))
        inner = inner[np.argsort(_v(g, coords[inner]))]
        take = _flags(table, wanted)[inner]
        centres = coords[inner[take]]
        series, sigma, rank = np.zeros((len(inner), g.nvol), np.float32), np.zeros(len(inner)), np.zeros(len(inner), np.int32)
        series[take], sigma[take], rank[take] = kernels.exclusive_at(block, centres, filter, _known(g, block, table, coords, centres, points))
        return _result(img, _v(g, coords[inner]), series, sigma, rank, _own(table)[inner], np.where(take, DONE, UNWANTED))

    return by_tile(_columns(voxels, "known", "own", *([wanted] if wanted else [])), g, core, reach, run, OUT, grid)


#: Partial sums of one tile for the voxels of one home tile, packed: a row for each voxel would cost more than its numbers.
PARTIAL = "img string, home int, tile int, v binary, top binary, sums binary, own binary, state binary"
_AWAY = -1  # state of voxels that lie in another tile


def patch_sums(voxels: DataFrame, g: Geometry, estimate: kernels.Estimate, stride: int, fwhm: float | None, groups: Sequence[int] | None = None, mask: str | None = None, grid: DataFrame | None = None, held: bool = False) -> DataFrame:
    """Partial sums of overlapping patches for each voxel and tile whose patches cover it, and for each voxel of the tile's core.

    Centres lie at multiples of the stride; with a boolean column `mask` only patches that touch it count, with held only those
    whose centre has a row.
    fwhm is in units of the spacing of centres; None weighs all alike. `home` is the tile that a voxel lies in, whose row tells
    its state. A voxel whose own patch is empty needs no patch to be done."""
    core, reach = np.array(g.tile(stride)), np.array(g.reach)
    shells = None if groups is None else np.array(groups)
    width = None if fwhm is None else fwhm * stride * np.cbrt(np.prod(g.spacing))
    falloff = 0.0 if width is None else -4 * np.log(2) / width**2
    tiles = np.array([-(-d // int(c)) for d, c in zip(g.dims, core, strict=True)])
    number = lambda t: t[..., 0] + tiles[0] * (t[..., 1] + tiles[1] * t[..., 2])

    def run(img, tile, table, points):
        block, coords = _block(table, g, tile, core, reach, shells)
        centres = _centres(g, tile, core, [0] * 3, [stride] * 3)
        inside, own = np.zeros(len(block.raw), bool), np.zeros(len(block.raw))
        inside[block.flat(coords)], own[block.flat(coords)] = _flags(table, mask), _own(table)
        if held:
            centres = centres[np.isin(block.flat(centres), block.flat(coords))]
        if mask:
            centres = centres[kernels.hits(block, centres, inside) > 0]
        touched, top, *sums = kernels.averaged(block, centres, estimate, _known(g, block, table, coords, centres, points), falloff)
        there = np.isin(touched, block.flat(coords))  # a table may lack voxels
        touched, top, sums = touched[there], top[there], [x[there] for x in sums]
        core_only = block.flat(coords[((coords // core) == tile).all(axis=1)])
        rest = np.setdiff1d(core_only, touched)
        xyz_of = lambda at: np.column_stack([at % block.size[0], at // block.size[0] % block.size[1], at // (block.size[0] * block.size[1])]) + block.low
        empty = np.zeros(0, bool)
        if len(rest):
            empty = kernels.hits(block, xyz_of(rest), block.live) == 0
        at = np.concatenate([touched, rest])
        sw, swx, sws, swr = (np.concatenate([x, np.zeros((len(rest), *x.shape[1:]))]) for x in sums)
        xyz = xyz_of(at)
        home, here = number(xyz // core), number(tile)
        state = np.where(inside[at], np.concatenate([np.full(len(touched), MISSING), np.where(empty, DONE, MISSING)]), UNWANTED)
        state = np.where(home == here, state, _AWAY).astype(np.int8)
        columns = [_v(g, xyz), np.concatenate([top, np.full(len(rest), -np.inf)]), np.column_stack([sw, sws, swr, swx]), own[at], state]
        order = np.argsort(home, kind="stable")
        homes, first = np.unique(home[order], return_index=True)
        parts = [order[a:z] for a, z in zip(first, [*first[1:], len(order)], strict=True)]
        packed = [pa.array([np.ascontiguousarray(c[p]).tobytes() for p in parts], pa.binary()) for c in columns]
        return pa.table([pa.array([img] * len(parts), pa.string()), pa.array(homes, pa.int32()), pa.array([here] * len(parts), pa.int32()), *packed], names=["img", "home", "tile", "v", "top", "sums", "own", "state"])

    return by_tile(_columns(voxels, "known", "own", *([mask] if mask else [])), g, core, reach, run, PARTIAL, grid)


def merged(partial: DataFrame, parts: int | None = None) -> DataFrame:
    """OUT from partial sums, in `parts` tasks: weighted means of the series, sigma and rank. Sums of a voxel are brought to one largest weight and added in the order of tiles."""

    def run(key, table):
        table = table.take(pa.array(np.argsort(table.column("tile").to_numpy())))
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        v, top, state, own = read("v", np.int64), read("top", np.float64), read("state", np.int8), read("own", np.float64)
        order = np.argsort(v, kind="stable")  # of one voxel, tiles stay in order
        first = np.flatnonzero(np.r_[True, np.diff(v[order]) != 0])
        most = np.maximum.reduceat(top[order], first)
        most = np.where(most > -np.inf, most, 0.0)
        scale = np.exp(top[order] - np.repeat(most, np.diff(np.r_[first, len(v)])))
        sums = np.add.reduceat(read("sums", np.float64).reshape(len(v), -1)[order] * scale[:, None], first)
        sw, sws, swr, swx = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3:]
        home = np.flatnonzero(state[order] != _AWAY)  # one for each voxel, in order
        state, own, v = state[order][home].astype(np.int32), own[order][home], v[order]
        done = (sw > 0) & (state != UNWANTED)
        safe = np.where(sw > 0, sw, 1.0)
        mean = lambda x: np.where(done, x / safe, 0.0)
        series = np.where(done[:, None], swx / safe[:, None], 0.0)
        return _result(key[0].as_py(), v[first], series, mean(sws), np.floor(mean(swr) + 0.5), own, np.where(done, DONE, state))

    return (partial.repartition(parts, "img", "home") if parts else partial).groupBy("img", "home").applyInArrow(run, OUT)
