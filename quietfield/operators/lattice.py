"""Voxel tables on a lattice: layouts, and smoothing of grids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_coordinates(df: DataFrame, nx: int, ny: int) -> DataFrame:
    """x, y, z of the flat index v, x fastest."""
    v = F.col("v")
    return df.withColumns({"x": F.pmod(v, F.lit(nx)).cast("int"), "y": F.pmod(F.floor(v / nx), F.lit(ny)).cast("int"), "z": F.floor(v / (nx * ny)).cast("int")})


#: Bytes of samples that one group of a change of layout holds, if a plane or a pixel's series is not larger.
GROUP_BYTES = 64 << 20


def _series(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _lists(values: np.ndarray) -> pa.Array:
    if values.size >= 1 << 31:
        raise ValueError("a group holds more samples than one column of lists can")
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.float32()))


def to_planes(voxels: DataFrame, nx: int, ny: int, nvol: int) -> DataFrame:
    """One row per slice and volume with its pixels px[x + y * nx]; a slice's pixels must all be there.

    Groups are slices, cut into runs of volumes where they are large, and turned over in numpy."""
    step = max(1, GROUP_BYTES // (4 * nx * ny))
    runs = F.transform(F.sequence(F.lit(0), F.lit((nvol - 1) // step)), lambda k: F.struct((k * step).alias("t0"), F.slice("ts", k * step + 1, F.lit(step)).alias("ts")))
    rows = voxels.select("img", "z", (F.col("x") + F.col("y") * nx).alias("p"), F.inline(runs))

    def run(key, table):
        img, z, t0 = (k.as_py() for k in key)
        px = _series(table, "ts")[np.argsort(table.column("p").to_numpy())].T.astype(np.float32)
        return pa.table({"img": pa.array([img] * len(px), pa.string()), "z": pa.array([z] * len(px), pa.int32()), "t": pa.array(t0 + np.arange(len(px)), pa.int32()), "px": _lists(np.ascontiguousarray(px))})

    return rows.groupBy("img", "z", "t0").applyInArrow(run, "img string, z int, t int, px array<float>")


def from_planes(planes: DataFrame, nx: int, ny: int, nvol: int) -> DataFrame:
    """Voxels with their series from planes (img, z, t, px). Groups are slices, cut into runs of pixels where they are large."""
    step = max(1, GROUP_BYTES // (4 * nvol))
    runs = F.transform(F.sequence(F.lit(0), F.lit((nx * ny - 1) // step)), lambda k: F.struct((k * step).alias("p0"), F.slice("px", k * step + 1, F.lit(step)).alias("px")))
    rows = planes.select("img", "z", "t", F.inline(runs))

    def run(key, table):
        img, z, p0 = (k.as_py() for k in key)
        ts = np.ascontiguousarray(_series(table, "px")[np.argsort(table.column("t").to_numpy())].T)
        p = p0 + np.arange(len(ts))
        return pa.table({"img": pa.array([img] * len(ts), pa.string()), "v": pa.array(p + z * nx * ny, pa.int64()), "x": pa.array(p % nx, pa.int32()), "y": pa.array(p // nx, pa.int32()), "z": pa.array([z] * len(ts), pa.int32()), "ts": _lists(ts)})

    return rows.groupBy("img", "z", "p0").applyInArrow(run, "img string, v long, x int, y int, z int, ts array<float>")


def live(ts: Column) -> Column:
    """Whether any volume is not 0."""
    return F.exists(ts, lambda x: x != 0)


def smooth_121(grid: DataFrame, columns: Sequence[str], axes: Sequence[str] = ("gx", "gy", "gz")) -> DataFrame:
    """[1 2 1] along each axis in turn, neighbours past the edge left out."""
    for axis in axes:
        line = Window.partitionBy("img", *[a for a in axes if a != axis]).orderBy(axis)
        grid = grid.withColumns({c: 2 * F.col(c) + F.coalesce(F.lag(c).over(line), F.lit(0.0)) + F.coalesce(F.lead(c).over(line), F.lit(0.0)) for c in columns})
    return grid


def smoothed_sigma(grid: DataFrame) -> DataFrame:
    """Normalised smoothing of (img, gx, gy, gz, sigma): points without an estimate neither count nor pull."""
    rows = grid.withColumns({"den": F.when(F.col("sigma") > 0, 1.0).otherwise(0.0), "num": F.when(F.col("sigma") > 0, F.col("sigma").cast("double")).otherwise(0.0)})
    rows = smooth_121(rows, ["num", "den"])
    return rows.select("img", "gx", "gy", "gz", "den", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0).alias("num"))
