"""Magnitude and phase to a signed real series: static and slowly varying phase are divided out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = ("radians", "degrees", "turns", "cycles", "auto")
TURN = 2 * math.pi
#: Binomial low-pass of seven taps.
TAPS = np.array([1, 6, 15, 20, 15, 6, 1], np.float64) / 64


def phase_scale(units: str, low: float, high: float) -> tuple[float, float]:
    """(slope, intercept) that turn stored phase into radians; `auto` maps the observed range to one turn."""
    if units == "radians":
        return 1.0, 0.0
    if units == "degrees":
        return TURN / 360, 0.0
    if units in ("turns", "cycles"):
        return TURN, 0.0
    if units != "auto":
        raise ValueError(f"phase units must be one of {UNITS}")
    span = high - low
    if abs(span - TURN) <= 0.1 or not span > 0:
        return 1.0, 0.0
    slope = TURN / span
    return slope, -0.5 * (low + high) * slope


def _first_near_top(means: DataFrame) -> DataFrame:
    """(img, ref) of means (img, t, m): the first volume whose mean is above 0.95 of the largest, else 0."""
    top = means.withColumn("top", F.max("m").over(Window.partitionBy("img")))
    return top.groupBy("img").agg(F.coalesce(F.min(F.when(F.col("m") > 0.95 * F.col("top"), F.col("t"))), F.lit(0)).alias("ref"))


def reference_volume(samples: DataFrame) -> DataFrame:
    """(img, ref) of samples (img, t, value): the first volume whose mean magnitude is above 0.95 of the largest, else 0."""
    return _first_near_top(samples.groupBy("img", "t").agg(F.avg(F.abs("value").cast("double")).alias("m")))


def _series(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _per_image(rows: DataFrame, f, schema: str) -> DataFrame:
    """(img, ...) of what f(columns of an image's rows in a batch) gives, a row for each image and batch; the first column of rows is img, arrays come as matrices."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = np.array(b.column(0).to_pylist(), object)
            for img in dict.fromkeys(images.tolist()):
                own = [c.filter(pa.array(images == img)) for c in b.columns[1:]]
                found = f(*(_series(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in own))
                yield pa.RecordBatch.from_arrays([pa.array([img], pa.string()), *(pa.array([x]) for x in found)], names=["img", *names])

    return rows.mapInArrow(run, f"img string, {schema}")


def reference_of_series(voxels: DataFrame) -> DataFrame:
    """reference_volume of voxels (img, ts): batches are summed by volume in numpy, and only sums are shuffled."""
    parts = _per_image(voxels.select("img", "ts"), lambda ts: (np.abs(ts).sum(axis=0).tolist(), len(ts)), "total array<double>, n long")
    means = parts.select("img", "n", F.posexplode("total").alias("t", "x")).groupBy("img", "t").agg((F.sum("x") / F.sum("n")).alias("m"))
    return _first_near_top(means)


def radians(phase: Column, slope: float | Column, inter: float | Column) -> Column:
    return phase.cast("double") * slope + inter


def smooth_wrapped(p: np.ndarray) -> np.ndarray:
    """The low-pass along x, then y, of (planes, ny, nx), with wrap-around, in single precision."""
    for axis in (2, 1):
        total = np.zeros(p.shape, np.float64)
        for d, w in zip(range(-3, 4), TAPS, strict=True):
            total += w * np.roll(p, -d, axis=axis)
        p = total.astype(np.float32)
    return p


def taper(n: int, alpha: float = 1.0) -> np.ndarray:
    """Symmetric cosine-tapered window of n points; alpha is the share of it that is tapered."""
    if n == 1 or alpha <= 0:
        return np.ones(n)
    edge = np.minimum(np.arange(n), np.arange(n)[::-1]) / (n - 1)
    return np.where(edge < alpha / 2, 0.5 * (1 - np.cos(2 * np.pi * edge / alpha)), 1.0)


def smooth_fourier(p: np.ndarray, width: int = 3, alpha: float = 1.0) -> np.ndarray:
    """The low-pass of complex planes (planes, ny, nx) by a separable window over spatial frequencies: a taper to the power `width`,
    its middle at frequency 0. With alpha 1 and width 3 it is nearly the seven-tap filter, whose window is that of one point more."""
    ny, nx = p.shape[1:]
    window = np.fft.ifftshift(np.outer(taper(ny, alpha) ** width, taper(nx, alpha) ** width))
    return np.fft.fft2(np.fft.ifft2(p) * window).astype(np.complex64)


#: Low-pass filters of a slice's complex planes.
PHASE_FILTERS = ("taps", "fourier")
#: Bytes of the arrays that a group of a slice's volumes makes.
GROUP_BYTES = 256 << 20


def rotate_to_real(mag: DataFrame, phase: DataFrame, nx: int, ny: int, units: str = "auto", phase_filter: str = "taps", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Voxels (img, v, x, y, z, ts) of the rotated series from voxels of magnitude and phase on the same lattice.

    The two meet by voxel, and by image with the range of its phase and its reference volume; each image is read in its own
    encoding. A group holds volumes of one slice, as filters work on planes, each voxel with its sample in the reference volume;
    places of a slice that have no voxel count as zeros in the filter and get no row;
    slices of many volumes are cut into runs of volumes, and series are put together again by voxel."""
    if phase_filter not in PHASE_FILTERS:
        raise ValueError(f"phase_filter must be one of {', '.join(PHASE_FILTERS)}")
    facts = _ranges(phase).join(reference_of_series(mag), "img")
    both = mag.join(phase.select("img", "v", F.col("ts").alias("ph")), ["img", "v"]).join(facts, "img")
    step = max(1, group_bytes // (nx * ny * 8 * 12))  # about twelve doubles a sample at a time
    most = mag.select(F.size("ts")).first()
    whole = most is None or most[0] <= step

    def run(key, table):
        n, t0 = table.num_rows, key[2].as_py()
        slope, inter = phase_scale(units, table.column("low")[0].as_py(), table.column("high")[0].as_py())
        order = np.argsort(table.column("v").to_numpy())
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[order].astype(np.float64)
        one = lambda c: table.column(c).to_numpy()[order].astype(np.float64)
        m, rad, ref_rad = flat("ts"), flat("ph") * slope + inter, one("ref_ph") * slope + inter
        at_ref = np.abs(one("ref_ts")) > 0
        refc = np.where(at_ref, np.cos(ref_rad), 1.0).astype(np.float32).astype(np.float64)[:, None]
        refs = np.where(at_ref, -np.sin(ref_rad), 0.0).astype(np.float32).astype(np.float64)[:, None]
        c, d = np.abs(m) * np.cos(rad), np.abs(m) * np.sin(rad)
        re, im = (c * refc - d * refs).astype(np.float32), (c * refs + d * refc).astype(np.float32)
        at = (table.column("x").to_numpy().astype(np.int64) + nx * table.column("y").to_numpy())[order]

        def planes(p: np.ndarray) -> np.ndarray:
            full = np.zeros((nx * ny, p.shape[1]), p.dtype)
            full[at] = p
            return full.T.reshape(-1, ny, nx)

        voxels = lambda p: p.reshape(-1, nx * ny).T[at].astype(np.float64)
        if phase_filter == "taps":
            a, b = (voxels(smooth_wrapped(planes(p))) for p in (re, im))
        else:
            smooth = smooth_fourier(planes(re) + 1j * planes(im))
            a, b = voxels(smooth.real), voxels(smooth.imag)
        q = a * a + b * b
        out = np.where(q > 0, (re * a + im * b) / np.sqrt(np.where(q > 0, q, 1.0)), re).astype(np.float32)
        rows = table.take(pa.array(order)).select(["img", "v", "x", "y", "z"])
        offsets = pa.array(np.arange(n + 1) * out.shape[1], pa.int32())
        return rows.append_column("t0", pa.array(np.full(n, t0, np.int32))).append_column("ts", pa.ListArray.from_arrays(offsets, pa.array(out.ravel())))

    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("ts") - 1) / step).cast("int")), lambda k: F.struct((k * step).alias("t0"), F.slice("ts", k * step + 1, F.lit(step)).alias("ts"), F.slice("ph", k * step + 1, F.lit(step)).alias("ph")))
    at_ref = [F.get(c, F.col("ref")).alias(f"ref_{c}") for c in ("ts", "ph")]
    rows = both.select("img", "v", "x", "y", "z", "low", "high", *at_ref, F.inline(cuts))
    found = rows.groupBy("img", "z", "t0").applyInArrow(run, "img string, v long, x int, y int, z int, t0 int, ts array<float>")
    if whole:
        return found.drop("t0")
    series = F.flatten(F.sort_array(F.collect_list(F.struct("t0", "ts")))["ts"]).alias("ts")
    return found.groupBy("img", "v", "x", "y", "z").agg(series)


def _ranges(phase: DataFrame) -> DataFrame:
    """(img, low, high): the range of each image's samples."""
    parts = _per_image(phase.select("img", "ts"), lambda ts: (float(ts.min()), float(ts.max())) if ts.size else (None, None), "low double, high double")
    return parts.groupBy("img").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def changes_nothing(phase: DataFrame, units: str = "auto") -> bool:
    """Whether the phase voxels of any image rotate nowhere: sines vanish and no cosine is negative."""

    def facts(ts: np.ndarray, low: np.ndarray, high: np.ndarray):
        slope, inter = phase_scale(units, low[0], high[0])
        rad = ts * slope + inter
        return float(np.abs(np.sin(rad)).max(initial=0)), float(np.cos(rad).min(initial=1))

    parts = _per_image(phase.join(_ranges(phase), "img").select("img", "ts", "low", "high"), facts, "top double, least double")
    found = parts.groupBy("img").agg(F.max("top").alias("top"), F.min("least").alias("least"))
    return not found.where("top < 1e-6 AND least > 0").isEmpty()
