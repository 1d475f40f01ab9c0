"""The denoising pipeline: options, their rules, and the order of stages over a voxel table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from quietfield.functions.geometry import Geometry, auto_extent, sane_spacing, sigma_extent, sphere_cap
from quietfield.functions.stabilise import stabiliser
from quietfield.operators import lattice, patches, rotate, shells, unring
from quietfield.operators.kernels import FILTERS, OWN_LEVEL, low_rank
from quietfield.operators.select import quantiles
from quietfield.tables import cut

AGGREGATORS = ("gaussian", "uniform", "exclusive")
SHAPES = ("sphere", "cube")
VST_ROUNDS = 2
#: Up to so many images their medians are sent to all executors.
MAX_IMAGES = 100_000


@dataclass(frozen=True)
class DenoiseOptions:
    """Options of a run; None means automatic. validate() refuses combinations before any job runs."""

    filter: str = "optshrink"
    shape: str = "sphere"
    aggregator: str = "gaussian"
    aggregator_fwhm: float | None = None
    stride: int | None = None
    extent: int | None = None
    vst: bool | None = None
    noise_dof: int | None = None
    preserve_noise_bias: bool = False
    demean: bool = False
    bvals: tuple[float, ...] | None = None
    phase: bool = False
    phaseunits: str | None = None
    phase_filter: str = "taps"
    real: bool = False
    mask: bool = False
    noise: bool = False
    rank: bool = False
    degibbs: str = "n"
    partial_fourier: float | None = None

    def validate(self) -> DenoiseOptions:
        def refuse(when: bool, why: str) -> None:
            if when:
                raise ValueError(why)

        for name, allowed in (("filter", FILTERS), ("shape", SHAPES), ("aggregator", AGGREGATORS), ("degibbs", ("y", "n", "o"))):
            refuse(getattr(self, name) not in allowed, f"{name} must be one of {', '.join(allowed)}")
        refuse(self.phaseunits is not None and self.phaseunits not in rotate.UNITS, f"phaseunits must be one of {', '.join(rotate.UNITS)}")
        refuse(self.stride not in (None, 1, 2), "stride must be 1 or 2")
        refuse(self.noise_dof is not None and not 1 <= self.noise_dof <= 64, "noise_dof must be 1 to 64")
        refuse(self.aggregator_fwhm is not None and not (math.isfinite(self.aggregator_fwhm) and self.aggregator_fwhm > 0), "aggregator_fwhm must be positive")
        refuse(self.partial_fourier is not None and self.partial_fourier not in unring.FOURIER, f"partial_fourier must be one of {unring.FOURIER}")
        refuse(self.real and not self.phase, "real needs phase")
        plain = DenoiseOptions(degibbs="o", partial_fourier=self.partial_fourier)
        refuse(self.degibbs == "o" and self != plain, "degibbs o takes no denoiser option or by-product")
        refuse(self.degibbs == "y" and self.mask, "degibbs y cannot be used with a mask")
        refuse(self.partial_fourier is not None and self.degibbs == "n", "partial_fourier needs degibbs")
        refuse(self.vst is True and self.phase, "vst cannot be used with phase")
        refuse(self.aggregator_fwhm is not None and self.aggregator != "gaussian", "aggregator_fwhm is for the gaussian aggregator")
        refuse(self.stride == 2 and self.aggregator == "exclusive", "the exclusive aggregator visits every voxel: stride 1")
        refuse(self.bvals is not None and not self.demean, "bvals are for demean")
        refuse(self.phaseunits is not None and not self.phase, "phaseunits needs phase")
        refuse(self.phase_filter not in rotate.PHASE_FILTERS, f"phase_filter must be one of {', '.join(rotate.PHASE_FILTERS)}")
        refuse(self.phase_filter != "taps" and not self.phase, "phase_filter needs phase")
        refuse(self.demean and self.bvals is None, "demean needs b-values")
        refuse((self.noise_dof is not None or self.preserve_noise_bias) and (self.vst is False or self.phase), "noise_dof and preserve_noise_bias describe vst, which is off")
        return self


@dataclass
class Result:
    """voxels: (img, v, x, y, z, ts, sigma, rank); sigma and rank are 0 outside the mask. real: the rotated series."""

    voxels: DataFrame
    real: DataFrame | None
    vst: bool
    geometry: Geometry | None
    filter: str = ""
    shells: tuple[tuple[float, int], ...] = ()
    fallbacks: int = 0  # voxels that no patch covered, restored from their own
    counters: dict[str, int] = field(default_factory=dict)  # of the averaging denoiser: voxels wanted, fallbacks, without signal, ranks summed up

    def summary(self) -> str:
        """What a run did, in a line."""
        if self.geometry is None:
            return "unringing only"
        g = self.geometry
        patch = f"sphere radius {math.sqrt(g.radius2):.2f} mm = {g.rows} voxels" if g.shape == "sphere" else f"cube of {g.extent} = {g.rows} voxels"
        shells = f"; shells {' '.join(f'b={b:.0f} x{n}' for b, n in self.shells)}" if self.shells else ""
        return f"{patch}; filter {self.filter}; stabilised {'yes' if self.vst else 'no'}{shells}; voxels without a patch {self.fallbacks}"


def _mapped(voxels: DataFrame, f, sigma: str) -> DataFrame:
    """voxels with ts replaced by f(ts, sigma) where the column sigma is positive, batch by batch."""
    names = voxels.columns
    at, level = names.index("ts"), names.index(sigma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ts = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = b.column(level).to_numpy(zero_copy_only=False).astype(np.float64)
            out, use = ts.copy(), s > 0
            out[use] = f(ts[use].astype(np.float64), s[use][:, None])
            offsets = pa.array(np.arange(b.num_rows + 1) * ts.shape[1], pa.int32())
            new = pa.ListArray.from_arrays(offsets, pa.array(out.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], names=names)

    return voxels.mapInArrow(run, voxels.schema)


def series_facts(voxels: DataFrame) -> Row:
    """(n, least, low, odd) of all series: most and fewest volumes, smallest sample, whether any sample is not finite. A row a task is summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            if b.num_rows:
                sizes, x = pc.list_value_length(b.column(0)).to_numpy(zero_copy_only=False), b.column(0).flatten().to_numpy(zero_copy_only=False)
                found.append((int(sizes.max()), int(sizes.min()), float(x.min(initial=np.inf)), not np.isfinite(x).all()))
        if found:
            n, least, low, odd = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([max(n)], pa.int32()), pa.array([min(least)], pa.int32()), pa.array([float(np.min(low))]), pa.array([any(odd)])], names=["n", "least", "low", "odd"])

    parts = voxels.select("ts").mapInArrow(run, "n int, least int, low double, odd boolean")
    return parts.agg(F.max("n").alias("n"), F.min("least").alias("least"), F.min("low").alias("low"), F.bool_or("odd").alias("odd")).first()


def sigma_grid(voxels: DataFrame, g: Geometry, groups: list[int] | None) -> DataFrame:
    """(img, gx, gy, gz, den, num): coarse estimates of the noise level, smoothed, as a written table."""
    return cut(lattice.smoothed_sigma(cut(patches.coarse_sigma(voxels, g, groups))))


def filled(sigma: DataFrame) -> DataFrame | None:
    """The rows of sigma (img, sigma, other columns) with levels that are not positive replaced by the median of the positive ones of the image.

    None if an image has no positive level."""
    images = sigma.select("img").distinct()
    middle = cut(images.join(quantiles(sigma, [0.5], "sigma", F.col("sigma") > 0).select("img", F.col("level").alias("middle")), "img", "left"))
    n, without = middle.agg(F.count("*"), F.count_if(F.col("middle").isNull())).first()
    if not n or without:
        return None
    return sigma.join(F.broadcast(middle) if n <= MAX_IMAGES else middle, "img").withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.col("middle").cast("float"))).drop("middle")


def zero_share(out: DataFrame, raw: DataFrame, mask: DataFrame | None = None) -> float:
    """Share of zeros among the output samples of voxels that are live in raw (and in the mask); over half of them means that noise_dof does not fit."""
    rows = out.join(raw.where(lattice.live(F.col("ts"))).select("img", "v"), ["img", "v"], "left_semi")
    if mask is not None:
        rows = rows.join(mask.select("img", "v").distinct(), ["img", "v"], "left_semi")
    zeros, total = rows.agg(F.sum(F.size(F.filter("ts", lambda x: x == 0))), F.sum(F.size("ts"))).first()
    return (zeros or 0) / total if total else 0.0


def unrung(voxels: DataFrame, nx: int, ny: int, nvol: int, partial_fourier: float) -> DataFrame:
    return lattice.from_planes(unring.unring(lattice.to_planes(voxels, nx, ny, nvol), nx, ny, partial_fourier), nx, ny, nvol)


def denoise(voxels: DataFrame, dims: tuple[int, int, int], spacing=(1.0, 1.0, 1.0), options: DenoiseOptions = DenoiseOptions(), mask: DataFrame | None = None, phase: DataFrame | None = None) -> Result:  # noqa: B008
    """Denoise voxels (img, v, x, y, z, ts) of one lattice. mask: (img, v) of the voxels wanted; phase: voxels as voxels.

    Non-finite samples and a mask without voxels are refused."""
    o = replace(options, mask=options.mask or mask is not None, phase=options.phase or phase is not None).validate()
    nx, ny, _ = dims
    facts = series_facts(voxels)
    if facts.n is None or facts.n != facts.least:
        raise ValueError("every voxel needs the same number of volumes")
    if facts.odd:
        bad = voxels.select("img", "v", F.posexplode("ts").alias("t", "x")).where(F.isnan("x") | (F.abs("x") == float("inf")))
        at = bad.agg(F.min(F.struct("img", "t", "v")).alias("at")).first().at  # the first in the order of a file
        raise ValueError(f"the series holds values that are not finite, the first at voxel {at.v} of volume {at.t}")
    n = facts.n
    if o.degibbs != "n":
        unring.check_unring(nx, ny, o.partial_fourier or 1.0)
    zero = {"sigma": F.lit(0.0), "rank": F.lit(0)}
    if o.degibbs == "o":
        return Result(unrung(voxels, nx, ny, n, o.partial_fourier or 1.0).withColumns(zero), None, False, None)

    vst = o.vst if o.vst is not None else not o.phase and facts.low >= 0
    if (o.noise_dof is not None or o.preserve_noise_bias) and not vst:
        raise ValueError("noise_dof and preserve_noise_bias describe vst, which is off")
    groups: list[int] | None = None
    named: tuple = ()
    if o.demean:
        b = shells.check_bvals(list(o.bvals), n)
        rows = voxels.sparkSession.createDataFrame([("img", t, x) for t, x in enumerate(b)], "img string, t int, b double")
        found_shells = sorted(shells.shells(rows).collect(), key=lambda r: r.t)
        groups = [-1 if r.grp is None else r.grp for r in found_shells]
        named = tuple(sorted({(r.shell_b, r.shell_n) for r in found_shells if r.grp is not None}))
    ngroups = max(groups) + 1 if groups else 0
    filter = o.filter
    need_map = filter not in OWN_LEVEL or vst
    if n - ngroups < 3:
        if o.noise:
            raise ValueError("a noise map needs at least 3 noise columns (volumes minus demeaned shells)")
        filter, vst, need_map = ("optthresh", False, False) if need_map else (filter, vst, need_map)

    spacing, extent = sane_spacing(spacing), o.extent or auto_extent(n)
    g = Geometry(tuple(dims), n, extent, o.shape, spacing, ngroups)
    g1 = g
    if need_map:
        cap = min(dims) if o.shape == "cube" else sphere_cap(math.prod(dims))
        g1 = Geometry(tuple(dims), n, sigma_extent(n, extent, cap), o.shape, spacing, ngroups)
    if mask is not None and mask.isEmpty():
        raise ValueError("the mask holds no voxel")

    real = None
    if phase is not None:
        voxels = real = cut(rotate.rotate_to_real(voxels, phase, nx, ny, o.phaseunits or "auto", o.phase_filter))
    if mask is not None:
        inner = mask.select("img", "v", F.lit(True).alias("inside")).distinct()
        voxels = voxels.join(inner, ["img", "v"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    inside = "inside" if mask is not None else None
    means = (lambda v: shells.shell_means(v, groups)) if groups else (lambda v: v)
    now, grid = means(voxels), sigma_grid(means(voxels), g1, groups) if need_map else None
    if vst:
        found = filled(cut(patches.with_level(voxels.select("img", "v", *patches.AXES, "ts", *([inside] if inside else [])), grid, g1, "sigma")))
        vst = found is not None
    if vst:
        vt = stabiliser(o.noise_dof or 1)
        own = F.when(lattice.live(F.col("ts")), F.col("sigma").cast("double")).otherwise(-F.col("sigma").cast("double"))  # below 0: not stabilised
        held = cut(found.withColumn("own", own))
        for k in range(VST_ROUNDS):
            now = cut(means(_mapped(held, lambda x, s: vt.forward(x / s), "own")))
            if k < VST_ROUNDS - 1:
                rated = patches.with_level(held, sigma_grid(now, g1, groups), g1, "ratio")
                sigma = F.when(F.col("ratio") > 0, F.col("sigma") * F.col("ratio")).otherwise(F.col("sigma")).cast("float")
                held = cut(rated.withColumn("sigma", sigma).withColumn("own", own).drop("ratio"))
        now, grid = now.withColumn("known", F.lit(1.0)), None

    fallbacks, counters = 0, {}
    if o.aggregator == "exclusive":
        out = patches.denoise_exclusive(now, g, filter, groups, inside, grid)
    else:
        stride = o.stride or 2
        fwhm = None if o.aggregator == "uniform" else o.aggregator_fwhm or 2.0
        now = cut(now) if not vst and (groups or inside) else now
        sums = patches.patch_sums(now, g, low_rank(g, filter), stride, fwhm, groups, inside, grid)
        counts = Observation()
        state = F.col("state")
        seen = {"wanted": F.count_if(state != patches.UNWANTED), "fallbacks": F.count_if(state == patches.MISSING), "without_signal": F.count_if((state == patches.DONE) & ~lattice.live(F.col("ts"))), "rank_sum": F.sum(F.when(state == patches.DONE, F.col("rank")))}
        out = cut(patches.merged(sums, patches.tile_tasks(now, g, g.tile(stride))).observe(counts, *(c.alias(k) for k, c in seen.items())))
        counters = {k: int(v or 0) for k, v in counts.get.items()}  # counted by the job that wrote
        fallbacks = counters["fallbacks"]
        missing = out.where(state == patches.MISSING).select("img", "v", F.lit(True).alias("wanted"))
        if fallbacks:  # voxels that no patch covered: their own patch
            left = now.join(missing, ["img", "v"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
            alone = patches.denoise_exclusive(left, g, filter, groups, "wanted", grid)
            out = out.where(F.col("state") != patches.MISSING).unionByName(alone.where(F.col("state") == patches.DONE))
    if vst:
        wanted = F.when(F.col("state") != patches.UNWANTED, F.col("own")).otherwise(0.0)
        out = _mapped(out.withColumn("own", wanted), lambda x, s: s * vt.inverse(x, not o.preserve_noise_bias), "own")
        out = out.withColumn("sigma", F.when(F.col("sigma") != 0, F.abs("own")).otherwise(0.0))
    out = lattice.with_coordinates(out, nx, ny).select("img", "v", "x", "y", "z", "ts", "sigma", "rank")
    if o.degibbs == "y":
        out = unrung(out, nx, ny, n, o.partial_fourier or 1.0).join(out.select("img", "v", "sigma", "rank"), ["img", "v"])
    return Result(out, real, vst, g, filter, named, fallbacks, counters)
