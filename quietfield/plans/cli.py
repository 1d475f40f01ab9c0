"""Command line: python -m quietfield.plans.cli INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse
import itertools
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

from quietfield import ready
from quietfield.operators import rotate, shells
from quietfield.operators.kernels import FILTERS
from quietfield.operators.rotate import UNITS
from quietfield.sources import nifti
from quietfield.tables import cut

from .denoise import AGGREGATORS, SHAPES, DenoiseOptions, denoise, zero_share

GRID_TOLERANCE_MM, VERSION = 0.001, "0.2"
#: Spellings of the partial Fourier factor.
FOURIER = {"1.0": 1.0, "1": 1.0, "0.875": 0.875, "7/8": 0.875, "0.75": 0.75, "6/8": 0.75}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quietfield", allow_abbrev=False, add_help=False)
    p.add_argument("-help", "--help", "-h", action="help", help="print this message and exit")
    p.add_argument("-version", "--version", action="version", version=f"quietfield {VERSION}")
    p.add_argument("input")
    p.add_argument("output")
    for name in ("phase", "real", "mask", "noise", "rank", "bval"):
        p.add_argument(f"-{name}")
    yes = lambda v: {"y": True, "n": False}[v]
    p.add_argument("-phaseunits", choices=UNITS)
    p.add_argument("-demean", type=yes, default=False)
    p.add_argument("-filter", choices=FILTERS, default="optshrink")
    p.add_argument("-shape", choices=SHAPES, default="sphere")
    p.add_argument("-aggregator", choices=AGGREGATORS, default="gaussian")
    p.add_argument("-aggregator_fwhm", type=float)
    p.add_argument("-stride", type=int)
    p.add_argument("-vst", type=yes)
    p.add_argument("-noise_dof", type=int)
    p.add_argument("-preserve_noise_bias", action="store_true")
    p.add_argument("-extent", type=int)
    p.add_argument("-degibbs", choices=("y", "n", "o"), default="n")
    p.add_argument("-pF", type=lambda v: FOURIER[v], dest="partial_fourier")
    p.add_argument("-nthreads", "-p", type=int)
    p.add_argument("-quiet", action="store_true")
    return p


def check_paths(images: list[str], outputs: list[str], two_file: bool = False, files: list[str] = ()) -> None:
    """Refuse two roles that share a file, links and both files of a pair considered; '-' is no output.

    images and files are read, files exactly as named. Two inputs may not be one file either: a magnitude is not its own phase."""
    if "-" in outputs:
        raise ValueError("an image cannot be written to standard output")
    read = [{os.path.realpath(p) for p in nifti.input_names(i)} for i in images if i != "-"] + [{os.path.realpath(f)} for f in files]
    written = [{os.path.realpath(p) for p in nifti.output_names(o, two_file)} for o in outputs]
    same = lambda a, b: any(x == y or (os.path.exists(x) and os.path.exists(y) and os.path.samefile(x, y)) for x in a for y in b)
    for a, b in itertools.combinations([*read, *written], 2):
        if same(a, b):
            raise ValueError(f"{sorted(a)[0]} and {sorted(b)[0]} are the same file")


def spooled(spark: SparkSession, stream) -> str:
    """An image from a stream, as a file in the shared folder, for standard input has no slabs to seek."""
    path = nifti.local_scratch(spark, "stdin")
    first = stream.read(2)
    path += ".nii.gz" if first == b"\x1f\x8b" else ".nii"
    with open(path, "wb") as f:
        f.write(first)
        shutil.copyfileobj(stream, f, 1 << 20)
    return path


def mask_of(spark: SparkSession, path: str, head: nifti.Header) -> DataFrame:
    """(img, v) where the mask image is above 0; only its dimensions must fit."""
    own, _ = nifti.read_header(path)
    if own.shape != (*head.shape[:3], 1):
        raise ValueError("the mask must be one volume with the image's dimensions")
    return nifti.read_nifti(spark, path).where("ts[0] > 0").select("img", "v")


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Read, denoise and write: noise map, rank map and rotated series first, the main output last."""
    ready(spark)
    if args.input == "-" and args.demean and not args.bval:
        raise ValueError("standard input has no name to find b-values by: give -bval")
    source = spooled(spark, sys.stdin.buffer) if args.input == "-" else args.input
    head, _ = nifti.read_header(source)
    bval = args.bval or (shells.sidecar(args.input) if args.demean else None)
    check_paths([p for p in (args.input, args.phase, args.mask) if p], [p for p in (args.noise, args.rank, args.real, args.output) if p], head.two_file, [bval] if bval else [])
    bvals = None
    if bval:
        rows = shells.read_bvals(spark, bval).orderBy("t").collect()
        bvals = tuple(shells.check_bvals([r.b for r in rows], head.shape[3]))
    options = DenoiseOptions(
        filter=args.filter, shape=args.shape, aggregator=args.aggregator, aggregator_fwhm=args.aggregator_fwhm, stride=args.stride, extent=args.extent, vst=args.vst,
        noise_dof=args.noise_dof, preserve_noise_bias=args.preserve_noise_bias, demean=args.demean, bvals=bvals, phase=bool(args.phase), phaseunits=args.phaseunits,
        real=bool(args.real), mask=bool(args.mask), noise=bool(args.noise), rank=bool(args.rank), degibbs=args.degibbs, partial_fourier=args.partial_fourier,
    ).validate()
    phase = None
    if args.phase:
        other, _ = nifti.read_header(args.phase)
        if other.shape != head.shape:
            raise ValueError("the phase must have the image's dimensions")
        if not nifti.grid_distance(head, other) <= GRID_TOLERANCE_MM:
            raise ValueError("the phase lies on another grid")
        phase = nifti.read_nifti(spark, args.phase)
    mask = mask_of(spark, args.mask, head) if args.mask else None
    voxels = nifti.read_nifti(spark, source)
    done = denoise(voxels, head.shape[:3], tuple(head.pixdim[1:4]), options, mask, phase)
    out = cut(done.voxels)
    say = lambda text: print(f"quietfield: {text}", file=sys.stderr)
    if not args.quiet:
        say(done.summary())
    if phase is not None and rotate.changes_nothing(phase, options.phaseunits or "auto"):
        say("warning: every phase value is a whole number of turns, so the output is the magnitude unchanged; check -phaseunits")
    if done.vst and (share := zero_share(out, voxels, mask)) > 0.5:
        say(f"warning: {100 * share:.0f} % of the output is zero, at or below the noise floor; check -noise_dof, or use -preserve_noise_bias or -vst n")
    for path, frame, column, kind in ((args.noise, out, "sigma", 16), (args.rank, out, "rank", 512), (args.real, done.real, "ts", 16), (args.output, out, "ts", 16)):
        if path:
            nifti.write_nifti(frame, path, head, kind, column)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quietfield").getOrCreate()
    try:
        run(spark, args)
    except (ValueError, OSError) as e:
        print(f"quietfield: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
