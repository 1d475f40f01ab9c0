"""Comparison of two images, as aggregations over their voxels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import quantiles


#: Per image and task: sums over the samples, the largest difference and where it is, and per volume a hash and counts.
PARTS = (
    "img string, n long, unmatched long, zero_voxels long, negative long, odd long, over long, over_voxels long, unequal long, max_abs double, v long, t int, "
    "squares_a double, squares_b double, squares_d double, hash array<bigint>, seen array<bigint>, over_t array<bigint>"
)
_ADDED = ("n", "unmatched", "zero_voxels", "negative", "odd", "over", "over_voxels", "unequal", "squares_a", "squares_b", "squares_d")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers well mixed, to be added up by exclusive or."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _squares(voxels: DataFrame) -> DataFrame:
    """(img, level): the root mean square of the samples of each image, NaN aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for img, (ts,) in _by_image(b.column(0), b.column(1)):
                good = ts[~np.isnan(ts)]
                total = held.setdefault(img, [0.0, 0])
                total[0], total[1] = total[0] + float((good * good).sum()), total[1] + good.size
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.float64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["img", "squares", "n"])

    parts = voxels.select("img", "ts").mapInArrow(run, "img string, squares double, n long")
    return parts.groupBy("img").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("level"))


def _by_image(images: pa.Array, *columns: pa.Array) -> Iterator[tuple[str, list[np.ndarray]]]:
    """(image, columns of its rows): series (of one length) as a matrix of doubles, numbers as they are."""
    names = np.array(images.to_pylist(), object)
    for img in dict.fromkeys(names.tolist()):
        at = pa.array(np.flatnonzero(names == img))
        out = []
        for c in columns:
            c = c.take(at)
            out.append(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False))
        yield img, out


def compare(a: DataFrame, b: DataFrame, threshold: float = 0.01, relative_to: str = "b") -> DataFrame:
    """One row per image on how the series (img, v, ts) of a differ from those of b; all series of an image have one length.

    n samples; max_abs, the largest difference, and where it is, the first by voxel and volume of equal ones; rel_l2, the norm of the
    difference over that of b; rms and rms_b; negative samples, voxels that are all zero and distinct volumes of a; equal, whether
    all samples are; over_share, the share of samples that differ by more than threshold times the rms of b (or of a), over_voxels and
    over_volumes, how many voxels and volumes these lie in. Differences that are not a number count nowhere but in odd. Voxels that
    only one image has count in unmatched. Tasks sum whole batches; a row a task and image, with numbers for each volume, is shuffled."""
    if relative_to not in ("a", "b"):
        raise ValueError("relative_to must be a or b")
    level = _squares({"a": a, "b": b}[relative_to])
    rows = a.select("img", "v", "ts").join(b.select("img", "v", F.col("ts").alias("other")), ["img", "v"], "full_outer").join(level, "img", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            one_sided = pc.or_(pc.is_null(batch.column(2)), pc.is_null(batch.column(3))).to_numpy(zero_copy_only=False)
            lonely = batch.filter(pa.array(one_sided))
            for img, own in zip(lonely.column(0).to_pylist(), lonely.column(2).to_pylist(), strict=True):
                part = held.setdefault(img, {})
                part["unmatched"] = part.get("unmatched", 0) + 1
                part["zero_voxels"] = part.get("zero_voxels", 0) + (own is not None and not any(own))
            both = batch.filter(pa.array(~one_sided))
            for img, (v, x, y, level) in _by_image(both.column(0), *both.columns[1:]):
                if x.shape != y.shape:
                    raise ValueError(f"the series of {img} differ in length")
                d = np.abs(x - y)
                good = ~np.isnan(d)
                over = good & (d > threshold * level[0])
                least = np.where(good, d, -1.0)
                k = np.lexsort((v, -least.max(axis=1)))[0]  # of equal differences the first voxel, then its first volume
                top = (least[k].max(), int(v[k]), int(least[k].argmax()))
                now = {
                    "n": d.size, "zero_voxels": int((x == 0).all(axis=1).sum()), "negative": int((x < 0).sum()), "odd": int((~good).sum()), "over": int(over.sum()), "over_voxels": int(over.any(axis=1).sum()),
                    "unequal": int((~((x == y) | (np.isnan(x) & np.isnan(y)))).sum()), "squares_a": float((x * x).sum()), "squares_b": float((y[good] ** 2).sum()), "squares_d": float((d[good] ** 2).sum()),
                }
                part = held.setdefault(img, {})
                for name, value in now.items():
                    part[name] = part.get(name, 0) + value
                if top[0] >= 0 and ("top" not in part or (-top[0], *top[1:]) < (-part["top"][0], *part["top"][1:])):
                    part["top"] = top
                own = _mixed((x + 0.0).view(np.uint64) ^ _mixed(v)[:, None])
                part["hash"] = part.get("hash", np.uint64(0)) ^ np.bitwise_xor.reduce(own, axis=0)
                part["seen"] = part.get("seen", 0) + np.full(x.shape[1], len(x))
                part["over_t"] = part.get("over_t", 0) + over.sum(axis=0)
        columns: list[list] = [[] for _ in PARTS.split(", ")]
        for img, part in held.items():
            top = part.get("top", (None, None, None))
            lists = [part[c].astype(np.uint64).view(np.int64).tolist() if c in part else [] for c in ("hash", "seen", "over_t")]
            row = [img, *(part.get(c, 0) for c in _ADDED[:8]), *top, *(part.get(c, 0.0) for c in _ADDED[8:]), *lists]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
        named = [c.split(" ") for c in PARTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, named, strict=True)], names=[name for name, _ in named])

    parts = rows.select("img", "v", "ts", "other", "level").mapInArrow(run, PARTS)
    added = [F.sum(c).alias(c) for c in _ADDED]
    found = parts.groupBy("img").agg(*added, F.min(F.when(F.col("v").isNotNull(), F.struct(-F.col("max_abs"), "v", "t"))).alias("at"), F.max("max_abs").alias("max_abs"))
    volumes = parts.select("img", F.posexplode(F.arrays_zip("hash", "seen", "over_t")).alias("t", "x")).groupBy("img", "t").agg(F.bit_xor("x.hash").alias("h"), F.sum("x.seen").alias("c"), F.sum("x.over_t").alias("over"))
    each = volumes.groupBy("img").agg(F.countDistinct("h", "c").alias("distinct_volumes"), F.count_if(F.col("over") > 0).alias("over_volumes"))
    norm = level if relative_to == "b" else _squares(b)
    out = found.where("n > 0").join(each, "img").join(norm, "img")
    return out.select(
        "img", "n", "max_abs", F.col("at.v").alias("max_v"), F.col("at.t").alias("max_t"), F.sqrt(F.col("squares_d") / F.col("squares_b")).alias("rel_l2"), F.sqrt(F.col("squares_a") / F.col("n")).alias("rms"), F.col("level").alias("rms_b"), "negative", "zero_voxels",
        (F.col("unequal") == 0).alias("equal"), "odd", "unmatched", (F.col("over") / F.col("n")).alias("over_share"), "distinct_volumes", "over_voxels", "over_volumes",
    )


def same_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """(img, equal) for masks (img, v, value): whether the voxels above 0 are the same."""
    inside = lambda m, name: m.where("value > 0").select("img", "v", F.lit(True).alias(name))
    both = inside(a, "in_a").join(inside(b, "in_b"), ["img", "v"], "full_outer")
    images = a.select("img").union(b.select("img")).distinct()
    return images.join(both.groupBy("img").agg(F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("n")), "img", "left").select("img", (F.coalesce("n", F.lit(0)) == 0).alias("equal"))


def window(voxels: DataFrame, share: float = 0.995) -> DataFrame:
    """(img, level): the exact, interpolated percentile of the samples of each image, for a display window. Only counts are shuffled."""
    return quantiles(voxels, [share]).select("img", "level")
