"""Exact quantiles of very many numbers by counting: radix selection over the bits of floats.

A number's bits, turned so that they sort as the number does, are read 16 at a time. Each round counts, per image, the digits
of the numbers that still share the wanted order statistic's leading digits; tasks count in numpy and send only counts, at most
65,536 an image and statistic. Two rounds settle 32-bit floats and four 64-bit ones, and no task ever holds an image's numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT = 16
#: Tables of counts that a task holds before it sends them.
HELD = 32


def sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort as the floats x, which hold no NaN; both zeros are one."""
    bits = x.dtype.itemsize * 8
    kind = np.dtype(f"u{bits // 8}")
    raw = (x + x.dtype.type(0)).view(kind)
    top = kind.type(1) << kind.type(bits - 1)
    return np.where(raw & top, ~raw, raw | top)


def number(key: np.ndarray, bits: int) -> np.ndarray:
    """The floats of sortable keys."""
    kind = np.dtype(f"u{bits // 8}")
    key = key.astype(np.uint64).astype(kind)
    top = kind.type(1) << kind.type(bits - 1)
    return np.where(key & top, key ^ top, ~key).view(f"f{bits // 8}").astype(np.float64)


def _counts(rows: DataFrame, bits: int, done: int) -> DataFrame:
    """(img, lead, digit, n) of rows (img, xs, leads): how many of xs with the leading digits `lead` go on with a digit."""
    kind = np.dtype(f"f{bits // 8}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            parts = [(img, lead, np.flatnonzero(n), n) for (img, lead), n in held.items()]
            sizes = [len(d) for _, _, d, _ in parts]
            join = lambda xs, t: pa.array(np.concatenate([np.zeros(0, t), *xs]).astype(t))
            imgs = pa.array([img for (img, *_), s in zip(parts, sizes, strict=True) for _ in range(s)], pa.string())
            return pa.RecordBatch.from_arrays([imgs, join([np.full(s, lead) for (_, lead, *_), s in zip(parts, sizes, strict=True)], np.int64), join([d for *_, d, _ in parts], np.int32), join([n[d] for *_, d, n in parts], np.int64)], names=["img", "lead", "digit", "n"])

        for b in batches:
            images, at = b.column(0).to_pylist(), b.column(1).offsets.to_numpy()
            flat = b.column(1).values.to_numpy(zero_copy_only=False).astype(kind)
            leads = b.column(2).to_pylist()
            cuts = [k for k in range(len(images)) if not k or images[k] != images[k - 1]]
            for a, z in zip(cuts, [*cuts[1:], len(images)], strict=True):
                x = flat[at[a] : at[z]]
                key = sortable(x[~np.isnan(x)]).astype(np.uint64)
                digit = (key >> np.uint64(bits - done - DIGIT)) & np.uint64((1 << DIGIT) - 1)
                own = key >> np.uint64(bits - done) if done else None
                for lead in set(leads[a]):
                    chosen = digit if own is None else digit[own == np.uint64(lead)]
                    n = np.bincount(chosen.astype(np.int64), minlength=1 << DIGIT)
                    held[images[a], lead] = held.get((images[a], lead), 0) + n
            if len(held) > HELD:
                yield sent()
                held.clear()
        yield sent()

    return rows.mapInArrow(run, "img string, lead long, digit int, n long").groupBy("img", "lead", "digit").agg(F.sum("n").alias("n"))


def quantiles(values: DataFrame, shares: Sequence[float], column: str = "ts", only: Column | None = None) -> DataFrame:
    """(img, share, level): the interpolated quantiles of the numbers in `column` (a float or double, or an array of them) of each image.

    The level lies between the order statistics around share * (n - 1), as SQL's continuous percentile. Nulls and NaN do not
    count, nor do rows where the condition `only` does not hold; an image without numbers has no row. Rows of any number of
    images; a row's numbers are one image's."""
    kind = dict(values.dtypes)[column]
    element = kind.removeprefix("array<").removesuffix(">")
    bits = 32 if element == "float" else 64
    x = F.col(column) if kind.startswith("array") else F.array(column)
    rows = (values if only is None else values.where(only)).select("img", F.filter(x.cast(f"array<{'float' if bits == 32 else 'double'}>"), lambda v: v.isNotNull()).alias("xs"))
    state = None
    for done in range(0, bits, DIGIT):
        leads = F.array(F.lit(0).cast("long"))
        if state is None:
            asked = rows.withColumn("leads", leads)
        else:
            asked = rows.join(state.groupBy("img").agg(F.collect_set("lead").alias("leads")), "img")
        counted = _counts(asked, bits, done)
        upto = Window.partitionBy("img", "lead").orderBy("digit")
        sums = counted.withColumn("upto", F.sum("n").over(upto))
        if state is None:
            total = sums.groupBy("img", "lead").agg(F.sum("n").alias("total"))
            h = F.col("share") * (F.col("total") - 1)
            ranks = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.floor(h).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(h).alias("rank"))))
            asked_shares = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
            state = total.select("img", "lead", "total", asked_shares).select("img", "lead", "share", (h - F.floor(h)).alias("part"), ranks)
        met = state.join(sums, ["img", "lead"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        lead = F.shiftleft("lead", DIGIT).bitwiseOR(F.col("digit").cast("long"))
        state = met.select("img", lead.alias("lead"), "share", "part", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))

    def floats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(1).to_numpy().astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(number(key, bits))], names=["img", "share", "part", "side", "x"])

    found = state.select("img", "lead", "share", "part", "side").mapInArrow(floats, "img string, share double, part double, side int, x double")
    low, high = (F.max(F.when(F.col("side") == k, F.col("x"))) for k in (0, 1))
    return found.groupBy("img", "share").agg((low + F.max("part") * (high - low)).alias("level"))
