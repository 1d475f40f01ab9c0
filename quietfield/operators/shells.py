"""Shells of volumes with like b-values: clustering, means, and their removal."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: b-values up to this count as unweighted, and neighbours this far apart begin a new shell (fixed values).
UNWEIGHTED, GAP = 10, 80


def read_bvals(spark: SparkSession, path: str, img: str = "img") -> DataFrame:
    """(img, t, b) from a text file of b-values separated by white space."""
    words = F.filter(F.split(F.concat_ws(" ", F.collect_list("value")), r"\s+"), lambda w: w != "")
    rows = spark.read.option("wholetext", True).text(path).agg(words.alias("w"))
    return rows.select(F.lit(img).alias("img"), F.posexplode("w").alias("t", "b")).withColumn("b", F.expr("try_cast(b AS double)"))


def sidecar(path: str) -> str:
    """The b-value file that belongs to an image."""
    return re.sub(r"\.(nii\.gz|nii|hdr|img)$", "", path, flags=re.IGNORECASE) + ".bval"


def check_bvals(bvals: list, nvol: int) -> list[float]:
    """The b-values as floats; there must be one for each volume, finite and not negative."""
    if len(bvals) != nvol:
        raise ValueError(f"{len(bvals)} b-values for {nvol} volumes")
    if any(b is None or not math.isfinite(b) or b < 0 for b in bvals):
        raise ValueError("b-values must be finite and not negative")
    return [float(b) for b in bvals]


def shells(bvals: DataFrame) -> DataFrame:
    """(img, t, b, grp, shell_b, shell_n) of (img, t, b): gaps and islands over the sorted b-values.

    A weighted b-value opens a shell after an unweighted one or a gap of GAP; equal values share a shell. Shells
    of one volume have null grp; the others are numbered from 0 in the order of b."""
    by_b = Window.partitionBy("img").orderBy("b")
    before = F.lag("b").over(by_b)
    opens = F.when((F.col("b") > UNWEIGHTED) & ((before <= UNWEIGHTED) | (F.col("b") - before >= GAP)), 1).otherwise(0)
    rows = bvals.withColumn("opens", opens).withColumn("shell", F.sum("opens").over(by_b))
    found = rows.groupBy("img", "shell").agg(F.avg("b").alias("shell_b"), F.count("*").cast("int").alias("shell_n"))
    kept = found.where("shell_n >= 2").withColumn("grp", (F.dense_rank().over(Window.partitionBy("img").orderBy("shell")) - 1).cast("int"))
    return rows.join(kept, ["img", "shell"], "left").select("img", "t", "b", "grp", "shell_b", "shell_n")


def shell_means(voxels: DataFrame, groups: list[int]) -> DataFrame:
    """voxels with `means array<float>`: the mean of each shell's volumes, within the row. groups: shell of each volume, -1 for none."""
    out = []
    for k in range(max(groups, default=-1) + 1):
        own = [t for t, grp in enumerate(groups) if grp == k]
        total = F.aggregate(F.array(*[F.col("ts")[t].cast("double") for t in own]), F.lit(0.0), lambda a, x: a + x)
        out.append((total / len(own)).cast("float"))
    return voxels.withColumn("means", F.array(*out) if out else F.array().cast("array<float>"))


def volumes_from(bvals: Sequence[float], least: float) -> list[int]:
    """Volumes whose b-value is at least `least`, in order: for a reader's `volumes`, or a filter on t."""
    return [t for t, b in enumerate(bvals) if b >= least]
