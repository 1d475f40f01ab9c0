"""The array operators over the driver's tables, each with its SQL where SQL can express it.

Queries call the functions that the denoising pipeline runs. Bindings: `embeddings` is a series on a 10 by 10 by n lattice
(voxel = vec_id), `lineitem` counts to a 7 by 50 plane, `events` has a level per user, `part` has b-values per brand."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.functions import randommatrix
from quietfield.functions.geometry import Geometry
from quietfield.operators import compare, kernels, lattice, patches, rotate, shells, unring
from quietfield.operators.select import quantiles
from quietfield.sources import nifti

from .denoise import DenoiseOptions, denoise, filled

NX = NY = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_voxels(spark: SparkSession, sf_dir: str, n: int = 64) -> tuple[DataFrame, tuple[int, int, int]]:
    """(voxels, dims): the first n numbers of embeddings as series on the lattice; slices that are not full are left empty at the end."""
    rows = table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("img"), F.col("vec_id").alias("v"), F.slice("embedding", 1, n).alias("ts"), "label")
    top = rows.agg(F.max("v")).first()[0]
    dims = (NX, NY, -(-(top + 1) // (NX * NY)))
    return lattice.with_coordinates(rows, NX, NY).select("img", "v", "x", "y", "z", "ts", "label"), dims


def pair_voxels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """(voxels, dims): the embeddings as 32 images of two volumes each, so that every number is read."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.concat(F.lit("pair"), k.cast("string")).alias("img"), F.slice("ts", 2 * k + 1, F.lit(2)).alias("ts")))
    return voxels.select("v", "x", "y", "z", "label", F.inline(pairs)).select("img", "v", "x", "y", "z", "ts", "label"), dims


def numpy_rows(df: DataFrame, f: Callable[[list[np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """f over the columns of df as numpy arrays, batch by batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in f([c.to_numpy(zero_copy_only=False) for c in b.columns])], names=names)

    return df.mapInArrow(run, schema)


@query("""
SELECT i, j, round(sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE)), 6) AS g
FROM embeddings, (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) WHERE i <= j GROUP BY i, j
""")
def ref_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gram matrix of all series: each task sums its own, and only N by N numbers per task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                y = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
                own = kernels.gram(y[None])[0]
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "g"])

    parts = table(spark, sf_dir, "embeddings").select("embedding").mapInArrow(run, "i long, j long, g double")
    return parts.groupBy("i", "j").agg(F.round(F.sum("g"), 6).alias("g"))


@query("""
WITH a AS (SELECT p_brand AS img, p_partkey AS t, p_retailprice AS b, lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS was FROM part),
f AS (SELECT *, CASE WHEN b > 10 AND (was <= 10 OR b - was >= 80) THEN 1 ELSE 0 END AS opens FROM a),
s AS (SELECT *, sum(opens) OVER (PARTITION BY img ORDER BY b) AS shell FROM f),
n AS (SELECT img, shell, avg(b) AS shell_b, CAST(count(*) AS INT) AS shell_n FROM s GROUP BY img, shell),
k AS (SELECT img, shell, CAST(dense_rank() OVER (PARTITION BY img ORDER BY shell) - 1 AS INT) AS grp FROM n WHERE shell_n >= 2)
SELECT s.img, s.t, k.grp, CASE WHEN k.grp IS NULL THEN NULL ELSE round(n.shell_b, 4) END AS shell_b, CASE WHEN k.grp IS NULL THEN NULL ELSE n.shell_n END AS shell_n
FROM s JOIN n ON s.img = n.img AND s.shell = n.shell LEFT JOIN k ON s.img = k.img AND s.shell = k.shell
""")
def ref_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shells of b-values, by gaps and islands, one image per brand."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("img"), F.col("p_partkey").alias("t"), F.col("p_retailprice").alias("b"))
    return shells.shells(rows).select("img", "t", "grp", F.round("shell_b", 4).alias("shell_b"), "shell_n")


@query("""
WITH s AS (SELECT vec_id, unnest(range(64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
m AS (SELECT *, CASE WHEN t < 60 THEN CAST(CAST(avg(value) OVER (PARTITION BY vec_id, CASE WHEN t < 60 THEN t % 4 ELSE -1 END) AS FLOAT) AS DOUBLE) ELSE 0 END AS mean FROM s)
SELECT vec_id AS v, CAST(t AS INT) AS t, round(value - mean, 4) + 0.0 AS value, round(mean, 4) + 0.0 AS mean FROM m
""")
def ref_demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shell means taken off: every fourth volume is a shell, the last four volumes have none."""
    voxels, _ = embedding_voxels(spark, sf_dir)
    groups = [t % 4 if t < 60 else -1 for t in range(64)]

    def run(columns: list[np.ndarray]) -> list[np.ndarray]:
        v, ts, means = columns
        value, mean = kernels.demeaned(np.stack(ts).astype(np.float64), np.stack(means), np.array(groups))
        return [np.repeat(v, 64), np.tile(np.arange(64, dtype=np.int32), len(v)), value.ravel(), mean.ravel()]

    out = numpy_rows(shells.shell_means(voxels, groups).select("v", "ts", "means"), run, "v long, t int, value double, mean double")
    return out.select("v", "t", (F.round("value", 4) + 0.0).alias("value"), (F.round("mean", 4) + 0.0).alias("mean"))


_LATTICE = "v AS (SELECT vec_id AS v, CAST(embedding[1] AS DOUBLE) AS value, label, vec_id % 10 AS x, (vec_id // 10) % 10 AS y, vec_id // 100 AS z FROM embeddings), d AS (SELECT max(z) + 1 AS nz FROM v)"
_CUBE = """o AS (SELECT unnest(range(3)) AS k),
c AS (SELECT v.v AS centre, x, y, z, greatest(0, least(x - 1, 7)) AS ox, greatest(0, least(y - 1, 7)) AS oy, greatest(0, least(z - 1, nz - 3)) AS oz FROM v, d{where}),
n AS (SELECT centre, c.x, c.y, c.z, (ox + a.k) + 10 * ((oy + b.k) + 10 * (oz + e.k)) AS v FROM c, o a, o b, o e)"""


_PAIRS = """v AS (SELECT 'pair' || k AS img, vec_id AS v, CAST(embedding[2 * k + 1] AS DOUBLE) AS y1, CAST(embedding[2 * k + 2] AS DOUBLE) AS y2, label, vec_id % 10 AS x, (vec_id // 10) % 10 AS y, vec_id // 100 AS z
    FROM embeddings, (SELECT unnest(range(32)) AS k)), d AS (SELECT max(z) + 1 AS nz FROM v)"""
_PAIR_CUBE = """o AS (SELECT unnest(range(3)) AS k),
c AS (SELECT img, v.v AS centre, x, y, z, greatest(0, least(x - 1, 7)) AS ox, greatest(0, least(y - 1, 7)) AS oy, greatest(0, least(z - 1, nz - 3)) AS oz FROM v, d{where}),
n AS (SELECT img, centre, c.x, c.y, c.z, (ox + a.k) + 10 * ((oy + b.k) + 10 * (oz + e.k)) AS v FROM c, o a, o b, o e)"""


@query(f"""
WITH {_PAIRS}, {_PAIR_CUBE.format(where=" WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")},
m AS (SELECT n.img, centre, avg(y1) AS est1, avg(y2) AS est2 FROM n JOIN v ON n.v = v.v AND n.img = v.img GROUP BY n.img, centre),
w AS (SELECT n.img, n.v, est1, est2, exp(-4 * ln(2) / 16 * ((v.x - n.x) ** 2 + (v.y - n.y) ** 2 + (v.z - n.z) ** 2)) AS w FROM n JOIN m ON n.centre = m.centre AND n.img = m.img JOIN v ON v.v = n.v AND v.img = n.img)
SELECT img, v, round(CAST(CAST(sum(w * est1) / sum(w) AS FLOAT) AS DOUBLE), 4) + 0.0 AS mean1, round(CAST(CAST(sum(w * est2) / sum(w) AS FLOAT) AS DOUBLE), 4) + 0.0 AS mean2, 1 AS rank FROM w GROUP BY img, v
""")
def ref_overlap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian-weighted mean of overlapping patch estimates (here patch means), centres at stride 2, for each pair of volumes.

    A third volume of ones tells the voxels that are there from places without one, which neither count nor are centres."""
    voxels, dims = pair_voxels(spark, sf_dir)
    voxels = voxels.withColumn("ts", F.concat("ts", F.array(F.lit(1.0).cast("float"))))

    def patch_mean(y: np.ndarray, known: np.ndarray | None):
        total = y.sum(axis=1, keepdims=True)
        return np.broadcast_to(total / total[..., 2:], y.shape), np.zeros(len(y)), np.ones(len(y))

    out = patches.merged(patches.patch_sums(voxels, Geometry(dims, 3, 3, "cube"), patch_mean, 2, 2.0, held=True)).where(F.col("state") == patches.DONE)
    return out.select("img", "v", *((F.round(F.col("ts")[k].cast("double"), 4) + 0.0).alias(f"mean{k + 1}") for k in (0, 1)), "rank")


def _centres(voxels: DataFrame, dims: tuple[int, int, int], g: Geometry, f, schema: str) -> DataFrame:
    """f(block, centres, table) for the voxels of each tile as centres, with all that their patches need around them."""
    core = np.array(g.tile())

    def run(img, tile, table, _):
        block, coords = patches._block(table, g, tile, core, np.array(g.reach), None)
        here = ((coords // core) == tile).all(axis=1)
        return f(block, coords, here, table)

    return patches.by_tile(voxels, g, core, g.reach, run, schema)


@query(f"""
WITH {_LATTICE}, {_CUBE.format(where="")}
SELECT centre, bool_or(label < 5) AS touches, CAST(count_if(label < 5) AS BIGINT) AS inside FROM n JOIN v ON n.v = v.v GROUP BY centre
""")
def ref_mask_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which patches touch the mask, and in how many voxels."""
    voxels, dims = embedding_voxels(spark, sf_dir, 2)
    g = Geometry(dims, 2, 3, "cube")

    def run(block, coords, here, table):
        inside = np.zeros(len(block.raw), bool)
        inside[block.flat(coords)] = table.column("label").to_numpy() < 5
        n = kernels.hits(block, coords[here], inside)
        return pa.table({"centre": table.column("v").to_numpy()[here], "touches": n > 0, "inside": n})

    return _centres(voxels, dims, g, run, "centre long, touches boolean, inside long")


@query(f"""
WITH {_LATTICE}, r AS (SELECT unnest(range(-6, 7)) AS k),
p AS (SELECT v.v AS centre, (x + a.k) + 10 * ((y + b.k) + 10 * (z + e.k)) AS v, a.k ** 2 + b.k ** 2 + e.k ** 2 AS d2, a.k AS dx, b.k AS dy, e.k AS dz
    FROM v, d, r a, r b, r e WHERE x + a.k BETWEEN 0 AND 9 AND y + b.k BETWEEN 0 AND 9 AND z + e.k BETWEEN 0 AND nz - 1 AND a.k ** 2 + b.k ** 2 + e.k ** 2 <= 27),
q AS (SELECT centre, v, row_number() OVER (PARTITION BY centre ORDER BY d2, dz, dy, dx) AS place FROM p)
SELECT centre, v, CAST(place AS INT) AS place FROM q WHERE place <= 81
""")
def ref_sphere_top_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels of spherical patches: the nearest 81 inside the image, ties by z, y, x."""
    voxels, dims = embedding_voxels(spark, sf_dir, 64)
    g = Geometry(dims, 64, 3)

    def run(block, coords, here, table):
        at = block.rows(coords[here])
        x, y, z = at % block.size[0], at // block.size[0] % block.size[1], at // (block.size[0] * block.size[1])
        v = x + block.low[0] + NX * (y + block.low[1] + NY * (z + block.low[2]))
        return pa.table({"centre": np.repeat(table.column("v").to_numpy()[here], g.rows), "v": v.ravel(), "place": np.tile(np.arange(1, g.rows + 1, dtype=np.int32), len(v))})

    return _centres(voxels, dims, g, run, "centre long, v long, place int")


@query("""
WITH p AS (SELECT l_linenumber - 1 AS x, CAST(l_quantity AS INT) - 1 AS y, count(*) AS s FROM lineitem GROUP BY 1, 2),
g AS (SELECT a.x, b.y, CAST(coalesce(s, 0) AS DOUBLE) AS s FROM (SELECT unnest(range(7)) AS x) a CROSS JOIN (SELECT unnest(range(50)) AS y) b LEFT JOIN p ON p.x = a.x AND p.y = b.y),
t AS (SELECT unnest(range(-3, 4)) AS k, unnest([1, 6, 15, 20, 15, 6, 1]) / 64.0::DOUBLE AS w),
u AS (SELECT (x + k + 7) % 7 AS x, y, sum(s * w) AS s FROM g, t GROUP BY 1, 2),
q AS (SELECT x, (y + k + 50) % 50 AS y, sum(s * w) AS s FROM u, t GROUP BY 1, 2)
SELECT CAST(x + 7 * y AS INT) AS p, s AS value FROM q
""")
def ref_circular_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-tap low-pass with wrap-around over the plane of line numbers and quantities; counts make it exact in single precision."""
    cell = (F.col("l_linenumber") - 1 + 7 * (F.col("l_quantity").cast("int") - 1)).alias("p")
    whole = spark.range(350).select(F.col("id").cast("int").alias("p")).join(table(spark, sf_dir, "lineitem").groupBy(cell).count(), "p", "left")

    def run(key, rows):
        px = np.zeros(350, np.float32)
        px[rows.column("p").to_numpy()] = rows.column("count").to_numpy()
        return pa.table({"p": np.arange(350, dtype=np.int32), "value": rotate.smooth_wrapped(px.reshape(1, 50, 7)).ravel().astype(np.float64)})

    plane = whole.select(F.lit(0).alias("z"), "p", F.coalesce("count", F.lit(0)).cast("float").alias("count"))
    return plane.groupBy("z").applyInArrow(run, "p int, value double")


_GRID = """c AS (SELECT least(2, CAST(floor((nz - 1) / 2) AS INT)) AS c0z, nz FROM d),
g AS (SELECT (x - 2) // 4 AS gx, (y - 2) // 4 AS gy, (z - c0z) // 4 AS gz, CASE WHEN label > 2 THEN label / 10.0 ELSE 0 END AS sigma
    FROM v, c WHERE x >= 2 AND (x - 2) % 4 = 0 AND y >= 2 AND (y - 2) % 4 = 0 AND z >= c0z AND (z - c0z) % 4 = 0),
s0 AS (SELECT gx, gy, gz, CAST(sigma AS DOUBLE) AS num, CASE WHEN sigma > 0 THEN 1.0::DOUBLE ELSE 0 END AS den FROM g),
s1 AS (SELECT gx, gy, gz, 2 * num + coalesce(lag(num) OVER w, 0) + coalesce(lead(num) OVER w, 0) AS num, 2 * den + coalesce(lag(den) OVER w, 0) + coalesce(lead(den) OVER w, 0) AS den FROM s0 WINDOW w AS (PARTITION BY gy, gz ORDER BY gx)),
s2 AS (SELECT gx, gy, gz, 2 * num + coalesce(lag(num) OVER w, 0) + coalesce(lead(num) OVER w, 0) AS num, 2 * den + coalesce(lag(den) OVER w, 0) + coalesce(lead(den) OVER w, 0) AS den FROM s1 WINDOW w AS (PARTITION BY gx, gz ORDER BY gy)),
s3 AS (SELECT gx, gy, gz, 2 * num + coalesce(lag(num) OVER w, 0) + coalesce(lead(num) OVER w, 0) AS num, 2 * den + coalesce(lag(den) OVER w, 0) + coalesce(lead(den) OVER w, 0) AS den FROM s2 WINDOW w AS (PARTITION BY gx, gy ORDER BY gz))"""


def _coarse(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Every fourth voxel with a made-up noise level: a tenth of its label, none for labels up to 2."""
    first = [min(2, (d - 1) // 2) for d in dims]
    keep = None
    for a, c in zip("xyz", first, strict=True):
        own = (F.col(a) >= c) & (F.pmod(F.col(a) - c, F.lit(4)) == 0)
        keep = own if keep is None else keep & own
    grid = [((F.col(a) - c) / 4).cast("int").alias(f"g{a}") for a, c in zip("xyz", first, strict=True)]
    return voxels.where(keep).select("img", *grid, F.when(F.col("label") > 2, F.col("label") / 10.0).otherwise(0.0).alias("sigma"))


@query(f"WITH {_LATTICE}, {_GRID} SELECT gx, gy, gz, den, round(CASE WHEN den > 0 THEN num / den ELSE 0 END, 8) AS num FROM s3")
def ref_smoothed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised [1 2 1] smoothing of the coarse grid."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    out = lattice.smoothed_sigma(_coarse(voxels, dims))
    return out.select(*[F.col(f"g{a}").cast("long").alias(f"g{a}") for a in "xyz"], "den", F.round("num", 8).alias("num"))


@query(f"""
WITH {_LATTICE}, {_GRID}, k AS (SELECT gx, gy, gz, num / den AS num FROM s3 WHERE den > 0),
u AS (SELECT v.v, least(greatest((x - 2) / 4.0, 0), 1) AS ux, least(greatest((y - 2) / 4.0, 0), 1) AS uy, least(greatest((z - c0z) / 4.0, 0), (nz - 1 - c0z) // 4) AS uz FROM v, c),
i AS (SELECT v, ux - floor(ux) AS fx, uy - floor(uy) AS fy, uz - floor(uz) AS fz, CAST(floor(ux) AS BIGINT) AS ix, CAST(floor(uy) AS BIGINT) AS iy, CAST(floor(uz) AS BIGINT) AS iz FROM u),
e AS (SELECT unnest([0, 1]) AS k),
w AS (SELECT v, ix + a.k AS gx, iy + b.k AS gy, iz + c.k AS gz, (CASE a.k WHEN 1 THEN fx ELSE 1 - fx END) * (CASE b.k WHEN 1 THEN fy ELSE 1 - fy END) * (CASE c.k WHEN 1 THEN fz ELSE 1 - fz END) AS w FROM i, e a, e b, e c),
m AS (SELECT w.v, sum(w * num) / sum(w) AS sigma FROM w JOIN k ON k.gx = w.gx AND k.gy = w.gy AND k.gz = w.gz WHERE w > 0 GROUP BY w.v)
SELECT v.v, round(CAST(CAST(coalesce(sigma, 0) AS FLOAT) AS DOUBLE), 5) AS sigma FROM v LEFT JOIN m ON m.v = v.v
""")
def ref_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed grid interpolated to every voxel."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    out = patches.with_level(voxels.drop("label"), lattice.smoothed_sigma(_coarse(voxels, dims)), Geometry(dims, 64, 5), "sigma")
    return out.select("v", F.round(F.col("sigma").cast("double"), 5).alias("sigma"))


@query("""
WITH u AS (SELECT user_id, CAST(CAST(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS FLOAT) AS DOUBLE) AS s FROM events GROUP BY user_id),
m AS (SELECT CAST(CAST(median(s) FILTER (WHERE s > 0) AS FLOAT) AS DOUBLE) AS m FROM u)
SELECT user_id, round(CASE WHEN s > 0 THEN s ELSE m END, 1) AS sigma FROM u, m
""")
def ref_sigma_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that are not positive replaced by the median of the positive ones."""
    level = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).cast("float").alias("sigma")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(level)
    return filled(rows.withColumn("img", F.lit("events"))).select("user_id", F.round(F.col("sigma").cast("double"), 1).alias("sigma"))


_BETA = "p_size / 50.0::DOUBLE"
_X = "p_retailprice / 1000"
_AREA = """sqrt(greatest((hi - x) * (x - lo), 0)) - (1 + b) * asin(greatest(-1, least(1, (2 * (1 + b) - 2 * x) / (4 * sqrt(b)))))
    - (1 - b) * asin(greatest(-1, least(1, (2 * (1 + b) * x - 2 * (1 - b) ** 2) / (4 * x * sqrt(b)))))"""


@query(f"""
WITH a AS (SELECT p_partkey, {_BETA} AS b, {_X} AS x FROM part), c AS (SELECT *, (1 - sqrt(b)) ** 2 AS lo, (1 + sqrt(b)) ** 2 AS hi FROM a)
SELECT p_partkey, round(sqrt(2 * (b + 1) + 8 * b / (b + 1 + sqrt(b * b + 14 * b + 1))), 9) AS lambda_star,
    round(CASE WHEN x <= lo THEN 0 WHEN x >= hi THEN 1 ELSE greatest(0, least(1, ({_AREA} + pi() * b) / (2 * pi() * b))) END, 8) AS mp_cdf FROM c
""")
def ref_random_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal threshold and Marchenko-Pastur distribution, one aspect ratio and value per part."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("beta"), (F.col("p_retailprice") / 1000).alias("x"))

    def run(columns: list[np.ndarray]) -> list[np.ndarray]:
        key, beta, x = columns
        return [key, np.array([randommatrix.lambda_star(b) for b in beta]), np.array([randommatrix.mp_cdf(a, b) for a, b in zip(x, beta, strict=True)])]

    out = numpy_rows(rows, run, "p_partkey long, lambda_star double, mp_cdf double")
    return out.select("p_partkey", F.round("lambda_star", 9).alias("lambda_star"), F.round("mp_cdf", 8).alias("mp_cdf"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, l_tax * 10 AS g FROM lineitem),
b AS (SELECT *, g * sqrt(147) AS u FROM a), c AS (SELECT *, CASE WHEN u > 0 THEN s / u END AS y FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN g = 0 THEN CASE WHEN s > 0 THEN 1 ELSE 0 END WHEN s > u * (1 + sqrt(0.5::DOUBLE))
    THEN least(1, sqrt(greatest((y * y - 0.5 - 1) ** 2 - 4 * 0.5, 0)) / (y * y)) ELSE 0 END, 7) AS w FROM c
""")
def ref_shrink_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrinkage weights of singular values."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_tax") * 10).alias("sigma"))

    def run(columns: list[np.ndarray]) -> list[np.ndarray]:
        order, line, s, sigma = columns
        return [order, line, kernels.component_weights(s[:, None], sigma, 147.0, 0.5, "optshrink")[:, 0]]

    return numpy_rows(rows, run, "l_orderkey long, l_linenumber int, w double").withColumn("w", F.round("w", 7))


@query("""
WITH k AS (SELECT unnest(range(7)) AS t), o AS (SELECT DISTINCT l_orderkey AS v FROM lineitem),
s AS (SELECT o.v, k.t, coalesce(sum(l_extendedprice), 0.0) AS a, coalesce(sum(l_extendedprice * (1 - l_discount)), 0.0) AS b
    FROM o CROSS JOIN k LEFT JOIN lineitem l ON l.l_orderkey = o.v AND l.l_linenumber = k.t + 1 GROUP BY o.v, k.t),
r AS (SELECT sqrt(avg(b ** 2)) AS rms_b FROM s)
SELECT round(max(abs(a - b)), 3) AS max_abs, round(sqrt(sum((a - b) ** 2) / sum(b ** 2)), 8) AS rel_l2, round(sqrt(avg(a ** 2)), 2) AS rms, CAST(count_if(a < 0) AS BIGINT) AS negative,
    (SELECT count(*) FROM (SELECT v FROM s GROUP BY v HAVING max(abs(a)) = 0)) AS zero_voxels,
    arg_min(v, (-abs(a - b), v, t)) AS max_v, CAST(arg_min(t, (-abs(a - b), v, t)) AS INT) AS max_t, round(count_if(abs(a - b) > 0.05 * rms_b) / count(*), 6) AS over_share FROM s, r
""")
def ref_error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison of two series: an order's prices with and without discount, volumes being line numbers."""
    rows = table(spark, sf_dir, "lineitem")
    series = lambda value: rows.groupBy(F.lit("lineitem").alias("img"), F.col("l_orderkey").alias("v")).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("l_linenumber") == k, value)), F.lit(0.0)) for k in range(1, 8)]).alias("ts"))
    out = compare.compare(series(F.col("l_extendedprice")), series(F.col("l_extendedprice") * (1 - F.col("l_discount"))), threshold=0.05)
    return out.select(F.round("max_abs", 3).alias("max_abs"), F.round("rel_l2", 8).alias("rel_l2"), F.round("rms", 2).alias("rms"), "negative", "zero_voxels", "max_v", "max_t", F.round("over_share", 6).alias("over_share"))


@query("""
WITH s AS (SELECT l_orderkey AS v, l_extendedprice AS x FROM lineitem)
SELECT 'lineitem' AS img, round(quantile_cont(x, 0.995), 4) AS high, round(quantile_cont(x, 0.5), 4) AS middle FROM s
""")
def ref_display_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the samples for a display window."""
    voxels = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("img"), F.array("l_extendedprice").alias("ts"))
    level = lambda q: F.round(F.max(F.when(F.col("share") == q, F.col("level"))), 4)
    return quantiles(voxels, [0.995, 0.5]).groupBy("img").agg(level(0.995).alias("high"), level(0.5).alias("middle"))


@query("""
SELECT CAST(sum(len(list_filter(embedding, lambda e: e < 0))) AS BIGINT) AS n_negative, min(list_min(embedding)) < 0 AS signed,
    CAST(count_if(len(list_filter(embedding, lambda e: e <> 0)) > 0) AS BIGINT) AS live, CAST(sum(len(list_filter(embedding, lambda e: e = 0))) AS BIGINT) AS zeros FROM embeddings
""")
def ref_sample_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked of a series before a run: signed or not, live voxels, zero samples."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").agg(
        F.sum(F.size(F.filter(e, lambda x: x < 0))).alias("n_negative"), (F.min(F.array_min(e)) < 0).alias("signed"),
        F.count_if(lattice.live(e)).alias("live"), F.sum(F.size(F.filter(e, lambda x: x == 0))).alias("zeros"),
    )


@query("""
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), k AS (SELECT 2 * pi() / (hi - lo) AS slope, lo, hi FROM r)
SELECT event_id, round(value * slope - 0.5 * (lo + hi) * slope, 6) AS rad, round(cos(value * slope - 0.5 * (lo + hi) * slope), 6) + 0.0 AS re,
    round(sin(value * slope - 0.5 * (lo + hi) * slope), 6) + 0.0 AS im FROM events, k
""")
def ref_phase_radians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored phase to radians: the observed range is one turn."""
    rows = table(spark, sf_dir, "events")
    slope, inter = rotate.phase_scale("auto", *rows.agg(F.min("value"), F.max("value")).first())
    rad = rotate.radians(F.col("value"), slope, inter)
    return rows.select("event_id", F.round(rad, 6).alias("rad"), (F.round(F.cos(rad), 6) + 0.0).alias("re"), (F.round(F.sin(rad), 6) + 0.0).alias("im"))


@query("""
WITH m AS (SELECT event_type AS img, CAST(extract('month' FROM ts) AS INT) AS t, avg(abs(value)) AS m FROM events GROUP BY 1, 2)
SELECT img, coalesce(min(t) FILTER (WHERE m > 0.95 * top), 0) AS ref FROM (SELECT *, max(m) OVER (PARTITION BY img) AS top FROM m) GROUP BY img
""")
def ref_reference_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first volume (month) whose mean is above 0.95 of the largest, per image (event type)."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("img"), F.month("ts").alias("t"), "value")
    return rotate.reference_volume(rows)


@query("""
SELECT z, t, CAST(count(*) AS BIGINT) AS n, round(sum(e), 5) AS total, round(CAST(min(e) AS DOUBLE), 6) AS low
FROM (SELECT vec_id // 100 AS z, unnest(range(64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) GROUP BY z, t
""")
def ref_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxel series turned into slices per volume."""
    voxels, _ = embedding_voxels(spark, sf_dir)
    p = lattice.to_planes(voxels, NX, NY, 64)
    total = F.aggregate("px", F.lit(0.0), lambda a, x: a + x)
    return p.select(F.col("z").cast("long").alias("z"), F.col("t").cast("long").alias("t"), F.size("px").cast("long").alias("n"), F.round(total, 5).alias("total"), F.round(F.array_min("px").cast("double"), 6).alias("low"))


def _full_pairs(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Images of pairs of volumes with rows of zeros for places that have none."""
    images = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.concat(F.lit("pair"), k.cast("string")))
    every = voxels.sparkSession.range(dims[0] * dims[1] * dims[2]).select(F.explode(images).alias("img"), F.col("id").alias("v"))
    zeros = F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))
    return lattice.with_coordinates(every, NX, NY).join(voxels.select("img", "v", "ts"), ["img", "v"], "left").select("img", "v", "x", "y", "z", F.coalesce("ts", zeros).alias("ts"))


def _full_slices(voxels: DataFrame, dims: tuple[int, int, int], nvol: int = 64) -> DataFrame:
    """voxels with rows of zeros for places that have none."""
    n = dims[0] * dims[1] * dims[2]
    zeros = F.transform(F.sequence(F.lit(1), F.lit(nvol)), lambda i: F.lit(0.0).cast("float"))
    every = lattice.with_coordinates(voxels.sparkSession.range(n).select(F.lit("embeddings").alias("img"), F.col("id").alias("v")), NX, NY)
    return every.join(voxels.select("v", "ts"), "v", "left").select("img", "v", "x", "y", "z", F.coalesce("ts", zeros).alias("ts"))


#: Patches of two volumes: the 2 by 2 Gram matrix has a closed form, so SQL can check whole decompositions of each pair of volumes. K: 3 by 3 by 3 voxels.
_TWO = Geometry((10, 10, 5), 2, 3, "cube")
_PAIR = f"""{_PAIRS}, {_PAIR_CUBE.format(where="")},
s AS (SELECT n.img, centre, sum(y1 * y1) AS a, sum(y1 * y2) AS b, sum(y2 * y2) AS c FROM n JOIN v ON n.v = v.v AND n.img = v.img GROUP BY n.img, centre),
l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM s),
r AS (SELECT *, sqrt(l1) AS s1, sqrt(greatest(l2, 0)) AS s2, (sqrt(l1) + sqrt(greatest(l2, 0))) / 2 AS middle, b * b + (l1 - a) ** 2 AS u FROM l),
k AS (SELECT *, CAST(s1 >= {_TWO.omega!r}::DOUBLE * middle AS INT) AS k1, CAST(s2 >= {_TWO.omega!r}::DOUBLE * middle AS INT) AS k2, middle * {_TWO.sigma_scale!r}::DOUBLE AS sigma FROM r),
p AS (SELECT img, centre, k1 + k2 AS rank, sigma, CASE WHEN k2 = 1 THEN 1 WHEN k1 = 1 THEN b * b / u ELSE 0 END AS p11, CASE WHEN k2 = 1 THEN 0 WHEN k1 = 1 THEN b * (l1 - a) / u ELSE 0 END AS p12,
    CASE WHEN k2 = 1 THEN 1 WHEN k1 = 1 THEN (l1 - a) ** 2 / u ELSE 0 END AS p22 FROM k)"""
_HARD = DenoiseOptions(filter="optthresh", shape="cube")


def _rounded(name: str, t: int, places: int = 4):
    return (F.round(F.col(name)[t].cast("double"), places) + 0.0).alias(f"x{t + 1}")


@query(f"""
WITH {_PAIR} SELECT p.img, CAST((x - 2) // 4 AS INT) AS gx, CAST((y - 2) // 4 AS INT) AS gy, CAST((z - least(2, (nz - 1) // 2)) // 4 AS INT) AS gz, round(CAST(CAST(sigma AS FLOAT) AS DOUBLE), 5) AS sigma
FROM p JOIN v ON v.v = p.centre AND v.img = p.img, d WHERE x >= 2 AND (x - 2) % 4 = 0 AND y >= 2 AND (y - 2) % 4 = 0 AND z >= least(2, (nz - 1) // 2) AND (z - least(2, (nz - 1) // 2)) % 4 = 0
""")
def ref_noise_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise levels of patches of two volumes on the coarse grid, for each of the 32 pairs of volumes as an image of its own."""
    voxels, dims = pair_voxels(spark, sf_dir)
    out = patches.coarse_sigma(_full_pairs(voxels, dims), Geometry(dims, 2, 3, "cube"))
    return out.select("img", "gx", "gy", "gz", F.round("sigma", 5).alias("sigma"))


@query(f"""
WITH {_PAIR} SELECT v.img, v.v, round(CASE WHEN label < 5 THEN y1 * p11 + y2 * p12 ELSE 0 END, 4) + 0.0 AS x1, round(CASE WHEN label < 5 THEN y1 * p12 + y2 * p22 ELSE 0 END, 4) + 0.0 AS x2,
    CASE WHEN label < 5 THEN rank ELSE 0 END AS rank, round(CASE WHEN label < 5 THEN CAST(CAST(sigma AS FLOAT) AS DOUBLE) ELSE 0 END, 5) AS sigma FROM v JOIN p ON p.centre = v.v AND p.img = v.img
""")
def ref_denoise_exclusive_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard threshold of patches of two volumes, one patch per voxel, within the mask of labels below 5, for each pair of volumes."""
    voxels, dims = pair_voxels(spark, sf_dir)
    out = denoise(_full_pairs(voxels, dims), dims, options=replace(_HARD, aggregator="exclusive"), mask=voxels.where("label < 5").select("img", "v")).voxels
    return out.join(voxels.select("img", "v"), ["img", "v"], "left_semi").select("img", "v", _rounded("ts", 0), _rounded("ts", 1), "rank", F.round("sigma", 5).alias("sigma"))


@query(f"""
WITH {_PAIR}, w AS (SELECT v.img, v.v, y1 * p11 + y2 * p12 AS x1, y1 * p12 + y2 * p22 AS x2, rank, sigma, exp(-4 * ln(2) / 16 * ((v.x - n.x) ** 2 + (v.y - n.y) ** 2 + (v.z - n.z) ** 2)) AS w
    FROM n JOIN p ON n.centre = p.centre AND n.img = p.img JOIN v ON v.v = n.v AND v.img = n.img WHERE n.x % 2 = 0 AND n.y % 2 = 0 AND n.z % 2 = 0)
SELECT img, v, round(sum(w * x1) / sum(w), 4) + 0.0 AS x1, round(sum(w * x2) / sum(w), 4) + 0.0 AS x2, CAST(floor(sum(w * rank) / sum(w) + 0.5) AS INT) AS rank, round(sum(w * sigma) / sum(w), 6) AS sigma FROM w GROUP BY img, v
""")
def ref_denoise_averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard threshold of patches of two volumes, averaged by Gaussian weights over centres at stride 2, for each pair of volumes."""
    voxels, dims = pair_voxels(spark, sf_dir)
    out = denoise(_full_pairs(voxels, dims), dims, options=_HARD).voxels.join(voxels.select("img", "v"), ["img", "v"], "left_semi")
    return out.select("img", "v", _rounded("ts", 0), _rounded("ts", 1), "rank", F.round("sigma", 6).alias("sigma"))


@query(f"""
WITH {_PAIRS}, {_PAIR_CUBE.format(where="")},
s AS (SELECT n.img, centre, sum(y1 * y1) AS a, sum(y1 * y2) AS b, sum(y2 * y2) AS c FROM n JOIN v ON n.v = v.v AND n.img = v.img GROUP BY n.img, centre),
l AS (SELECT *, ((a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b)) / 27 AS l1, greatest((a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b), 0) / 27 AS l2 FROM s),
e AS (SELECT *, l1 - l2 <= 4 * sqrt(2.0::DOUBLE / 27) * (l1 + l2) / 2 AS noise FROM l)
SELECT img, centre, CASE WHEN noise THEN 0 ELSE 1 END AS rank, round(sqrt(CASE WHEN noise THEN (l1 + l2) / 2 ELSE l2 END), 6) + 0.0 AS sigma FROM e
""")
def ref_edge_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise level and rank of every voxel's patch, found together from where its eigenvalues spread too wide for noise."""
    voxels, dims = pair_voxels(spark, sf_dir)
    g = Geometry(dims, 2, 3, "cube")

    def run(block, coords, here, table):
        d = kernels.decompose(block.data[block.rows(coords[here])], g, "mppca")
        return pa.table({"img": table.column("img").filter(pa.array(here)), "centre": table.column("v").to_numpy()[here], "rank": d.rank.astype(np.int32), "sigma": np.round(d.sigma, 6) + 0.0})

    return _centres(voxels, dims, g, run, "img string, centre long, rank int, sigma double")


@query("""
WITH f AS (SELECT vec_id AS v, embedding AS m, list_reverse(embedding) AS ph FROM embeddings),
g AS (SELECT min(list_min(ph)) AS lo, max(list_max(ph)) AS hi FROM f), k AS (SELECT 2 * pi() / (CAST(hi AS DOUBLE) - lo) AS slope, lo, hi FROM g),
s AS (SELECT v, t, CAST(m[t + 1] AS DOUBLE) AS m, ph[t + 1] * slope - 0.5 * (CAST(lo AS DOUBLE) + hi) * slope AS rad FROM f, k, (SELECT unnest(range(64)) AS t)),
a AS (SELECT t, avg(abs(m)) AS m FROM s GROUP BY t), r AS (SELECT coalesce(min(t) FILTER (WHERE m > 0.95 * top), 0) AS ref FROM (SELECT *, max(m) OVER () AS top FROM a)),
c AS (SELECT v, CASE WHEN m <> 0 THEN cos(rad) ELSE 1 END AS rc, CASE WHEN m <> 0 THEN -sin(rad) ELSE 0 END AS rs FROM s, r WHERE t = ref),
z AS (SELECT s.v, t, abs(m) * (cos(rad) * rc - sin(rad) * rs) AS re, abs(m) * (cos(rad) * rs + sin(rad) * rc) AS im FROM s JOIN c ON c.v = s.v),
w AS (SELECT unnest(range(-3, 4)) AS k, unnest([1, 6, 15, 20, 15, 6, 1]) / 64.0::DOUBLE AS w),
h AS (SELECT v // 100 AS z, v // 10 % 10 AS y, (v % 10 + k + 10) % 10 AS x, t, sum(w * re) AS re, sum(w * im) AS im FROM z, w GROUP BY 1, 2, 3, 4),
i AS (SELECT z * 100 + (y + k + 10) % 10 * 10 + x AS v, t, sum(w * re) AS sre, sum(w * im) AS sim FROM h, w GROUP BY 1, 2)
SELECT z.v, CAST(z.t AS INT) AS t, round((re * sre + im * sim) / sqrt(sre ** 2 + sim ** 2), 2) + 0.0 AS value FROM z JOIN i ON i.v = z.v AND i.t = z.t
""")
def ref_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude with its phase (the series backwards, its range one turn) to a signed real series."""
    voxels, _ = embedding_voxels(spark, sf_dir)
    voxels = voxels.drop("label")
    out = rotate.rotate_to_real(voxels, voxels.withColumn("ts", F.reverse("ts")), NX, NY)
    return out.select("v", F.posexplode("ts").alias("t", "value")).withColumn("value", F.round(F.col("value").cast("double"), 2) + 0.0)


@query()
def ref_denoise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default pipeline over the embeddings: noise map, shrinkage, averaged patches."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    return denoise(_full_slices(voxels, dims), dims).voxels.select("v", "ts", "sigma", "rank")


@query("""
SELECT vec_id AS v, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE))), 4) + 0.0 AS total, round(CAST(embedding[64] AS DOUBLE), 6) + 0.0 AS last FROM embeddings
""")
def ref_nifti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written as a NIfTI image to the shared folder and read back, slab by slab."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    path = nifti.local_scratch(spark, "image") + ".nii"
    nifti.write_nifti(_full_slices(voxels, dims), path, nifti.Header([*dims, 64], [1.0] * 8))
    total = F.aggregate("ts", F.lit(0.0), lambda a, x: a + x)
    out = nifti.read_nifti(spark, path).join(voxels.select("v"), "v", "left_semi")  # slices that are not full have been filled with zeros
    return out.select("v", F.size("ts").alias("n"), (F.round(total, 4) + 0.0).alias("total"), (F.round(F.col("ts")[63].cast("double"), 6) + 0.0).alias("last"))


@query("""
WITH s AS (SELECT CAST(vec_id // 100 AS INT) AS z, CAST(t AS INT) AS t, vec_id % 100 AS p, CAST(embedding[t + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS t))
SELECT z, t, round(sum(x), 4) + 0.0 AS total, round(sum(p * x), 3) + 0.0 AS moment FROM s WHERE 50 * t >= 1000 AND z >= 1 GROUP BY z, t
""")
def ref_volume_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of volumes of high b-value from the second slice on, of a packed image: the reader seeks only these."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    path = nifti.local_scratch(spark, "image") + ".nii.gz"
    nifti.write_nifti(_full_slices(voxels, dims), path, nifti.Header([*dims, 64], [1.0] * 8))
    planes = nifti.read_nifti(spark, path, "planes").where(F.col("t").isin(shells.volumes_from([50.0 * t for t in range(64)], 1000)) & (F.col("z") >= 1))
    sums = F.aggregate("px", F.lit(0.0), lambda a, x: a + x), F.aggregate(F.transform("px", lambda x, k: k * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return planes.select("z", "t", (F.round(sums[0], 4) + 0.0).alias("total"), (F.round(sums[1], 3) + 0.0).alias("moment"))


@query("""
WITH d AS (SELECT CAST(max(vec_id) // 100 + 1 AS INT) AS nz FROM embeddings), s AS (SELECT vec_id, unnest(range(64)) AS t, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
k AS (SELECT 'first/a' AS img, vec_id, x FROM s WHERE t < 8 UNION ALL SELECT 'first/b', vec_id, trunc(1000 * x) FROM s WHERE t >= 8 AND t < 20 UNION ALL SELECT 'second/a', vec_id, x FROM s WHERE t >= 20)
SELECT img, 10 AS nx, 10 AS ny, nz, CAST(count(*) // (SELECT count(*) FROM embeddings) AS INT) AS nvol, any_value(CASE img WHEN 'first/a' THEN 16 WHEN 'first/b' THEN 8 ELSE 64 END) AS datatype,
    round(sum(x), 3) + 0.0 AS total, round(sum(vec_id * x), 1) + 0.0 AS moment FROM k, d GROUP BY img, nz
""")
def ref_image_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three images of other sample types and sizes, one of them packed, written below one folder: all read at once, with their headers as a table."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    top, full = nifti.local_scratch(spark, "images"), _full_slices(voxels, dims)
    parts = {"first/a.nii": (0, 8, 16), "first/b.nii.gz": (8, 12, 8), "second/a.nii": (20, 44, 64)}
    for name, (first, n, kind) in parts.items():
        os.makedirs(os.path.dirname(f"{top}/{name}"), exist_ok=True)
        ts = F.slice("ts", first + 1, n)
        nifti.write_nifti(full.withColumn("ts", F.transform(ts, lambda x: 1000 * x) if kind == 8 else ts), f"{top}/{name}", nifti.Header([*dims, n], [1.0] * 8), kind)
    where = [f"{top}/first", f"{top}/second"]
    rows = nifti.read_nifti(spark, where).join(voxels.select("v"), "v", "left_semi")
    own = F.aggregate(F.transform("ts", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    sums = rows.groupBy("img").agg((F.round(F.sum(own), 3) + 0.0).alias("total"), (F.round(F.sum(F.col("v") * own), 1) + 0.0).alias("moment"))
    return nifti.read_headers(spark, where).select("img", "nx", "ny", "nz", "nvol", "datatype").join(sums, "img")


@query()
def ref_unring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ringing removed from every slice of the embeddings."""
    voxels, dims = embedding_voxels(spark, sf_dir)
    planes = lattice.to_planes(_full_slices(voxels, dims), NX, NY, 64)
    return unring.unring(planes, NX, NY).select("z", "t", "px")
