"""Centroid clustering of integer vectors, with distances spared by group bounds.

Lloyd's rounds in whole numbers. Centroids are put into groups once. Each vector carries an upper bound of the distance to
its own centroid and one lower bound for each group, which are loosened by how far centroids have moved. A vector whose upper
bound is under all its lower bounds stays (global filter); else groups whose bound is not above it are looked at (group
filter), and their centroids are compared exactly. Bounds are rounded outwards and only a strictly greater distance is pruned,
so ties are seen and the result is that of plain rounds.

Vectors and bounds lie in a written table that each round reads and writes anew, without a shuffle; tasks sum their vectors
by cluster, and Spark adds k sums a task. Only centroids, k by d numbers, go through the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components must be under this in size, so that squared distances over 64 of them fit into a long.
MOST = 1 << 27
#: Pairs of a vector and a centroid that are compared at a time; how far bounds are rounded outwards.
PAIRS, SLACK = 20_000, 1e-9


def squared(x: np.ndarray, centroids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact squared distances of the vectors `rows` to the centroids `cols`, pair by pair."""
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), PAIRS):
        diff = x[rows[at : at + PAIRS]] - centroids[cols[at : at + PAIRS]]
        out[at : at + PAIRS] = np.einsum("ij,ij->i", diff, diff)
    return out


def grouped(centroids: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A group number for each centroid: plain rounds over the centroids themselves, from n evenly spread ones."""
    middle = centroids[np.linspace(0, len(centroids) - 1, n).astype(int)].astype(float)
    for _ in range(rounds):
        own = np.array([((middle - c) ** 2).sum(1).argmin() for c in centroids])
        middle = np.stack([centroids[own == g].mean(0) if (own == g).any() else middle[g] for g in range(n)])
    return np.unique(own, return_inverse=True)[1]


class Bounded:
    """Clusters of vectors with their bounds; `compared` counts exact distances."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.x, self.cluster, self.upper, self.lower, self.compared = x, cluster, upper, lower, 0

    def _exact(self, centroids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        self.compared += len(rows)
        return squared(self.x, centroids, rows, cols)

    def loosen(self, moved: np.ndarray, groups: np.ndarray) -> None:
        drift = np.array([moved[groups == g].max() for g in range(self.lower.shape[1])])
        slack = SLACK * (np.where(np.isfinite(self.lower), self.lower, 0) + drift)
        self.lower = np.maximum(self.lower - drift - slack, 0)
        self.upper = (self.upper + moved[self.cluster]) * (1 + SLACK)

    def assign(self, centroids: np.ndarray, groups: np.ndarray) -> None:
        n = len(self.x)
        if self.cluster is None:  # nothing is known: centroid 0 for now, all groups are looked at
            self.cluster, self.upper, self.lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, groups.max() + 1))
        before, best = self.cluster, np.zeros(n, np.int64)
        unsure = np.flatnonzero(self.upper >= self.lower.min(1))
        best[unsure] = self._exact(centroids, unsure, before[unsure])
        self.upper[unsure] = np.sqrt(best[unsure]) * (1 + SLACK)
        look = np.zeros(self.lower.shape, bool)
        look[unsure] = self.upper[unsure, None] >= self.lower[unsure]
        self.lower[look] = np.inf
        found, first, seen = before.copy(), best.copy(), []
        for c in range(len(centroids)):
            rows = np.flatnonzero(look[:, groups[c]] & (before != c))
            d = self._exact(centroids, rows, np.full(len(rows), c))
            better = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
            best[rows[better]], found[rows[better]] = d[better], c
            seen.append((c, rows, d))
        left = np.flatnonzero(found != before)
        for c, rows, d in [*seen, (None, left, first[left])]:  # what was compared and is not a vector's own bounds its group
            other = found[rows] != (-1 if c is None else c)
            rows, group = rows[other], groups[before[rows[other]]] if c is None else groups[c]
            self.lower[rows, group] = np.minimum(self.lower[rows, group], np.sqrt(d[other]) * (1 - SLACK))
        self.cluster = found
        self.upper[unsure] = np.sqrt(best[unsure]) * (1 + SLACK)


STATE = "id long, x array<int>, cluster int, upper double, lower array<double>"


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _round(table: DataFrame, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The table's vectors assigned to centroids; moved: how far each has gone since the table's bounds held, None for a table without."""
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1), d)
            if moved is None:
                own = Bounded(x)
            else:
                own = Bounded(x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().copy(), b.column(4).flatten().to_numpy().reshape(len(x), -1).copy())
                own.loosen(moved, groups)
            own.assign(centroids, groups)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.cluster.astype(np.int32)), pa.array(own.upper), _lists(own.lower)], names=["id", "x", "cluster", "upper", "lower"])

    return table.mapInArrow(run, STATE)


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster's vectors; clusters without any keep their centroid."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 1), np.int64)  # the last number of a cluster counts its vectors
        for b in batches:
            x, own = _vectors(b.column(0), d), b.column(1).to_numpy()
            for c in np.unique(own):
                total[c] += np.r_[x[own == c].sum(0), (own == c).sum()]
        used = np.flatnonzero(total[:, d])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), _lists(total[used])], names=["cluster", "sums"])

    parts = table.select("x", "cluster").mapInArrow(run, "cluster int, sums array<bigint>")
    sums = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect()
    by = {(r.cluster, r.pos): r.s for r in sums}
    return np.array([[by[c, j] // by[c, d] for j in range(d)] if (c, d) in by else centroids[c] for c in range(k)], np.int64)


def cluster(vectors: DataFrame, start: np.ndarray, rounds: int, n_groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of each of the vectors (id, x array<int>), and the centroids (k by d) that they were assigned to last.

    Each round assigns every vector to its nearest centroid (squared distance; ties: the smaller number) and replaces each
    non-empty centroid by its vectors' componentwise floor of the mean; then vectors are assigned once more. One group of
    about ten centroids unless told otherwise. Repeated rows count each; null ids stay. k and d are bounded by what fits into a task."""
    now = np.asarray(start, np.int64)
    groups = grouped(now, n_groups or -(-len(now) // 10))
    table, moved = vectors, None
    for _ in range(rounds):
        table = cut(_round(table, now, groups, moved))
        new = _means(table, now)
        moved, now = np.sqrt(((new - now) ** 2).sum(1)) * (1 + SLACK), new
    last, d = _round(table, now, groups, moved), now.shape[1]

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_numpy()
            found = squared(_vectors(b.column(1), d), now, np.arange(len(own)), own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found)], names=["id", "cluster", "distance"])

    return last.mapInArrow(distances, "id long, cluster int, distance long"), now


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as int; an error where squared distances might not fit into a long."""
    number = lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))
    fits = F.forall(vector, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < MOST - 1)
    return F.when(fits, F.transform(vector, number).cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for exact squared distances")).cast("array<int>"))


def usable(vector: Column, d: int) -> Column:
    """Whether a vector has d components, none of them null or not finite."""
    return F.coalesce((F.size(vector) == d) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def first_by_hash(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:id`, in that order; vectors without an id last, equal hashes by their components."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r.x for r in vectors.orderBy(rank.asc_nulls_last(), "x").limit(k).collect()], np.int64)


K, DIMENSIONS, SCALE, ROUNDS = 16, 64, 64, 3


def clustered(embeddings: DataFrame, k: int = K, dimensions: int = DIMENSIONS, scale: int = SCALE, rounds: int = ROUNDS, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector: its id, cluster, squared distance, the distance summed over its cluster and over all, and the centroid's hash.

    Vectors that are null, of another length, or hold nulls or numbers that are not finite are left out. Fewer vectors than k
    give as many centroids; a table without usable vectors gives none. Repeated rows count each, null ids stay null and begin no
    cluster before others. NaN and infinity are left out, components of 2^27 / scale or more are an error."""
    vector = F.col(vector_col)
    kept = embeddings.where(usable(vector, dimensions)).select(F.col(id_col).cast("long").alias("id"), whole_numbers(vector, scale).alias("x"))
    start = first_by_hash(kept, k, seed)
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(start):
        return embeddings.sparkSession.createDataFrame([], schema)
    found, centroids = cluster(kept, start, rounds)
    rows = cut(found)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k numbers
    table = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = embeddings.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Per vector: its cluster of 16, its distance, and what its cluster and all clusters sum to."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Each round spelled out: a cross product with 16 centroids, the smallest (distance, number), floors of means."""
    near = """
a{n} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT k.row, k.vec_id, k.v, m{n}.c, list_sum(list_transform(list_zip(k.v, m{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, m{n}) GROUP BY row)"""
    mean = """
m{n} AS (SELECT m.c, coalesce(w.v, m.v) AS v FROM m{o} m LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (
    SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{o}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY c) w ON m.c = w.c)"""
    steps = [near.format(n=0)]
    for n in range(1, ROUNDS + 1):
        steps += [mean.format(n=n, o=n - 1), near.format(n=n)]
    return f"""
WITH k AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM (SELECT * FROM k ORDER BY sha256('1:' || vec_id), v LIMIT {K})),
{",".join(steps)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN m{ROUNDS} m ON m.c = best.c"""


OP13_SQL = _sql()
