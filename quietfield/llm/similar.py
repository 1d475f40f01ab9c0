"""Near copies by the Jaccard similarity of their shingle sets, every accepted pair checked exactly.

The Gray-order index alone cannot serve a similarity of 0.8: the SimHashes of such pairs differ in 10 bits on average
and up to 20, where its upper levels prune nothing. So its top nodes are buckets: documents that agree in one of `bands`
bands of `rows` MinHash values share a node, a pair at 0.8 with a probability of 1 - (1 - 0.8**4)**16 = 0.9998. Below,
a Gray-order index of the node's 64-bit SimHashes finds the candidates within `radius`, and candidates of different
classes are compared by their whole shingle sets; those of a class are joined already, so skipping them loses no class.

A bucket of more than `limit` documents is dealt over parts by a hash, its smallest id going to every part.
Afterwards what is not in the bucket's largest class goes to all of its parts and the class's members to one
each, so every pair that is not joined yet still meets. Rows then grow with the product of parts and documents
that stay outside, and are few where a group is alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_places, cut, placeable, with_groups, with_places, without_places
from .components import connected_components
from .simhash import SEED, GrayIndex, gray_rank, shingles, simhash_of

WIDTH, SIMILARITY, RADIUS, BANDS, ROWS, LIMIT = 5, 0.8, 24, 16, 4, 1000
_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_CHUNK = 4096


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band from a set of shingle hashes; keys of different bands differ."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _CHUNK):
        x = own[at : at + _CHUNK] * _MUL[:, None] + _ADD[:, None]
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes(), SEED)


def joined(sets: list[np.ndarray], fps: np.ndarray, label: np.ndarray, similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places (i, j) that join the classes of label over all pairs of sets that are similar enough."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    start = np.r_[0, np.cumsum(size)]
    label, links, marked = np.unique(label, return_inverse=True)[1], [], np.zeros(len(flat) + 1, bool)

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9]
        if not len(others) or not size[i]:  # empty sets are alike
            return others
        marked[flat[start[i] : start[i + 1]]] = True
        shared = np.array([np.count_nonzero(marked[flat[start[j] : start[j + 1]]]) for j in others.tolist()])
        marked[flat[start[i] : start[i + 1]]] = False
        return others[shared >= similarity * (size[others] + size[i] - shared) - 1e-9]

    order = np.argsort(gray_rank(fps), kind="stable")
    for query, entry in GrayIndex(fps[order]).search(fps, radius, block=256):
        other = order[entry]
        keep = other < query
        query, other = query[keep], other[keep]
        cuts = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, near = int(query[a]), np.sort(other[a:z])
            first = near[np.unique(label[near], return_index=True)[1]]
            for others in (first, near):  # one of each class first, then all that are still apart
                for j in alike(i, others[label[others] != label[i]]).tolist():
                    if label[i] != label[j]:
                        links.append((i, j))
                        label[label == label[i]] = label[j]
    return links


def _described(docs: DataFrame, width: int) -> DataFrame:
    """(_id, _file, _row, digest, fp, keys) for each row of (t, _id, _file, _row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                own = np.unique(shingles(t or b"", width))
                out.append((digest(own), band_keys(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["_id", "_file", "_row", "digest", "keys"])

    return docs.mapInArrow(run, "_id long, _file string, _row long, digest binary, keys array<long>")


def _links(texts: DataFrame, members: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    """Edges (u, v) found inside the parts of members: (key, part, label, node). texts: (node, t) of all members."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "part", "label", "node", "fp", "own"]
        types = [pa.int64()] * 5 + [pa.binary()]
        for b in batches:
            rows, held = [], 0
            for node, t, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = np.unique(shingles(t or b"", width))  # each shingle once, as similarity is of sets
                fp, packed = int(np.uint64(simhash_of(found)).view(np.int64)), found.tobytes()
                for p in places:
                    rows.append((p["key"], p["part"], p["label"], node, fp, packed))
                    held += len(packed)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def linked() -> pa.RecordBatch:
            own = [np.frombuffer(r[4], np.uint64) for r in held]
            fps = np.array([r[3] for r in held], np.int64).view(np.uint64)
            found = joined(own, fps, np.array([r[1] for r in held], np.int64), similarity, radius)
            u, v = ([held[x[k]][2] for x in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            for key, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, r[0]) != at:
                    if len(held) > 1:
                        yield linked()
                    held, at = [], (key, r[0])
                held.append(r)
        if len(held) > 1:
            yield linked()

    places = members.groupBy("node").agg(F.collect_list(F.struct("key", "part", "label")).alias("places"))
    dealt = texts.join(places.hint("shuffle_hash"), "node").select("node", "t", "places").mapInArrow(sets, "key long, part long, label long, node long, fp long, own binary")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(compare, "u long, v long").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(id, component_id, kept, _file, _row) for each row of docs: the smallest id of its class of texts linked at the similarity or more.

    Rows are told apart by their place, so rows of one id or without an id share a class only if their texts link. The row with
    the smallest id of a class is kept, the first by place of equal ids, a null id last. Texts of fewer than `width` words are one
    shingle; texts without words are alike, null included. Texts are read whole. An empty table gives none."""
    docs = placeable(docs)
    text = docs[text_col].cast("string").alias("t")
    rows = _described(with_places(docs, text, docs[id_col].cast("long").alias("_id")), width)
    rows = cut(rows.withColumn("_n", F.monotonically_increasing_id()))
    nodes = cut(rows.groupBy("digest").agg(F.min(F.struct("_n", "_file", "_row")).alias("at"), F.first("keys").alias("keys")).select(F.col("at._n").alias("node"), "at._file", "at._row", "digest", "keys"))
    sent = nodes.select("node", F.explode("keys").alias("key"))
    full = sent.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(limit))
    shared = cut(with_groups(sent, full, "key", ["node"]).where("n > 1").withColumn("parts", parts))
    own = F.pmod(F.xxhash64("node", "key"), F.col("parts"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    placed = lambda lone: F.explode(F.when(lone, everywhere).otherwise(F.array(own))).alias("part")
    wanted = cut(nodes.select("node", "_file", "_row").join(shared.select("node").distinct().hint("merge"), "node", "left_semi"))
    texts = cut(at_places(with_places(docs, text), wanted).select("node", "t"))  # of candidates alone
    members = shared.select("key", placed(F.col("node") == F.col("head")), F.col("node").alias("label"), "node")
    links = cut(_links(texts, members, width, similarity, radius))
    found = cut(connected_components(links))
    hot = shared.where("parts > 1")
    if hot.limit(1).count():
        known = hot.join(found.distinct().hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node"))
        sizes = known.groupBy("key", "label").count()
        main = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        known = with_groups(known, main, "key", ["node"])
        apart = known.where("label <> main").select("key").distinct()
        known = cut(with_groups(known, apart.withColumn("open", F.lit(True)), "key", ["node"]).where("open"))
        if known.limit(1).count():
            again = known.select("key", placed(F.col("label") != F.col("main")), "label", "node")
            links = links.unionByName(_links(texts, again, width, similarity, radius))
            found = cut(connected_components(links))
    classes = cut(nodes.join(found.withColumnRenamed("component", "root").hint("merge"), "node", "left").select("digest", F.coalesce("root", "node").alias("root")))
    placed_rows = cut(with_groups(rows.select("_id", "_file", "_row", "_n", "digest"), classes, "digest", ["_n"]))
    keeper = placed_rows.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_file", "_row")).alias("keeper"))
    out = with_groups(placed_rows, keeper, "root", ["_n"])
    kept = (F.col("_file") == F.col("keeper._file")) & (F.col("_row") == F.col("keeper._row"))
    return out.select(F.col("_id").alias(id_col), F.col("keeper._id").alias("component_id"), kept.alias("kept"), "_file", "_row")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that similar_documents keeps, with all their columns."""
    docs = placeable(docs)
    return without_places(docs, cut(similar_documents(docs, id_col, text_col, **options).where("not kept").select("_file", "_row")))
