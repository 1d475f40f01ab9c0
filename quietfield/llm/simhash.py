"""SimHash fingerprints and near-duplicate classes through a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes over shingles of `width` words, 3 by default. Two fingerprints link at `radius` or fewer
differing bits, and documents reachable over links form a class.

The index. Distinct fingerprints are sorted by their rank in the reflected Gray code and cut into ranges of
consecutive ranks, one for each task. A range is a node: the bits that all its fingerprints share, and their values.
Groups of nodes are factored into upper nodes, which keep the bits that all of a group share; a node keeps only what
its upper node does not hold already. Neighbours in Gray order differ in few bits, so nodes share long patterns.

The search. A fingerprint walks down from the top and adds up its differences to the patterns of the nodes on its way;
a whole group is dropped once they exceed the radius. The upper levels, a few numbers for each range, are sent to all
tasks and name the ranges that a fingerprint may link into; it is shuffled to those alone, and goes down the levels
below there. With ranges that share b leading bits that is about 1 + b + b(b-1)/2 of 2**b ranges at a radius of 2, so
the work grows with the square of the logarithm of the corpus. Every pair is met once, in the later range. Equal
fingerprints are merged first, so a group of copies is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, with_groups
from .components import connected_components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
SEED = 42


def shingles(text: bytes, width: int = 3) -> np.ndarray:
    """Hashes of a UTF-8 text's shingles with repeats: A-Z lower-cased, ASCII white space splits words. Fewer words than width are one shingle."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    """Each bit's majority over the hashes; 0 without any."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a UTF-8 text's shingles."""
    return simhash_of(shingles(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp: long with the fingerprint's 64 bits) for each row. Null text counts as empty: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", width) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"{id_col} long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def gray_order(fp: Column) -> Column:
    """A long that sorts fingerprints (as longs) by Gray rank."""
    step = lambda s: lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, s))
    for s in (1, 2, 4, 8, 16, 32):
        fp = let(fp, step(s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Hierarchy over entries in Gray order. An entry is a pattern of shared bits: a fingerprint shares all 64 with itself."""

    def __init__(self, low: np.ndarray, high: np.ndarray | None = None, fanout: int = 8):
        """low, high: bitwise AND and OR of what each entry holds; for fingerprints, themselves."""
        self.fanout, high = fanout, low if high is None else high
        nodes = [(~(low ^ high), low)]
        while len(low) > fanout:
            at = np.arange(0, len(low), fanout)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            nodes.append((~(low ^ high), low))
        self.levels = []  # from the entries up: (bits that a node adds to its upper node's, its pattern)
        for k, (mask, pattern) in enumerate(nodes):
            above = np.repeat(nodes[k + 1][0], fanout)[: len(mask)] if k + 1 < len(nodes) else np.uint64(0)
            self.levels.append((mask & ~above, pattern))
        self.visited = 0

    def search(self, fps: np.ndarray, radius: int, after: np.ndarray | None = None, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in fps, entries) whose differences add up to the radius at most, a block of fps at a time.

        after: for each fp the entry up to which nothing is asked for."""
        for a in range(0, len(fps), block):
            own = fps[a : a + block]
            width = len(self.levels[-1][0])
            query, node, gone = np.repeat(np.arange(len(own)), width), np.tile(np.arange(width), len(own)), np.zeros(len(own) * width, np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                bits, pattern = self.levels[k]
                self.visited += len(query)
                gone = gone + np.bitwise_count((own[query] ^ pattern[node]) & bits[node])
                keep = gone <= radius
                if after is not None:
                    keep &= (node + 1) * self.fanout**k - 1 > after[a + query]
                query, node, gone = query[keep], node[keep], gone[keep]
                if k:
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    query, gone = np.repeat(query, self.fanout), np.repeat(gone, self.fanout)
                    keep = node < len(self.levels[k - 1][0])
                    query, node, gone = query[keep], node[keep], gone[keep]
            yield a + query, node


class Forest:
    """Roots of n places that pairs join; a root is the smallest place of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            high, low = np.maximum(x, y), np.minimum(x, y)
            keep = high != low
            a, b, high, low = a[keep], b[keep], high[keep], low[keep]
            np.minimum.at(root, high, low)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        self.root = root


def gray_ranges(nodes: DataFrame, ranges: int = 64, limit: int = 1 << 20) -> tuple[DataFrame, int]:
    """nodes (fp, distinct) as a written table with its `range` of consecutive Gray ranks, and the number of ranges.

    There are `ranges` of them, or more where one would hold over `limit` fingerprints."""
    count = max(ranges, -(-nodes.count() // limit))
    return cut(nodes.repartitionByRange(count, gray_order(F.col("fp"))).withColumn("range", F.spark_partition_id())), count


def fingerprint_links(nodes: DataFrame, radius: int = 2, **sizes: int) -> DataFrame:
    """Edges (u, v) of fingerprints (long) within the radius, enough of them to join every linked class.

    nodes: a written table of distinct fp. A range's task returns a spanning forest of its own links, and for each
    fingerprint sent to it one link to the range's forest, which is joined where the fingerprint links several trees."""
    table, _ = gray_ranges(nodes.select("fp"), **sizes)
    upper = sorted(table.groupBy("range").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high")).collect())  # one row for each range
    number = np.array([r.range for r in upper], np.int64)
    ends = [np.array([r[k] for r in upper], np.int64).view(np.uint64) for k in (1, 2)]
    top = GrayIndex(*ends) if upper else None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, fps = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            place = np.searchsorted(number, own)
            for q, entry in top.search(fps.view(np.uint64), radius, after=place - 1):
                foreign = entry != place[q]
                yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(foreign), pa.array(fps[q])], names=["at", "foreign", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        at, held, fps, index, forest = None, [], None, None, None

        def built() -> None:
            nonlocal fps, index, forest
            fps = np.concatenate(held)
            fps = fps[np.argsort(gray_rank(fps), kind="stable")]
            index, forest = GrayIndex(fps), Forest(len(fps))
            for q, entry in index.search(fps, radius, after=np.arange(len(fps))):
                forest.join(q, entry)

        def own_links() -> Iterator[pa.RecordBatch]:
            if held:
                if index is None:
                    built()
                moved = np.flatnonzero(forest.root != np.arange(len(fps)))
                yield edges(fps[moved], fps[forest.root[moved]])

        for b in batches:
            where, foreign, sent = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sent = sent.view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (foreign[1:] != foreign[:-1]), True])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if where[a] != at:
                    yield from own_links()
                    at, held, index = where[a], [], None
                if not foreign[a]:
                    held.append(sent[a:z])
                    continue
                if index is None:
                    built()
                for q, entry in index.search(sent[a:z], radius):
                    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)]) if len(q) else np.zeros(0, np.int64)
                    forest.join(np.repeat(entry[first], np.diff(np.r_[first, len(q)])), entry)
                    yield edges(sent[a:z][q[first]], fps[entry[first]])
        yield from own_links()

    if top is None:
        return table.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    sent = table.select(F.col("range").cast("long"), "fp").mapInArrow(route, "at long, foreign boolean, fp long")
    return sent.repartitionById(len(upper), F.col("at").cast("int")).sortWithinPartitions("at", "foreign").mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row: its fingerprint and the smallest id of its class.

    A null id takes part as the id -2**63 and is returned as null; the id of its class is then null. Repeated rows share
    one class, and so do rows of one id only if their texts link. Ties need no rule, as the smallest id is one value.
    Empty and null texts have fingerprint 0 and link like any other; a text is read whole, however long. An empty table
    gives an empty result. Other columns are not read."""
    least = -(1 << 63)
    rows = fingerprints(docs.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(least))), "_id", text_col, width)
    rows = cut(rows.withColumn("_n", F.monotonically_increasing_id()))
    nodes = cut(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    found = connected_components(fingerprint_links(nodes, radius)).withColumnRenamed("node", "fp")
    linked = nodes.join(found, "fp")
    classes = cut(linked.groupBy("component").agg(F.min("least").alias("class_id")).join(found, "component").select("fp", "class_id"))
    known = nodes.join(classes, "fp", "left").select("fp", F.coalesce("class_id", "least").alias("component_id"))
    null = lambda c: F.when(F.col(c) == least, None).otherwise(F.col(c))
    return with_groups(rows, known, "fp", ["_n"]).select(null("_id").alias(id_col), "fp", null("component_id").alias("component_id"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint in hex and the smallest doc_id that its links reach."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
