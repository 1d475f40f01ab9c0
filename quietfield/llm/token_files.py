"""Token ids on disk: every document its own zstandard frame, all frames with one trained dictionary.

A set of shards holds documents in ascending doc_id order. A shard is

    magic | frame ... frame | index | footer

with the index a zstandard frame of int64 doc_ids, uint32 frame lengths and uint32 token counts, and the
footer the index's offset and length, the number of documents, the SHA-256 of the dictionary and the magic.
The dictionary lies beside the shards. One short document is read by two seeks: index, then frame."""

from __future__ import annotations

import hashlib
import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from . import files
from .common import cut, scratch_path
from .encoding import encoder

MAGIC = b"QFTOKEN1"
FOOTER = struct.Struct("<QQQ32s8s")
DICTIONARY = "ids.zdict"
NULL_ID = -(1 << 63)
#: Documents, bytes of ids of each, and size of what the dictionary is trained on.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 8 << 10, 64 << 10
#: So many shards at most, however large the corpus.
MAX_SHARDS = 10_000
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for serialized id arrays; the samples' own bytes, with a warning, where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError) as e:
        warnings.warn(f"no dictionary could be trained on {len(samples)} samples ({e}); their bytes are used", RuntimeWarning, stacklevel=2)
        return b"".join(samples)[:size]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Shard:
    """Random access to one shard."""

    def __init__(self, path: str, words: bytes):
        self.file = files.open_input(path)
        end = self.file.size()
        self.file.seek(end - FOOTER.size)
        at, length, n, digest, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC or digest != hashlib.sha256(words).digest():
            raise ValueError(f"{path} is no shard of this dictionary")
        self.file.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(length))
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.sizes, self.n_tokens = np.frombuffer(raw, "<u4", 2 * n, 8 * n).reshape(2, n).astype(np.int64)
        self.offsets = len(MAGIC) + np.cumsum(self.sizes) - self.sizes
        self.unpack = zstandard.ZstdDecompressor(dict_data=dictionary(words)).decompress

    def ids(self, k: int) -> bytes:
        self.file.seek(int(self.offsets[k]))
        return self.unpack(self.file.read(int(self.sizes[k])))

    def batches(self, most: int = 8 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first, end, ids) of runs of documents of about `most` bytes of ids."""
        ends = np.cumsum(4 * self.n_tokens)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            self.file.seek(int(self.offsets[at]))
            block = memoryview(self.file.read(int(self.sizes[at:to].sum())))
            cuts = (self.offsets[at:to] - self.offsets[at]).tolist()
            yield at, to, [self.unpack(block[a : a + n]) for a, n in zip(cuts, self.sizes[at:to].tolist(), strict=True)]
            at = to


@dataclass
class ShardPart(InputPartition):
    file: str
    start: int


class TokenFiles(DataSource):
    """format("token_files"): writes (bucket int, doc_id, n_tokens, frame), in order within a task; reads SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite):
        return TokenWriter(self.options["path"])


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        start, parts = 0, []
        for e in sorted(files.listed(self.path), key=lambda e: e["bucket"]):
            parts.append(ShardPart(e["file"], start))
            start += e["n_tokens"]
        return parts

    def read(self, partition):
        if partition is None:
            return
        shard = Shard(files.join(self.path, partition.file), files.get(files.join(self.path, DICTIONARY)))
        starts = partition.start + np.cumsum(shard.n_tokens) - shard.n_tokens
        for a, b, ids in shard.batches():
            doc_ids = shard.doc_ids[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(starts[a:b]), pa.array(shard.n_tokens[a:b]), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        digest = hashlib.sha256(files.get(files.join(self.path, DICTIONARY))).digest()
        done: list[dict] = []
        out = None

        def close() -> None:
            index = np.array(ids, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + np.array(counts, "<u4").tobytes()
            packed = zstandard.ZstdCompressor().compress(index)
            out.write(packed)
            out.write(FOOTER.pack(len(MAGIC) + sum(sizes), len(packed), len(ids), digest, MAGIC))
            out.close()
            done.append({"bucket": bucket, "file": name, "n_docs": len(ids), "n_tokens": sum(counts), "first": ids[0], "last": ids[-1]})

        for b in iterator:
            for own, doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or own != bucket:
                    if out is not None:
                        close()
                    bucket, name, ids, sizes, counts = own, files.new_name(".tok"), [], [], []
                    out = files.open_output(files.join(self.path, name))
                    out.write(MAGIC)
                ids.append(doc_id)
                sizes.append(len(frame))
                counts.append(n)
                out.write(frame)
        if out is not None:
            close()
        return files.Written(done)

    def commit(self, messages) -> None:
        files.publish(self.path, messages)

    def abort(self, messages) -> None:
        files.discard(self.path, messages)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, docs_per_shard: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document of docs and write the shards to path.

    The dictionary is trained on the first SAMPLE_BYTES of ids of up to SAMPLE_DOCS different documents, those of the smallest
    hashes of id and text. Shards are ranges of doc_id cut at approximate quantiles, read off the id column alone; an id with more
    rows than a shard holds is dealt over several that follow each other. Texts are encoded and compressed whole where they
    lie, and only frames are shuffled. Null ids come first, null texts are empty, repeated ids are ordered by their frames, and
    an empty table gives no shard."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    hashed = cut(rows.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1_000_000)) < F.lit(min(1.0, 4 * SAMPLE_DOCS / max(n, 1)) * 1_000_000)).groupBy("h").agg(F.first("text").alias("text")))
    first = [r.h for r in hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()]
    end = np.array([end_id], "<u4").tobytes()

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [(x + end)[:SAMPLE_BYTES] for x in encoder(tokenizer).encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["h", "ids"])

    chosen = hashed.where(F.col("h").isin(first)).select("h", "text").mapInArrow(serialized, "h long, ids binary")
    samples = [bytes(r.ids) for r in sorted(chosen.collect())] if first else []
    words = train(samples) if samples else b""
    files.put(files.join(path, DICTIONARY), words)

    shards = min(MAX_SHARDS, max(1, -(-n // docs_per_shard)))
    bounds = np.array(rows.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 else [])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, dealt = zstandard.ZstdCompressor(dict_data=dictionary(words)).compress, 0
        for b in batches:
            ids = [x + end for x in encoder(tokenizer).encode(b.column(1).to_pylist())]
            own = b.column(0).to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(bounds, own, side) for side in ("left", "right"))  # bounds that are the id itself lie between
            bucket = (low + (dealt + np.arange(len(own))) % (high - low + 1)).astype(np.int32)
            dealt += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([squeeze(x) for x in ids], pa.binary())], names=["bucket", "doc_id", "n_tokens", "frame"])

    out = rows.mapInArrow(frames, "bucket int, doc_id long, n_tokens long, frame binary")
    spark.dataSource.register(TokenFiles)
    out.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "n_tokens", "frame").write.format("token_files").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before it."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)


def read_document(path: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, without reading others."""
    words = files.get(files.join(path, DICTIONARY))
    for e in files.listed(path):
        if e["first"] <= doc_id <= e["last"]:
            shard = Shard(files.join(path, e["file"]), words)
            k = int(np.searchsorted(shard.doc_ids, doc_id))
            if k < len(shard.doc_ids) and shard.doc_ids[k] == doc_id:
                return np.frombuffer(shard.ids(k), "<u4")
    return None


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Per document, from the shards read back: its place, its number of ids and their checksum."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
