"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens.

Packing is online and bounded in space: `open_bins` bins are open at a time, found through a bitset keyed
by free space. A piece goes to the open bin that it leaves fullest; if it fits none and all bins are open,
the fullest one closes. Pieces are dealt over tasks of about `pieces_per_task`, each packing on its own, so
no task grows with the corpus; a task leaves at most open_bins bins unfilled. Within a task pieces arrive in
blocks chosen by a hash, about twice as many as bins may be open, the longest of a block first: bins that long
pieces open are then still open when the short ones come."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .encoding import encoder

CAPACITY, OPEN_BINS, PIECES_PER_TASK, END_ID = 2048, 8192, 200_000, 0


class BestFit:
    """Bins with the same free space form a stack; bit f of the bitset says that stack f is not empty."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.n_open, self.n_bins = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to capacity tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(number)
            self.n_open += 1
        return number, self.capacity - free


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None) -> DataFrame:
    """Pieces of every document's ids and end id; only documents longer than the capacity are cut. Null text is empty.

    keep: units whose ids a worker holds at most, and only as long as a task runs; without it, as many as the encoder likes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, width = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        own.keep = keep or own.keep
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), own.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                rows += [(doc_id, k, at // 4, len(part := ids[at : at + width]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), width))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if keep:
            own.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """pieces with sequence_id and offset. Rows need a length of 1 to capacity; other columns are carried along.

    pieces is read twice and should be a written table."""
    total = pieces.count()
    n = max(1, -(-total // pieces_per_task))
    blocks = max(1, -(-total // (n * 2 * open_bins)))
    place_of = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 33
        for b in batches:
            at = [bins.place(x) for x in b.column(place_of).to_pylist()]
            number, offset = np.array(at, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number + base), pa.array(offset.copy())], names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    mixed = pieces.repartition(n).sortWithinPartitions(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)), F.desc("length"), "doc_id", "piece")
    return mixed.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, keep: int | None = None, **options) -> DataFrame:
    """Every document of docs, tokenised, cut and packed.

    A repeated row is packed again; a null id stays null; an empty table packs nothing."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut(token_pieces(docs, tokenizer, keep=keep)), **options)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Per piece: its document, its span of ids and its place in a sequence."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
