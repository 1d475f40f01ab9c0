"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a document.

The alignment itself is relational: tokens are posexploded, a window sums their byte lengths to offsets, an equi-join on
document and end finds the offsets where tokens of both sides end, a running count of these cuts numbers the groups, and a
join on document and group gives the links.

Words recur, and both tokenizers end a token before a single space in front of a word, between a letter and a mark behind
it, and between a line's end and a letter. So texts are split there, each different segment of the corpus is encoded and
aligned once, and documents are chains of segments. A page is what one task reads, up to a number of different segments: its
documents refer to its segments by number, exchanges deal pages and their segments, never the words of documents, and
kernels over a page count its pairs of ids and sum up its documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_groups
from .exact_dedup import _settings
from .token_counts import byte_letters

#: A page takes no further batch of documents beyond so many segments.
PAGE_SEGMENTS = 500_000
#: Documents of a page lie in rows, which take no further document beyond so many numbers of segments.
BUNDLE = 65_536
#: Up to so many pairs of ids, counted first, are sent to all executors with their counts: about 60 MB.
MAX_PAIRS = 1_000_000
#: Both tokenizers end a token before a space that follows no space and stands before a non-space. Texts where every space is such a one need no search.
_JOINT, _ODD = re.compile(r"(?<! )(?= \S)"), re.compile(r" (?:\s|\Z)")
#: They also end one between a Latin letter and ASCII that is no letter, number or space, and between a line's end behind a printed character
#: and such a letter (of more white space A's tokens depend on what follows).
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~\n"
_INNER, _ACROSS = re.compile(f"(?<=[{_LETTER}])(?=[{_MARK}])|(?<=[!-~{_LETTER}]\n)(?=[{_LETTER}])"), re.compile(f"[{_LETTER}][{_MARK}]|\n")
#: Segments that are encoded many in one text, and how many.
_CLEAN, _JOINED = re.compile(rf" ?[!-~À-ÖØ-öø-ÿ\n]+"), 64
#: Rows of one page lie in one partition, so keys that hold the page need no exchange; sorted input needs no hash table.
#: What a job has shuffled goes with it, and tables between jobs are packed harder.
PLAN = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.execution.useObjectHashAggregateExec": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd",
}
#: A token travels as its id and, from this bit on, the number of its bytes.
SIZE_BIT = 20


class Pair:
    """Tokenizer A (byte-level BPE of the tokenizers library) and B (BPE with byte fallback of sentencepiece) with the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are text
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        raw = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in raw):
            raise ValueError(f"{path_b} has pieces that reach over a space; texts cannot be split there")
        special = set(self.a.get_added_tokens_decoder())
        if any(_ACROSS.search(p) for k, p in enumerate(raw) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))):
            raise ValueError(f"{path_b} has pieces that reach from a letter over a mark; texts cannot be split there")
        self.bytes_a = {k: bytes(byte_of[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items() if k not in special}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(raw)]

        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int32)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int32)
        if max(len(self.size_a), len(self.size_b)) > 1 << SIZE_BIT or max(self.size_a.max(), self.size_b.max()) >= 1 << 31 - SIZE_BIT:
            raise ValueError("a vocabulary is too large, or has too long entries")
        self.token_a, self.token_b = (np.arange(len(x), dtype=np.int32) | (x << SIZE_BIT) for x in (self.size_a, self.size_b))

    def encode(self, segments: list[str]) -> tuple[Ragged, Ragged, np.ndarray]:
        """Ids by A and by B of segments, and whether both sides' bytes are the segment's.

        A segment that does not begin with a space stands in a word: it is encoded behind others, whose tokens are left out."""
        lead = ["" if s[0] == " " else " a\n" if s[0].isalpha() else " a" for s in segments]
        out: list[tuple[list[int], list[int], bool]] = [([], [], False)] * len(segments)
        clean = [k for k, s in enumerate(segments) if _CLEAN.fullmatch(s)]
        if not self._together(segments, lead, clean, out):
            clean = []
        together = set(clean)
        for k in (k for k in range(len(segments)) if k not in together):
            out[k] = self._alone(lead[k], segments[k])
        return Ragged.of([x[0] for x in out]), Ragged.of([x[1] for x in out]), np.array([x[2] for x in out], bool)

    def _together(self, segments: list[str], lead: list[str], of: list[int], out: list) -> bool:
        """Encode segments many in one text, as none has a space but the first. False if a side does not give them back so."""
        whole = [lead[k] + segments[k] for k in of]
        texts = ["".join(whole[at : at + _JOINED]) for at in range(0, len(whole), _JOINED)]
        raw = "".join(texts).encode()
        ends = np.cumsum([len(w.encode()) for w in whole], dtype=np.int64)
        starts = ends - [len(segments[k].encode()) for k in of]
        sides = []
        for found, table, sizes in (
            ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.bytes_a, self.size_a),
            (self.b.encode([t[1:] for t in texts], num_threads=1), self.bytes_b, self.size_b),
        ):
            flat = list(chain.from_iterable(found))
            if b"".join(map(table.__getitem__, flat)) != raw:
                return False
            at = np.r_[0, np.cumsum(sizes[np.array(flat, np.int64)], dtype=np.int64)]
            x, y = np.searchsorted(at, starts), np.searchsorted(at, ends)
            if (at[x] != starts).any() or (at[y] != ends).any():
                return False
            sides.append([flat[i:j] for i, j in zip(x.tolist(), y.tolist(), strict=True)])
        for k, a, b in zip(of, *sides, strict=True):
            out[k] = (a, b, True)
        return True

    def _alone(self, lead: str, segment: str) -> tuple[list[int], list[int], bool]:
        whole = lead + segment
        raw, skip = whole.encode(), len(lead.encode())
        sides = []
        for ids, table in ((self.a.encode(whole, add_special_tokens=False).ids, self.bytes_a), (self.b.encode(whole[1:]), self.bytes_b)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return [], [], False
            first, at = 0, 0
            while at < skip:
                at, first = at + len(table[ids[first]]), first + 1
            if at != skip:
                raise ValueError(f"a token of {whole!r} reaches into a segment")
            sides.append(ids[first:])
        return *sides, True


class Ragged:
    """Lists of ints behind each other."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes

    @classmethod
    def of(cls, lists: list[list[int]]) -> Ragged:
        sizes = np.array(list(map(len, lists)), np.int64)
        return cls(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(values[self.flat], dtype=np.int64)]
        ends = np.cumsum(self.sizes)
        return total[ends] - total[ends - self.sizes]

    def lists(self) -> list[list[int]]:
        ends = np.cumsum(self.sizes).tolist()
        flat = self.flat.tolist()
        return [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def column(self, null: np.ndarray, values: np.ndarray) -> pa.Array:
        """The lists, null where marked, their numbers looked up in values."""
        ends = np.r_[0, np.cumsum(self.sizes)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[self.flat]), mask=pa.array(null))


class Numbers(dict):
    """Numbers strings as they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


def words(text: str | None) -> list[str]:
    """A space and the text, split before spaces, without the space that each part begins with."""
    if not text:
        return []
    if text[0] != " " and not _ODD.search(text) and not text[0].isspace():
        return text.split(" ")
    return [w[1:] for w in _JOINT.split(f" {text}") if w]


class Parts(dict):
    """The numbers of the segments of words, found once for each word; segments are numbered as they are first met."""

    def __init__(self):
        self.segments = Numbers()

    def __missing__(self, word: str) -> list[int]:
        self[word] = found = [self.segments[s] for s in _INNER.split(f" {word}")]
        return found


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """One for each two files and worker process."""
    return Pair(path_a, path_b)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their low bytes first, then the next ones and so on, compressed: small numbers take few bytes on disks and in exchanges."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    """The n numbers that packed() has been given."""
    if not n:
        return np.zeros(0, np.int32)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, codec="zstd"), np.uint8).reshape(4, n).T).view("<i4").reshape(-1)


PAGES = "page long, doc_ids array<long>, sizes array<int>, numbers binary, segment int, word string"


def pages(docs: DataFrame, page_segments: int = PAGE_SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two kinds of rows: documents, some in a row (their ids; how many segments each has; packed() numbers of all these segments in
    order), and the segments of each page, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, parts = TaskContext.get().partitionId() << 24, Parts()
        for batch in batches:
            known = parts.segments
            first = len(known)
            of = Ragged.of([list(chain.from_iterable(map(parts.__getitem__, words(t)))) for t in batch.column(1).to_pylist()])
            m = len(known) - first
            new = list(islice(reversed(known), m))[::-1]
            ends = np.r_[0, np.cumsum(of.sizes)]
            cuts = np.r_[np.flatnonzero(np.diff(ends[:-1] // BUNDLE, prepend=-1)), len(batch)].astype(np.int32)  # where rows begin
            n = len(cuts) - 1
            doc_ids, sizes = (pa.concat_arrays([pa.ListArray.from_arrays(pa.array(cuts), x), pa.nulls(m, pa.list_(x.type))]) for x in (batch.column(0), pa.array(of.sizes, pa.int32())))
            flat = pa.array([packed(of.flat[x:y]) for x, y in zip(ends[cuts].tolist(), ends[cuts[1:]].tolist(), strict=False)] + [None] * m, pa.binary())
            numbers = pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(first, first + m, dtype=np.int32))])
            own = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(new, pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n + m, page)), doc_ids, sizes, flat, numbers, own], names=["page", "doc_ids", "sizes", "numbers", "segment", "word"])
            if len(known) >= page_segments:
                parts, page = Parts(), page + 1

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PAGES)


UNITS = "unit long, places array<struct<page: bigint, segment: int>>, a array<int>, b array<int>"


def encoded(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each of the words (unique; with places) a number and the tokens of both sides, null if a tokenizer does not give it back byte for byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = pair(path_a, path_b), TaskContext.get().partitionId() << 33
        for batch in batches:
            a, b, same = own.encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(batch))), batch.column(1), a.column(~same, own.token_a), b.column(~same, own.token_b)], names=["unit", "places", "a", "b"])
            at += len(batch)

    return words.select("word", "places").mapInArrow(run, UNITS)


def groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and group: its number `grp` from 0, and the ids `a` and `b` of both sides, in order.

    rows: unique keys with tokens a and b (see SIZE_BIT) whose bytes sum to the same on both sides. Rows without tokens have no group."""
    in_order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def ends(side: str) -> DataFrame:
        each = rows.select(*keys, F.posexplode(side).alias("pos", "token"))
        token_id = F.col("token").bitwiseAND(F.lit((1 << SIZE_BIT) - 1))
        return each.select(*keys, "pos", token_id.alias("token_id"), F.sum(F.shiftright("token", SIZE_BIT)).over(in_order).alias("end"))

    def grouped(own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        both = own.join(other.select(*keys, "end", F.lit(1).alias("cut")), [*keys, "end"], "left")
        before = Window.partitionBy(*keys).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
        numbered = both.select(*keys, "end", "token_id", F.count("cut").over(before).alias("grp"))
        return numbered.groupBy(*keys, "grp").agg(F.sort_array(F.collect_list(F.struct("end", "token_id")))["token_id"].alias(side))

    a, b = ends("a"), ends("b")
    return grouped(a, b, "a").join(grouped(b, a, "b"), [*keys, "grp"])


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def aligned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key with tokens: n_a, n_b, n_groups, n_links, `groups` (a1,a2|b1;a3|b2,b3) and `links`, an array of every link's pair of ids (A's in the upper half)."""
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    links = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: _packed(x, y))))
    each = groups(rows, keys).select(*keys, "grp", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.concat(ids("a"), F.lit("|"), ids("b")).alias("text"), links.alias("links"))
    out = each.groupBy(*keys).agg(
        F.sum("n_a").cast("int").alias("n_a"), F.sum("n_b").cast("int").alias("n_b"), F.count("*").cast("int").alias("n_groups"),
        F.array_join(F.sort_array(F.collect_list(F.struct("grp", "text")))["text"], ";").alias("groups"), F.flatten(F.collect_list("links")).alias("links"),
    )
    return out.withColumn("n_links", F.size("links"))


DOCUMENTS = ["doc_ids", "sizes", "numbers"]


def by_page(documents: DataFrame, segments: DataFrame, columns: list[str], n: int, kernel: Callable, schema: str) -> DataFrame:
    """What kernel makes of each page: of its segments' columns, a table in the order of their numbers, and an iterator of its documents, some at a time (their ids, the
    numbers of all their segments, where each one's begin and the last's end)."""
    kinds = dict(segments.dtypes) | dict(documents.dtypes)
    none = lambda names: [F.lit(None).cast(kinds[c]).alias(c) for c in names]
    left = documents.select("page", *DOCUMENTS, *none(["segment", *columns]))
    right = segments.select("page", *none(DOCUMENTS), "segment", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, bool, pa.RecordBatch]]:
            """Batches cut where the page or the kind of rows changes."""
            for b in batches:
                page, document = b.column(0).to_numpy(), b.column("segment").is_null().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((page[1:] != page[:-1]) | (document[1:] != document[:-1])) + 1
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(page)], strict=True):
                    if y > x:
                        yield int(page[x]), bool(document[x]), b.slice(x, y - x)

        source = pieces()
        piece = next(source, None)
        while piece:
            page, parts = piece[0], []
            while piece and piece[0] == page and not piece[1]:
                parts.append(piece[2].select(["segment", *columns]))
                piece = next(source, None)
            table = pa.Table.from_batches(parts).combine_chunks() if parts else None
            if parts and (table.column(0).to_numpy() != np.arange(len(table))).any():
                raise ValueError("a page lacks segments")

            def own(page: int = page) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
                nonlocal piece
                while piece and piece[0] == page:
                    for doc_ids, sizes, numbers in zip(*(piece[2].column(c) for c in DOCUMENTS), strict=True):
                        ends = np.r_[0, np.cumsum(sizes.values.to_numpy(), dtype=np.int64)]
                        yield doc_ids.values, unpacked(numbers.as_buffer(), int(ends[-1])), ends
                    piece = next(source, None)

            yield from kernel(table, own())

    both = left.unionByName(right).repartition(n, "page").sortWithinPartitions("page", F.col("segment").asc_nulls_last())
    return both.mapInArrow(run, schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of lists behind each other, where each list begins and the last ends); null lists are empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(), np.r_[0, np.cumsum(sizes)]


def _different(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def pair_counts(documents: DataFrame, segments: DataFrame, n: int) -> DataFrame:
    """Per page and pair of ids (`link`): how many of the page's documents hold it linked. Documents with a segment that is not given back hold none."""

    def kernel(table: pa.Table | None, docs: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if table is None:
            for _ in docs:
                pass
            return
        links = table.column("links").combine_chunks()
        lost = links.is_null().to_numpy(zero_copy_only=False)
        flat, at = _lists(links)
        pairs, flat = np.unique(flat, return_inverse=True)
        flat, sizes, counts = flat.astype(np.int32), np.diff(at), np.zeros(len(pairs), np.int64)
        for _, own, ends in docs:
            for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                used = _different(own[x:y])
                if not lost[used].any():
                    n = sizes[used]
                    before = np.cumsum(n)
                    counts[_different(flat[np.arange(before[-1] if len(n) else 0) + np.repeat(at[used] - before + n, n)])] += 1
        held = np.flatnonzero(counts)
        for x in range(0, len(held), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[held[x : x + 50_000]]), pa.array(counts[held[x : x + 50_000]])], names=["link", "docs"])

    return by_page(documents, segments, ["links"], n, kernel, "link long, docs long")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def whole(documents: DataFrame, segments: DataFrame, n: int) -> DataFrame:
    """Per document: the sums of its segments' numbers and the digest of their groups in order; zeros and '' for one without segments, or with one that is not given back."""

    def kernel(table: pa.Table | None, docs: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        numbers, texts, lost = np.zeros((len(NUMBERS), 0), np.int64), [], np.zeros(0, bool)
        if table is not None:
            lost = table.column("groups").is_null().to_numpy()
            numbers = np.stack([np.nan_to_num(table.column(c).to_numpy()).astype(np.int64) for c in NUMBERS])
            texts = table.column("groups").cast(pa.binary()).to_pylist()
        for doc_ids, own, ends in docs:
            given = (np.diff(ends) > 0) & (np.diff(np.r_[0, np.cumsum(lost[own])][ends]) == 0)
            sums = [pa.array(np.where(given, np.diff(np.r_[0, np.cumsum(c[own])][ends]), 0)) for c in numbers]
            listed = own.tolist()
            digests = [hashlib.sha256(b";".join(map(texts.__getitem__, listed[x:y]))).hexdigest() if ok else "" for x, y, ok in zip(ends.tolist(), ends[1:].tolist(), given.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([doc_ids, *sums, pa.array(digests, pa.string())], names=["doc_id", *NUMBERS, "groups_sha256"])

    return by_page(documents, segments, [*NUMBERS, "groups"], n, kernel, f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string")


def align(docs: DataFrame, path_a: str, path_b: str, page_segments: int = PAGE_SEGMENTS, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Per row of docs: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds a space itself. Null and empty texts, and texts that a tokenizer
    does not give back byte for byte, have no tokens: zeros and ''. Repeated rows count as documents each, null ids stay, an
    empty table gives none. Long texts are chains of segments; a text without a space is one segment, whose rows lie in one task."""
    spark = docs.sparkSession
    with _settings(spark, PLAN):
        table = cut(pages(docs, page_segments, id_col, text_col))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * table.select("page").distinct().count())
        words = table.where("segment is not null").groupBy("word").agg(F.collect_list(F.struct("page", "segment")).alias("places"))
        units = cut(encoded(words, path_a, path_b))
        found = aligned(units.select("unit", "a", "b").repartition(n, "unit"), ["unit"])
        each = cut(units.select("unit", "places").join(found, "unit", "left"))
        documents = table.where("segment is null").select("page", *DOCUMENTS)
        counts = cut(pair_counts(documents, each.select(F.inline("places"), "links"), n).groupBy("link").agg(F.sum("docs").alias("docs")))
        best = counts.groupBy(F.shiftright("link", 32).alias("a")).agg(F.max("docs").alias("most"))
        known = counts.join(best, F.shiftright("link", 32) == F.col("a")).select("link", "docs", (F.col("docs") == F.col("most")).cast("int").alias("is_best"))
        links = each.select("unit", F.explode("links").alias("link"))
        few = counts.limit(max_pairs + 1).count() <= max_pairs
        linked = links.join(F.broadcast(known), "link", "left") if few else with_groups(links, known, "link", ["unit"])
        worth = linked.groupBy("unit").agg(F.sum("docs").alias("count_sum"), F.sum("is_best").alias("n_best"))
        facts = each.drop("links").join(worth, "unit", "left").select(F.inline("places"), *NUMBERS, "groups")
        return cut(whole(documents, facts, n)).withColumnRenamed("doc_id", id_col)


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Per document: tokens on both sides, groups, links, and how its links stand in the corpus."""
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
