"""Token counts of whole texts by rank-synchronous merging of ragged arrays.

A byte-level BPE file gives the start symbols of bytes and a ranked list of pairs. Texts are cut into pre-tokens by the
file's pattern; a batch's pre-tokens lie behind each other in one array, and in each round every sequence applies its
own lowest-rank pair at all its places at once. The symbols that are left are the tokens; their ids are never listed.
That equals merging one pair at a time only if no merge makes a pair of lower rank than its own, which is checked."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import _BYTE_KIND, _BYTE_UNITS, _CUT, _PLAIN

#: Longer than any rank.
NEVER = np.iinfo(np.int32).max
#: The pattern of pre-tokens, fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A letter, a number, another sign: none begins a contraction.
LETTER, NUMBER, OTHER = "b", "1", "!"
#: Characters of a text that are cut into pre-tokens at a time, bytes that are merged at a time, and pre-tokens whose counts a worker keeps.
BLOCK, BYTES, KEEP = 1_000_000, 4_000_000, 500_000
LIMIT = 512


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranked pairs of a byte-level BPE file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or (stated["normalizer"], stated["pre_tokenizer"]) != _BYTE_KIND:
            raise ValueError(f"{path} is no byte-level BPE file of the kind that is known here")
        added = stated["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.specials = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, self.made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.symbols = np.array([vocab[c] for c in byte_letters()], np.int32)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)  # rank of the merge that makes a symbol
        born[self.made] = np.arange(len(pairs))
        if len(np.unique(self.made)) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} has merges that make pairs of lower rank than their own")
        self.width = len(born)
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = self.made.astype(np.int32)
        self.first = self.rank(np.repeat(self.symbols, 256), np.tile(self.symbols, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NEVER where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each piece when no pair can be merged any more."""
        counts = np.array([len(p) for p in pieces], np.int64)
        alive = np.flatnonzero(counts > 1)
        raw = np.frombuffer(b"".join([pieces[k] for k in alive]), np.uint8)
        size = counts[alive]
        symbols = self.symbols[raw]
        ranks = np.full(len(raw), NEVER, np.int32)
        ranks[:-1] = self.first[raw[:-1], raw[1:]]
        ranks[np.cumsum(size) - 1] = NEVER  # no pair reaches into the next piece
        while len(alive):
            starts = np.cumsum(size) - size
            low = np.minimum.reduceat(ranks, starts)
            going = low < NEVER
            if not going.all():
                counts[alive[~going]] = size[~going]
                keep = np.repeat(going, size)
                symbols, ranks, alive, size, low = symbols[keep], ranks[keep], alive[going], size[going], low[going]
                if not len(alive):
                    break
            at = np.flatnonzero(ranks == np.repeat(low, size))
            opens = np.ones(len(at), bool)
            opens[1:] = at[1:] != at[:-1] + 1  # a run of overlapping pairs, as in aaaa: every other one, from its left
            run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ends = np.cumsum(size)
            owner = np.searchsorted(ends, at, side="right")
            symbols[at] = self.made[ranks[at]]
            ranks[at] = ranks[at + 1]  # only a last symbol's NEVER is of use
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
            size = size - np.bincount(owner, minlength=len(size))
            now = at - np.arange(len(at))
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(size) - 1] = True
            changed = np.unique(np.concatenate([now, now - 1]))
            changed = changed[changed >= 0]
            changed = changed[~last[changed]]
            ranks[changed] = self.rank(symbols[changed], symbols[changed + 1])
        return counts


class Counter:
    """Token counts of texts. Counts of pre-tokens are kept, as they recur, until there are too many."""

    def __init__(self, path: str, keep: int = KEEP):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.merges, self.keep = Merges(path), keep
        self.known: dict[str, int] = {}
        self.plain, self.any, self.cut = re.compile(_BYTE_UNITS).findall, regex.compile(PATTERN).finditer, ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.alike = {LETTER: regex.compile(r"\p{L}").match, NUMBER: regex.compile(r"\p{N}").match, OTHER: regex.compile(r"[^\s\p{L}\p{N}]").match}
        self.classes: dict[int, int] = {}

    def as_there(self, text: str) -> str:
        """text with each character that the library and this pattern's tables class differently (they know other versions of
        Unicode) by one of the library's class, so that both cut alike. The library says once for each character."""
        for c in set(text):
            if ord(c) not in self.classes:
                kind = next((k for k in (LETTER, NUMBER, OTHER) if len(self.cut(k + c)) == 1), None)
                self.classes[ord(c)] = ord(c if kind is None or self.alike[kind](c) else kind)
        return text.translate(self.classes)

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return self.plain(text)
        out = []
        for part in _CUT.split(text):
            out += self.plain(part) if _PLAIN.fullmatch(part) else [part[m.start() : m.end()] for m in self.any(self.as_there(part))]
        return out

    def blocks(self, text: str) -> Iterator[str]:
        """A long text in parts, cut where a pre-token begins: before a space that a non-space follows."""
        at = 0
        while len(text) - at > BLOCK:
            found = _CUT.search(text, at + BLOCK)
            end = found.start() if found else len(text)
            yield text[at:end]
            at = end
        yield text[at:]

    def learn(self, new: list[str]) -> None:
        at = 0
        while at < len(new):
            pieces, size = [], 0
            while at + len(pieces) < len(new) and size < BYTES:
                pieces.append(new[at + len(pieces)].encode())
                size += len(pieces[-1])
            self.known.update(zip(new[at : at + len(pieces)], self.merges.count(pieces).tolist(), strict=True))
            at += len(pieces)

    def count(self, texts: list[str]) -> list[int]:
        total, group, size = [0] * len(texts), [], 0

        def flush() -> None:
            units = [self.pre_tokens(part) for _, part in group]
            known = self.known
            new = {u for u in chain.from_iterable(units) if u not in known}
            if len(known) + len(new) > self.keep:
                known.clear()
                new = set(chain.from_iterable(units))
            self.learn(list(new))
            for (k, _), own in zip(group, units, strict=True):
                total[k] += sum(map(known.__getitem__, own))

        for k, text in enumerate(texts):
            parts = [text]
            if self.merges.specials and self.merges.specials.search(text):
                parts = self.merges.specials.split(text)
                total[k] = len(parts) - 1
            for part in chain.from_iterable(map(self.blocks, parts)):
                group.append((k, part))
                size += len(part)
                if size > BLOCK:
                    flush()
                    group, size = [], 0
        flush()
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One for each file and worker process."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text is empty: no bytes, no tokens. A null id stays null, repeated rows are counted each, an empty table gives none.
    Texts are counted whole, in blocks of a million characters, so that memory does not grow with their length, except with that
    of a single pre-token (letters or signs without a space). Special tokens in a text count one each. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = np.array(own.count(text.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(text.cast(pa.binary())).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("doc_id", id_col)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Per document: bytes and tokens of its whole text, and whether it has over 512 tokens."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
