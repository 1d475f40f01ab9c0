"""Whole texts to token ids with a file of the tokenizers library, at the cost of their distinct units.

Of the two kinds of files that are known here, told by how they say that they normalise and cut texts; texts of any other
file go to the library whole. A vocabulary's own pattern cuts texts into units (words, numbers, marks, white space) that are encoded apart
from each other. Units recur, so each worker process keeps a table of their ids; what is new is encoded by
the library, many units in one call, and the table starts afresh when it is full. The pattern is only
spelled out for printable Latin, where its classes are beyond doubt: a text with other characters is first
cut before every space that a non-space follows, where a unit always begins, and its pieces that are not
Latin go to the library whole, as do texts that hold the vocabulary's special tokens."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import chain

#: Printable Latin without the one letter that lower-cases to two, and its letters and numbers.
_PLAIN = re.compile("[\n\x20-\x7e¡-įı-ſ]*")
_L, _N = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: Patterns of units, fixed by the two public vocabularies.
_BYTE_UNITS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
_WORD_UNITS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"
#: (normaliser, first cutter) of the two kinds, as their files state them (fixed values).
_BYTE_KIND = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
)
assert array("I").itemsize == 4 and sys.byteorder == "little"  # what ids are written as
_CUT = re.compile(r"(?= \S)")
#: Texts that are looked up together.
_GROUP = 64


class Table(dict):
    """Ids of units; a lookup of an unknown one gives None and notes it in `new`."""

    def __init__(self):
        self.new: set[str] = set()

    def __missing__(self, unit: str) -> None:
        self.new.add(unit)


class Encoder:
    def __init__(self, path: str, keep: int = 1_300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        cutter = stated["pre_tokenizer"] or {}
        kind = (stated["normalizer"], cutter["pretokenizers"][0] if cutter.get("type") == "Sequence" else cutter)
        self.words = kind == _WORD_KIND  # lower case, no white space
        self.known_kind = self.words or kind == _BYTE_KIND
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = re.compile(_WORD_UNITS if self.words else _BYTE_UNITS).findall
        self.known = Table()
        self.keep = keep

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        """Strings whose ids, one after the other, are the text's."""
        if not self.known_kind or any(s in text for s in self.specials):
            return [text]
        if _PLAIN.fullmatch(text):
            return self.find(text.lower() if self.words else text)
        return list(chain.from_iterable(self.find(p.lower() if self.words else p) if _PLAIN.fullmatch(p) else [p] for p in _CUT.split(text)))

    def forget(self) -> None:
        """Give the table's memory back."""
        self.known = Table()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), _GROUP):
            if len(self.known) > self.keep:
                self.known = Table()
            known = self.known
            group = [self.units(t) for t in texts[at : at + _GROUP]]
            found = [list(map(known.__getitem__, units)) for units in group]
            new, known.new = list(known.new), set()
            known.update(zip(new, self.library(new), strict=True))
            for units, ids in zip(group, found, strict=True):
                out.append(b"".join([known[u] if i is None else i for u, i in zip(units, ids, strict=True)] if None in ids else ids))
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    return Encoder(path)
