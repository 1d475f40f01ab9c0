"""Segments of token alignment: where words are split inside, and that many are encoded together as each alone."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from quietfield.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The end.\nNext line, it's (really) über-große Wörter; naïve.", "don't 'tis o'clock I'll we've x's.", "a.b,c a1,b2 3.14% $x_y [z]{w}\n\nEnd\n", "é, fiﬁ. ªº, ². café!\nÀb",
    "a  b ,c\t.\nd \n e", "<s>x</s>,\n<|endoftext|>a.b", "日本,a.\n語 x▁.y", "A.\nB.\nC,,D..\nE" * 9,
]


def segments_of(text):
    parts = alignment.Parts()
    numbers = [k for w in alignment.words(text) for k in parts[w]]
    names = list(parts.segments)
    return [names[k] for k in numbers]


def test_segments_are_the_text_and_are_shared():
    for text in TEXTS:
        assert "".join(segments_of(text)) == f" {text}"
    assert segments_of("word, word. word.\nword") == [" word", ",", " word", ".", " word", ".\n", "word"]


def test_segments_have_the_tokens_of_whole_texts():
    own = alignment.pair(*PATHS)
    every = sorted({s for t in TEXTS for s in segments_of(t)})
    a, b, same = own.encode(every)
    together = dict(zip(every, zip(a.lists(), b.lists(), same.tolist(), strict=True), strict=True))
    for s in every:  # one by one
        a, b, same = own.encode([s])
        assert together[s] == (a.lists()[0], b.lists()[0], bool(same[0]))
    for text in TEXTS:
        found = [together[s] for s in segments_of(text)]
        whole_a, whole_b = own.a.encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text)
        raw = f" {text}".encode()
        given = all(b"".join(map(t.__getitem__, ids)) == raw for t, ids in ((own.bytes_a, whole_a), (own.bytes_b, whole_b)))
        assert given == all(x[2] for x in found)
        if given:
            assert [k for x in found for k in x[0]] == whole_a and [k for x in found for k in x[1]] == whole_b


def test_many_pairs_are_joined_without_broadcast(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (None, TEXTS[0])], "doc_id long, text string").repartition(2)
    few, many = (sorted(map(str, alignment.align(docs, *PATHS, page_segments=40, max_pairs=n).collect())) for n in (1_000_000, 3))
    assert few == many and len(few) == len(TEXTS) + 2


def test_pages_hold_documents_packed(spark):
    """Numbers of segments take less than two bytes each, not four, and any number comes back."""
    for numbers in ([], [0], [3, 255, 256, 65_535, 65_536, 2**31 - 1], list(range(1000)) * 9):
        assert alignment.unpacked(pa.py_buffer(alignment.packed(np.array(numbers, np.int32))), len(numbers)).tolist() == numbers
    texts = [*TEXTS, None, "", *(" ".join(f"w{(k * j) % 900}" for k in range(400)) for j in range(300))]
    rows = [(None if k == 5 else k, t) for k, t in enumerate(texts)]
    found = alignment.pages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    names = [r.word for r in sorted((r for r in found if r.segment is not None), key=lambda r: r.segment)]
    docs, packed, n = [], 0, 0
    for r in (r for r in found if r.segment is None):
        own = iter(alignment.unpacked(pa.py_buffer(bytes(r.numbers)), sum(r.sizes)).tolist())
        docs += [(i, "".join(names[next(own)] for _ in range(size))) for i, size in zip(r.doc_ids, r.sizes, strict=True)]
        packed, n = packed + len(r.numbers), n + sum(r.sizes)
    assert docs == [(i, f" {t}" if t else "") for i, t in rows] and n > alignment.BUNDLE and packed < 2 * n
