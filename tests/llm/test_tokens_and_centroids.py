"""Token counts, alignment and centroid clusters against the libraries and slow versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import DATA
from tokenizers import Tokenizer

from quietfield.llm import alignment, centroids, token_counts

SF = f"{DATA}/sf0.001"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "aaaaaaa aaaa" * 50, "<|endoftext|>a<|endoftext|>", "日本語 テキスト 　x  y\n\n z", "a\x1cb \x85 c\x00", "don't I'LL we've'd 's", "x" * 5000, "ab" * 9000, " \n \t x  y", "𝒳 é é ١٢٣ ½"]


def library_counts(texts):
    return [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch_fast(texts, add_special_tokens=False)]


def test_counts_of_odd_texts():
    own, rnd = token_counts.Counter(BYTE), random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab \n's.1é日​　٣\x1c𐐀'tre") for _ in range(rnd.randint(0, 60))) for _ in range(5000)]
    assert own.count(texts) == library_counts(texts)


def test_counts_around_every_kind_of_character():
    own = token_counts.Counter(BYTE)
    texts = [f"a{c}1{c}!{c}{c} {c} b" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)][::23])]
    assert own.count(texts) == library_counts(texts)


def test_counts_in_blocks_and_with_a_small_table(monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 50)
    monkeypatch.setattr(token_counts, "BYTES", 20)
    texts = [t * 3 for t in ODD[2:]]
    assert token_counts.Counter(BYTE, keep=5).count(texts) == library_counts(texts)


def test_merges_refuse_other_files(tmp_path):
    with pytest.raises(ValueError, match="no byte-level"):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    rows = token_counts.op11_token_counts(spark, SF).toPandas().set_index("doc_id").loc[docs.doc_id]
    texts = docs.text.fillna("").tolist()
    assert rows.n_tokens.tolist() == library_counts(texts) and rows.n_bytes.tolist() == [len(t.encode()) for t in texts]
    assert (rows.over_limit == (rows.n_tokens > 512)).all()


def slow_alignment(rows):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    byte_of = {c: n for n, c in enumerate(token_counts.byte_letters())}
    found = []
    for _, text in rows:
        left = a.encode(" " + (text or ""), add_special_tokens=False)
        right = b.encode(text or "")
        la = [bytes(byte_of[c] for c in t) for t in left.tokens]
        lb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        if not text or not b"".join(la) == b"".join(lb) == (" " + text).encode():
            found.append([])
            continue
        ends_a, ends_b = np.cumsum(list(map(len, la))), np.cumsum(list(map(len, lb)))
        cuts = sorted(set(ends_a) & set(ends_b))
        found.append([([i for i, e in zip(left.ids, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(right, ends_b, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)])
    links = [[(x, y) for xs, ys in groups for x in xs for y in ys] for groups in found]
    count = Counter(p for own in links for p in set(own))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return [
        (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text(groups).encode()).hexdigest() if groups else "")
        for (doc_id, _), groups, own in zip(rows, found, links, strict=True)
    ]


def same(a, b):
    return sorted(tuple(map(str, r)) for r in a) == sorted(tuple(map(str, r)) for r in b)


def test_alignment_of_odd_texts_over_many_pages(spark):
    rows = [
        (1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (5, "x ▁ y"), (6, "日本語 テキスト  x\n\n y  <|endoftext|> <s> é é\x00 \x1c"), (7, "ab" * 3000 + " hello, world."),
        (None, "hello world  "), (8, "\n foo\n\n  bar don't 1234"), (9, "the same text, the same text."), (10, "the same text, the same text."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert same(alignment.align(docs, BYTE, PIECE, page_segments=5).collect(), slow_alignment(rows))


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert same(alignment.op12_token_alignment(spark, SF).collect(), slow_alignment([tuple(r) for r in docs]))


def test_groups_of_whole_documents(spark):
    tokens = lambda *x: [k | n << alignment.SIZE_BIT for k, n in x]
    rows = spark.createDataFrame([(1, tokens((5, 2), (6, 1), (7, 1)), tokens((8, 3), (9, 1))), (2, tokens((1, 4)), tokens((2, 1), (3, 1), (4, 2))), (3, [], []), (4, None, None)], "k long, a array<int>, b array<int>")
    got = {r.k: (r.n_a, r.n_b, r.n_groups, r.groups, r.n_links) for r in alignment.aligned(rows, ["k"]).collect()}
    assert got == {1: (3, 2, 2, "5,6|8;7|9", 3), 2: (1, 3, 1, "1|2,3,4", 3)}


def test_bounds_give_plain_rounds_with_fewer_distances():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 3, (300, 8)) for m in (0, 20, 50, 90)]).round().astype(np.int64)
    x = np.concatenate([x, x[:50]])
    now = x[rng.choice(len(x), 40, False)]
    now[7] = now[3]  # a tie wherever it is nearest
    groups, own = centroids.grouped(now, 4), centroids.Bounded(x)
    for k in range(8):
        if k:
            own.loosen(moved, groups)
        own.assign(now, groups)
        d = np.sqrt(((x[:, None] - now[None]) ** 2).sum(-1))
        assert (own.cluster == d.argmin(1)).all() and (own.upper >= d[np.arange(len(x)), own.cluster]).all()
        for g in range(groups.max() + 1):
            others = (groups == g)[None] & (np.arange(40)[None] != own.cluster[:, None])
            assert (own.lower[:, g] <= np.where(others, d, np.inf).min(1)).all()
        new = np.array([x[own.cluster == c].sum(0) // max(1, (own.cluster == c).sum()) if (own.cluster == c).any() else now[c] for c in range(40)])
        moved, now = np.sqrt(((new - now) ** 2).sum(1)) * (1 + centroids.SLACK), new
    assert own.compared < 0.5 * 8 * 40 * len(x)


def test_clusters_of_odd_vectors(spark, tables, duck):
    got = centroids.op13_centroid_clusters(spark, tables[0]).toPandas()
    assert len(got) == 60 and got.vec_id.isna().sum() == 9 and got.inertia.nunique() == 1
    assert got.groupby("cluster").distance.sum().to_dict() == got.groupby("cluster").cluster_inertia.first().to_dict()
    assert got.cluster_inertia.groupby(got.cluster).first().sum() == got.inertia[0]


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(df).collect()
