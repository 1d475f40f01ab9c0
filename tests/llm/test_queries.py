"""Every query against its SQL or a brute-force version, over whole small tables."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, same_rows

from pyspark.sql import functions as F

from quietfield.llm import common, langid, lm_score, mixing, packing, simhash, token_files, warc
from quietfield.llm.queries import ORACLE_SQL, QUERIES

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def tokens_of(name, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck(ORACLE_SQL[name], SF)
    for c in {"refers_to"} & set(got.columns):
        got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert same_rows(got, want)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_and_empty_tables(spark, tables, name):
    full, empty = tables
    n = 8 if "warc" in name or "main_text" in name else 60 if "centroid" in name else 11
    found = QUERIES[name](spark, full).toPandas()
    assert len(found) >= n if "packing" in name else len(found) == n
    none = QUERIES[name](spark, empty)
    assert none.columns == list(found.columns) and none.count() == 0


def test_warc_odd_rows(spark, tables):
    rows = warc.op1_warc_transactions(spark, tables[0]).collect()
    key = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    body = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    same, none, long = key(b"same"), key(b""), key(b"x" * 300_000)
    want = [(1, 4, same, "revisit", 2), (2, 4, same, "response", None), (2, 4, same, "revisit", 2), (3, 0, none, "revisit", 4), (4, 0, none, "response", None), (9, 300_000, long, "response", None), (10, len(body), key(body), "response", None), (None, len(body), key(body), "revisit", 10)]
    assert got == Counter(want) and all(r.intact for r in rows)


def test_warc_keeps_payloads_and_parts(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    rows = warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/w")).toPandas()
    want = {p.page_id: p.html.encode() for p in pages.toPandas().itertuples()}
    got = {int(dict(r.metadata.fields)["page-id"]): bytes(r.response.payload) for r in rows.itertuples() if r.response.type == "response"}
    assert got == {k: want[k] for k in got} and len(rows) == len(want) and rows.request.notna().all() and (rows.n_request == 1).all()


def test_warc_reader_takes_plain_and_broken_files():
    import io

    r = warc.record("response", "<a>", "http://x", b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nWARC/1.1", **{"Content-Type": "application/http"})
    for data in (r * 3, b"".join(__import__("gzip").compress(x) for x in (r, r, r)), __import__("gzip").compress(r * 3)):
        assert [b for _, b in warc.records(io.BytesIO(data).read)] == [b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nWARC/1.1"] * 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(r[:-9]).read))


def test_language_id_held_out(spark, docs):
    rows = langid.op3_language_id(spark, f"{DATA}/sf0.01").toPandas()
    truth = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    own = both[both.held_out]
    assert (own.lang_pred == own.lang).mean() > 0.98 and rows.score.between(0, 1).all()


def test_language_id_families_and_odd_texts(spark, odd_docs):
    assert langid.family("de") == langid.family("en") == "germanic" and langid.family("xx") == "xx"
    rows = langid.predict(odd_docs, langid.learn(odd_docs)).toPandas().set_index("doc_id")
    assert list(rows.lang_pred[[3, 4, 7]]) == ["und"] * 3 and (rows.score[[3, 4, 7]] == 0).all()
    assert langid.predict(odd_docs, None).where("lang_pred <> 'und'").count() == 0


def test_token_files(spark, docs):
    rows = token_files.op4_token_files(spark, SF).toPandas().sort_values("start")
    start = 0
    for r, ids in zip(rows.itertuples(), tokens_of("byte_bpe_50k.json", docs.sort_values("doc_id").text), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert list(rows.doc_id) == sorted(docs.doc_id)


def test_token_files_by_document_and_shard(spark, odd_docs, tmp_path):
    import public_tokenizers

    path = f"file://{tmp_path}/t"
    token_files.write_tokens(odd_docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, docs_per_shard=3)
    rows = token_files.read_tokens(spark, path).toPandas().sort_values("start")
    assert len(rows) == 11 and (rows.start.to_numpy() == np.r_[0, rows.n_tokens.cumsum()[:-1]]).all()
    assert np.isnan(rows.doc_id.iloc[0]) and rows.doc_id.iloc[1:].is_monotonic_increasing
    assert token_files.read_document(path, 6).tolist() == [*tokens_of("byte_bpe_50k.json", ["el perro y la casa de los " * 4000])[0], 2]
    assert token_files.read_document(path, 77) is None
    with pytest.raises(ValueError):
        token_files.Shard(token_files.files.join(path, token_files.files.listed(path)[0]["file"]), b"another dictionary")


def test_token_files_deal_out_a_repeated_id(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(7 if i % 2 else i, f"text {i % 3}") for i in range(300)], "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, docs_per_shard=10)
    rows = token_files.read_tokens(spark, path).toPandas().sort_values("start")
    assert len(rows) == 300 and rows.doc_id.is_monotonic_increasing and (rows.start.to_numpy() == np.r_[0, rows.n_tokens.cumsum()[:-1]]).all()
    assert max(e["n_docs"] for e in token_files.files.listed(path)) < 40


def test_language_sample_is_bounded(spark):
    rows = [(None, "the same text of one language", "en") for _ in range(500)] + [(i, f"ein anderer Text mit {'abcdefgh'[i % 8] * 5}", f"l{i % 250}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert sum(map(len, model.members.values())) <= langid.MAX_LANGS and "en" in model.members["germanic"]


def test_main_text_of_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    for r in QUERIES["op5_main_text"](spark, SF).toPandas().itertuples():
        article = re.search(r"<article>(.*?)(</article>|$)", pages.html[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages.url[r.page_id]


def brute_components(fps, ids, radius=2):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    label = ids.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_simhash(spark, docs):
    import xxhash

    rows = simhash.op6_simhash_near_dedup(spark, SF).toPandas().set_index("doc_id")
    for d in docs.itertuples():
        words = [w for w in d.text.encode().lower().split()]
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) for k in range(64)]
        assert rows.fingerprint[d.doc_id] == f"{sum((2 * n > len(grams)) << k for k, n in enumerate(ones)):016x}"
    fps = np.array([int(f, 16) for f in rows.fingerprint], np.uint64)
    assert (brute_components(fps, rows.index.to_numpy()) == rows.component_id.to_numpy()).all()


def flipped(rng, n=60, rounds=6):
    """Fingerprints in chains of single and double flips."""
    fps = [rng.integers(0, 2**63, n, dtype=np.uint64)]
    for _ in range(rounds):
        last = fps[-1]
        for _ in range(rng.integers(1, 3)):
            last = last ^ (np.uint64(1) << rng.integers(0, 64, len(last)).astype(np.uint64))
        fps.append(last)
    return np.unique(np.concatenate(fps))


def test_gray_index_finds_all_links_and_prunes():
    fps = flipped(np.random.default_rng(5))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    want = {(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if int(a ^ b).bit_count() <= 2}
    for fanout in (2, 4, 8):
        index = simhash.GrayIndex(fps, fanout=fanout)
        assert len(index.levels) > 2 and {(int(i), int(j)) for q, e in index.search(fps, 2, block=37) for i, j in zip(q, e, strict=True)} == want
        assert {(int(i), int(j)) for q, e in index.search(fps, 2, after=np.arange(len(fps))) for i, j in zip(q, e, strict=True)} == {(i, j) for i, j in want if j > i}
    rng = np.random.default_rng(6)
    many = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    index = simhash.GrayIndex(many[np.argsort(simhash.gray_rank(many))])
    assert sum(len(q) for q, _ in index.search(many[:500], 2)) == 500 and index.visited < 500 * len(many) / 8  # whole groups are dropped


def test_gray_order_sorts_as_gray_rank(spark):
    fps = flipped(np.random.default_rng(8))
    rows = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long").withColumn("o", simhash.gray_order(F.col("fp"))).orderBy("o").collect()
    assert [np.int64(r.fp).view(np.uint64) for r in rows] == list(fps[np.argsort(simhash.gray_rank(fps))])


@pytest.mark.parametrize(("ranges", "limit"), [(1, 1000), (26, 1000), (1, 16)])
def test_links_over_ranges_join_the_classes_of_brute_force(spark, ranges, limit):
    fps = flipped(np.random.default_rng(5))
    nodes = common.cut(spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long"))
    table, count = simhash.gray_ranges(nodes, ranges, limit)
    assert count == max(ranges, -(-len(fps) // limit)) and table.count() == len(fps)
    found = {r.node: r.component for r in simhash.connected_components(simhash.fingerprint_links(nodes, ranges=ranges, limit=limit)).collect()}
    signed = fps.view(np.int64)
    assert [found.get(int(f), int(f)) for f in signed] == brute_components(fps, signed.copy()).tolist()


def test_simhash_classes_of_repeated_and_missing_ids(spark):
    rows = [(5, "a b c d"), (5, "x y z w"), (None, "p q r s"), (None, "a b c d"), (9, "x y z w"), (9, "k l m n")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(map(str, found[["doc_id", "component_id"]].values.tolist())) == sorted(map(str, [[5.0, np.nan], [5.0, 5.0], [np.nan, np.nan], [np.nan, np.nan], [9.0, 5.0], [9.0, 9.0]]))


def test_mixing(spark, docs):
    rows = mixing.op8_mixing(spark, SF).toPandas()
    assert len(rows) == len(docs) and rows.probability.between(0, 1).all()
    cells = rows.groupby(["source", "lang", "topic"]).agg(tokens=("n_tokens", "sum"), share=("target_share", "first"), p=("probability", "first")).reset_index()
    for axis in mixing.AXES:  # the raked shares meet every marginal
        sums = cells.groupby(axis).tokens.sum()
        goal = (sums / sums.sum()) ** mixing.TEMPERATURE[axis]
        np.testing.assert_allclose(cells.groupby(axis).share.sum(), goal / goal.sum(), atol=1e-6)
    assert (cells.p * cells.tokens).sum() == pytest.approx(mixing.BUDGET * cells.tokens.sum(), rel=1e-6)
    free = cells[cells.p < 1]
    ratio = free.p * free.tokens / free.share
    assert ratio.max() == pytest.approx(ratio.min(), rel=1e-6)
    assert mixing.sample(spark.read.parquet(f"{SF}/documents.parquet")).count() == rows.sampled.sum()
    assert (rows.topic != "none").all() and rows.topic.nunique() > 3


def slow_rake(tokens, goals, rounds=3000):
    """Raking over a dictionary of cells, one cell at a time."""
    share = {c: t / sum(tokens.values()) for c, t in tokens.items()}
    for _ in range(rounds):
        for k, goal in enumerate(goals):
            sums = Counter()
            for c, s in share.items():
                sums[c[k]] += s
            share = {c: s * goal[c[k]] / sums[c[k]] for c, s in share.items()}
    return share


def test_mixing_meets_given_targets_as_slow_raking_does(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 30))), str(rng.choice(["en", "de", "fr"])), str(rng.choice(["a", "b"])), str(rng.choice(["t1", "t2", None]))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    given = {"lang": {"en": 0.2, "de": 0.5, "xx": 9.0}, "source": {"a": 0.5, "b": 0.5}}
    found = [mixing.mixture(docs, topic_col="subject", given=given, budget=0.3, max_cells=n).toPandas() for n in (1000, 1)]
    cells = found[0].groupby(["source", "lang", "topic"]).agg(tokens=("n_tokens", "sum"), share=("target_share", "first"), p=("probability", "first"))
    topics = cells.groupby("topic").tokens.sum() ** mixing.TEMPERATURE["topic"]
    want = slow_rake(cells.tokens.to_dict(), [{"a": 0.5, "b": 0.5}, {"en": 0.2, "de": 0.5, "fr": 0.3}, (topics / topics.sum()).to_dict()])
    np.testing.assert_allclose(cells.share, [want[c] for c in cells.index], rtol=1e-6)
    assert (cells.p < 1).all() and (cells.p * cells.tokens).sum() == pytest.approx(0.3 * cells.tokens.sum())
    by_id = [f.sort_values("id") for f in found]
    np.testing.assert_allclose(by_id[0].probability, by_id[1].probability, rtol=1e-6)
    drawn = {r.doc_id: r.u for r in mixing.described(docs, topic_col="subject").withColumnRenamed("id", "doc_id").collect()}
    assert (by_id[0].sampled == [drawn[i] < p for i, p in zip(by_id[0].id, by_id[0].probability, strict=True)]).all()
    assert 0.2 < (by_id[0].n_tokens * by_id[0].sampled).sum() / by_id[0].n_tokens.sum() < 0.4


def test_mixing_tells_cells_apart_whatever_their_names_hold(spark):
    rows = [(1, "one two", "x", "a\x1fb", "t"), (2, "three", "b\x1fx", "a", "t"), (3, "four", "x", "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    small, large = (sorted((r.id, r.source, r.lang, round(r.probability, 6)) for r in mixing.mixture(docs, topic_col="subject", max_cells=n, temperature=dict.fromkeys(mixing.AXES, 1.0)).collect()) for n in (1000, 1))
    assert small == large and [r[:3] for r in large] == [(i, s, k) for i, _, k, s, _ in rows]


def test_mixing_beyond_the_bound(spark, odd_docs):
    docs = common.placeable(odd_docs)
    small, large = (mixing.mixture(docs, max_cells=n).toPandas() for n in (1000, 2))
    assert len(small) == len(large) == 11
    key = lambda f: f.sort_values(["_file", "_row"]).reset_index(drop=True)
    np.testing.assert_allclose(key(small).probability, key(large).probability, rtol=1e-6, atol=1e-9)
    assert (key(small).sampled == key(large).sampled).all()
    for n in (1000, 2):
        kept = mixing.sample(docs, max_cells=n)
        assert kept.columns == odd_docs.columns and kept.count() == small.sampled.sum()


def test_topics_tell_words_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"{'xyz'[i % 3]}{k}" for k in range(30)], 40)), "en", "a") for i in range(90)]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    by_topic = found.assign(kind=found.id % 3).groupby("topic").kind.nunique()
    assert (by_topic == 1).all() and len(by_topic) >= 3


def test_packing(spark, docs):
    rows = packing.op9_best_fit_packing(spark, SF).toPandas()
    ids = {d: np.array([*x, 0], "<u4") for d, x in zip(docs.doc_id, tokens_of("word_bpe_49k.json", docs.text), strict=True)}
    for r in rows.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.start, len(part), zlib.crc32(part.tobytes())) == (2048 * r.piece, r.length, r.ids_crc32)
    assert (rows.groupby("doc_id").length.sum() == [len(ids[d]) for d in sorted(ids)]).all()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all() and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1.05 * rows.length.sum() / 2048 + 1


def test_best_fit_bins():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [bins.place(n) for n in (5, 8, 9, 5)] == [(2, 0), (3, 0), (4, 0), (2, 5)]  # the bin with 8 was the fullest and closed
    rng = np.random.default_rng(2)
    slow: list[list[int]] = []  # [free, number]
    bins, made = packing.BestFit(64, 5), 0
    for n in rng.integers(1, 65, 3000).tolist():
        fit = [b for b in slow if b[0] >= n]
        if fit:
            left = min(b[0] for b in fit)
        else:
            if len(slow) >= 5:
                slow.remove(min(slow))
            left, made = 64, made + 1
            slow.append([64, made])
        number, offset = bins.place(n)
        assert offset == 64 - left
        own = next(b for b in slow if b[0] == left)
        own[0] -= n
        if not own[0]:
            slow.remove(own)
    assert bins.n_bins == made


def test_lm_vocabulary_and_tokens(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    words = Counter(w for t in docs.text for w in t.lower().split())
    ordered = sorted(words.items(), key=lambda x: (-x[1], x[0]))
    vocab = lm_score.vocabulary(frame, words=300)
    assert vocab.frequent == [w for w, _ in ordered[:300]]
    rare = ordered[300:]
    for k in range(lm_score.RARE):
        own = [(w, n) for w, n in rare if lm_score.ending(w) % lm_score.RARE == k]
        token = lm_score.WORDS + lm_score.ending(own[0][0])
        assert vocab.of_class[token] == lm_score.SINGLE + lm_score.GROUPS + k and vocab.within[token] == pytest.approx(-np.log(len(own)))
    for k in range(lm_score.SINGLE, lm_score.SINGLE + lm_score.GROUPS):
        own = np.flatnonzero(vocab.of_class[:300] == k)
        assert np.exp(vocab.within[own]).sum() == pytest.approx(1, abs=1e-4)
    assert np.exp(vocab.prior).sum() == pytest.approx(1, abs=1e-4)
    tokens = lm_score.Tokens(vocab.frequent)
    ids, own, n = lm_score.joined([tokens.of(t) for t in ("a b", None, "", "c")])
    assert n.tolist() == [2, 0, 0, 1] and own.tolist() == [2, 3, 10] and (ids[[0, 1, 4, 5, 6, 7, 8, 9, 11, 12]] == lm_score.EDGE).all()


def slow_loss(rows, context, target):
    net = lm_score.Network(rows.astype(np.float64))
    z = net.logits(net.hidden([net.parts()[0][c] for c in context]))
    return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(target)), target].sum()


def test_lm_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    net = lm_score.Network.new(np.log(rng.dirichlet(np.ones(lm_score.CLASSES))).astype(np.float32))
    context, target = rng.integers(0, 30, (4, 50)).astype(np.uint16), rng.integers(0, lm_score.CLASSES, 50)
    loss, touched, de, rest = lm_score.gradients(net, context, target)
    assert loss == pytest.approx(slow_loss(net.rows, context, target), rel=1e-5)
    grads = np.zeros(net.rows.shape)
    grads[touched], grads[lm_score.EDGE + 1 :] = de, rest
    for row in [int(touched[0]), int(touched[7]), *(lm_score.EDGE + 1 + np.array([0, 3, 4, 5, 30, -1 + len(rest)])).tolist()]:
        for column in (0, 11):
            moved = [net.rows.astype(np.float64) for _ in range(2)]
            moved[0][row, column] += 1e-5
            moved[1][row, column] -= 1e-5
            slope = (slow_loss(moved[0], context, target) - slow_loss(moved[1], context, target)) / 2e-5
            assert grads[row, column] == pytest.approx(slope, rel=2e-3, abs=2e-3)


def test_lm_score(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    vocab = lm_score.vocabulary(frame)
    numbered = common.cut(lm_score.with_tokens(frame, vocab.frequent))
    net = lm_score.train(numbered, vocab)
    rows = lm_score.scores(numbered, net, vocab).toPandas().set_index("doc_id")
    plain = lm_score.scores(numbered, lm_score.Network.new(vocab.prior), vocab).toPandas()
    assert rows.pll.sum() / rows.n_tokens.sum() > plain.pll.sum() / plain.n_tokens.sum() + 0.3  # both sides tell more than frequencies
    tokens = lm_score.Tokens(vocab.frequent)
    e, s, b, o, c = net.parts()
    for d in docs.head(20).itertuples():
        ids = [lm_score.EDGE] * 2 + [tokens[w] for w in d.text.lower().split()] + [lm_score.EDGE] * 2
        want = 0.0
        for k in range(2, len(ids) - 2):
            h = np.tanh(b + sum(e[ids[k + p]] * s[i] for i, p in enumerate((-2, -1, 1, 2))))
            z = o @ h + c
            want += z[vocab.of_class[ids[k]]] - np.log(np.exp(z - z.max()).sum()) - z.max() + vocab.within[ids[k]]
        assert rows.pll[d.doc_id] == pytest.approx(want, rel=1e-4) and rows.n_tokens[d.doc_id] == len(ids) - 4


def test_lm_means_weigh_rows_by_their_tokens(spark):
    frame = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(40)], "doc_id long, text string")
    vocab = lm_score.vocabulary(frame)
    net = lm_score.Network.new(vocab.prior)
    rows = lm_score.with_tokens(frame, vocab.frequent)
    one, many = (lm_score.learnt_round(rows.repartition(n), net, vocab, 0, 1) for n in (1, 8))
    moved = (one.rows != net.rows).any(axis=1)
    assert moved[: len(vocab.frequent)].all() and not moved[lm_score.WORDS : lm_score.EDGE].any() and ((many.rows != net.rows).any(axis=1) == moved).all()
