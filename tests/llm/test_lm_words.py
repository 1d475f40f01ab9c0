"""The hierarchical softmax of the scoring network: every word is told from the others of its class by both sides."""

import numpy as np
import pyarrow as pa
import pytest

from quietfield.llm import common, lm_score


def small(seed=3):
    """A vocabulary with words of their own, groups and endings, its tree, and a network with random weights."""
    rng = np.random.default_rng(seed)
    frequent = [(f"w{k:03}", 4000 // (k + 1) + 1) for k in range(300)]
    vocab = lm_score.Vocabulary.of(frequent, {k: (5 + k % 40, 1 + k % 5) for k in range(lm_score.ENDINGS)})
    tree = lm_score.Tree.of(vocab)
    net = lm_score.Network.new(vocab.prior, nodes=tree.n)
    net.rows[lm_score.NODES :] = rng.normal(0, 0.5, (tree.n, lm_score.HIDDEN))
    return rng, vocab, tree, net


def scored(vocab, tree, net, context, words):
    """Scores of the words, each in the middle of the context."""
    tokens = np.array([[*context[:2], w, *context[2:]] for w in words], np.uint16)
    return lm_score.Scorer(net, vocab, tree).scores(tokens.ravel(), np.arange(len(words)) * 5 + 2)


def test_probabilities_of_all_words_are_one():
    rng, vocab, tree, net = small()
    words = np.r_[np.arange(300), np.arange(lm_score.WORDS, lm_score.EDGE)]
    of_each = np.r_[np.ones(300), [1 + k % 5 for k in range(lm_score.ENDINGS)]]
    for _ in range(3):
        p = np.exp(scored(vocab, tree, net, rng.integers(0, 300, 4), words))
        assert (p * of_each).sum() == pytest.approx(1, abs=1e-4)
    flat = lm_score.Network.new(vocab.prior, nodes=tree.n)  # before training a frequent word has its share of its class
    groups = np.arange(lm_score.SINGLE, 300)
    assert scored(vocab, tree, flat, [1, 2, 3, 4], groups) == pytest.approx(scored(vocab, None, flat, [1, 2, 3, 4], groups), abs=1e-4)


def test_gradients_of_whole_ways():
    rng, vocab, tree, net = small()
    context = rng.integers(0, 300, (4, 1500)).astype(np.uint16)
    words = np.r_[rng.integers(0, 300, 1000), rng.integers(lm_score.WORDS, lm_score.EDGE, 500)].astype(np.uint16)
    loss, touched, de, rest, nodes, dn = lm_score._gradients(net, context, vocab.of_class[words], tree, words)
    grads = np.zeros(net.rows.shape)
    grads[touched], grads[lm_score.EDGE + 1 : lm_score.NODES], grads[lm_score.NODES + nodes.astype(int)] = de, rest, dn

    def slow(rows):
        own = lm_score.Network(rows)
        total = 0.0
        h = own.hidden([own.parts()[0][c] for c in context])
        for x, w, k in zip(h, words, vocab.of_class[words], strict=True):
            z = own.parts()[3] @ x + own.parts()[4]
            total -= z[k] - np.log(np.exp(z).sum())
            way = slice(tree.first[w], tree.first[w] + tree.depth[w])
            total += np.log1p(np.exp(-(tree.signs[way] * (own.nodes()[tree.nodes[way]] @ x) + tree.odds[way]))).sum()
        return total

    rows = net.rows.astype(np.float64)
    assert loss == pytest.approx(slow(rows), rel=1e-5)
    for row in (int(touched[0]), int(touched[50]), lm_score.EDGE + 1, lm_score.NODES - 20, lm_score.NODES + int(nodes[0]), lm_score.NODES + int(nodes[9])):
        step = np.zeros_like(rows)
        step[row, 5] = 1e-5
        assert grads[row, 5] == pytest.approx((slow(rows + step) - slow(rows - step)) / 2e-5, rel=5e-3, abs=5e-3)


def test_sums_of_rows_by_key():
    rng = np.random.default_rng(2)
    keys, rows = (300 * rng.random(4000) ** 4).astype(np.uint16), rng.random((4000, 16)).astype(np.float32)
    found, sums = lm_score.summed(rows, keys)
    assert sorted(found.tolist()) == sorted(set(keys.tolist()))
    assert sums == pytest.approx(np.stack([rows[keys == k].sum(axis=0) for k in found]), rel=1e-4)


def test_both_sides_tell_words_of_a_class(spark):
    filler = " ".join(f"f{k}" for k in range(lm_score.SINGLE)) + " "
    rows = [(i, filler * 2 + " ".join(f"{('east', 'west')[k % 2]} t{k:03} {('north', 'south')[k % 2]}" for k in range(i % 7, 160, 7)) + " " + filler) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    blocks = common.cut(lm_score.blocks(docs))
    vocab = lm_score.learnt_words(blocks)
    tree = lm_score.Tree.of(vocab)
    numbered = common.cut(lm_score.numbered(blocks, vocab.frequent))
    net = lm_score.train(numbered, vocab, tree=tree)
    at = {w: i for i, w in enumerate(vocab.frequent)}
    pairs = [(f"t{k:03}", f"t{k + 1:03}") for k in range(0, 160, 2) if vocab.of_class[at[f"t{k:03}"]] == vocab.of_class[at[f"t{k + 1:03}"]] >= lm_score.SINGLE]
    assert len(pairs) > 20
    context = [at[w] for w in ("south", "east", "north", "west")]
    gain = [np.subtract(*scored(vocab, tree, net, context, [at[mine], at[other]])) for mine, other in pairs]
    fixed = [np.subtract(*scored(vocab, None, net, context, [at[mine], at[other]])) for mine, other in pairs]
    assert np.mean(gain) > 0.5 and np.abs(fixed).max() < 0.1  # the shares of a class do not tell them
    got = {r.doc_id: (r.n_tokens, r.pll) for r in lm_score.pseudo_likelihood(docs).collect()}
    plain = {r.doc_id: r.pll for r in lm_score.scores(numbered, lm_score.train(numbered, vocab), vocab).collect()}
    assert all(got[i][0] == len(t.split()) for i, t in rows) and sum(x for _, x in got.values()) > sum(plain.values()) + 0.2 * 70 * 700 / 7


def test_texts_are_cut_into_words_once(spark, odd_docs):
    got = {(r.doc_id, bytes(r.ids)) for r in lm_score.with_tokens(odd_docs, ["the", "cat"]).collect()}
    tokens = lm_score.Tokens(["the", "cat"])
    assert got == {(r.doc_id, tokens.of(r.text)) for r in odd_docs.select("doc_id", "text").collect()}
    assert {r.word: r.n for r in lm_score.word_counts(lm_score.blocks(odd_docs)).collect()}["perro"] == 4000


def test_a_step_looks_up_each_token_once_and_is_that_of_all_places():
    rng, vocab, tree, net = small()
    texts = [rng.integers(0, 300, k).astype(np.uint16) for k in (700, 0, 1, 2, 0, 0, 5, 900)]
    texts[3][:] = lm_score.WORDS + 7
    tokens, own, _ = lm_score.joined([t.tobytes() for t in texts])
    looked_up = lm_score.Stretch.of(net, tokens, own)
    assert len(looked_up.embedded) <= len(tokens)  # not once for each of the places it stands at
    learner = lm_score.Learner(net, vocab, tree)
    learner.learn(tokens, own)
    words = tokens[own]
    loss, touched, de, rest, nodes, dn = lm_score._gradients(net, np.stack([tokens[own + p] for p in lm_score.PLACES]), vocab.of_class[words], tree, words)
    rows, seen = net.rows.copy(), np.zeros(len(net.rows))
    for where, g in ((touched, de), (np.arange(lm_score.EDGE + 1, lm_score.NODES), rest), (lm_score.NODES + nodes, dn)):
        rows[where] -= lm_score.RATE * g / np.sqrt(1e-3 + (g * g).mean(axis=1, keepdims=True))
        seen[where] = 1
    seen[lm_score.EDGE + 1 : lm_score.NODES] = len(own)
    assert learner.loss == pytest.approx(loss, rel=1e-5) and (learner.seen == seen).all() and np.abs(learner.net.rows - rows).max() < 1e-4
    assert sorted(set(nodes.tolist())) == sorted({int(n) for w in set(words.tolist()) for n in tree.nodes[tree.first[w] : tree.first[w] + tree.depth[w]]})


@pytest.mark.parametrize("scale", [1, 400])
def test_scores_node_by_node(scale):
    """Ways over upper and other nodes, and logits too large for powers of e."""
    rng, vocab, tree, net = small()
    net.rows[lm_score.EDGE + 1 + 2 * lm_score.REACH + 1 : lm_score.NODES] *= scale
    words = np.r_[np.arange(300), np.arange(lm_score.WORDS, lm_score.EDGE, 9)]
    context = rng.integers(0, 300, 4)
    e, _, _, o, c = (p.astype(np.float64) for p in net.parts())
    h = np.tanh(sum(e[t] * s for t, s in zip(context, net.parts()[1], strict=True)) + net.parts()[2])
    z = o @ h + c
    far = 0
    for w, got in zip(words, scored(vocab, tree, net, context, words), strict=True):
        way = slice(tree.first[w], tree.first[w] + tree.depth[w])
        far += tree.near[w] < tree.depth[w]
        own = z[vocab.of_class[w]] - z.max() - np.log(np.exp(z - z.max()).sum()) + vocab.even[w]
        assert got == pytest.approx(own - np.log1p(np.exp(-(tree.signs[way] * (net.nodes()[tree.nodes[way]] @ h) + tree.odds[way]))).sum(), rel=1e-4, abs=1e-3)
    assert far > 100


def test_words_of_many_texts_are_those_of_each():
    texts = ["a\x1cb\x85c\xa0d E　f", "  X\t\ny\x0b\x0c ", "", "   ", None, "　 ", "İSTANBUL ΣΑΣ ẞ", "A\x00B c", "Plain  ASCII\nText", "᠎a​b"]
    for own in (texts, texts[1:], texts[2:3], [None], [], texts[8:]):
        for rows in (pa.array(own, pa.string()), pa.array(["É x", *own], pa.string()).slice(1)):
            words, n = lm_score.split_words(rows)
            assert words.to_pylist() == [w for t in own for w in lm_score.words_of(t)] and n.tolist() == [len(lm_score.words_of(t)) for t in own]
    words = ["a", "", "xyzß", "日本語テ", "😀😀😀😀", "the"]
    assert lm_score.endings_of(pa.array(words)).to_pylist() == list(map(lm_score.ending, words))
