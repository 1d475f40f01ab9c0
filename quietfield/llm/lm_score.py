"""Masked pseudo-likelihood scores from a bidirectional window network.

Words are tokens. The `WORDS` most frequent ones of the corpus have an embedding each; a rarer one has that of its ending,
of which there are `ENDINGS`. The network sees `REACH` tokens on each side and predicts the one between: the embeddings,
scaled by place, are summed into a hidden layer, and a hierarchical softmax gives the token: a softmax its class, then a
binary decision at each node on the way down the class's Huffman tree the token itself. The most frequent words are classes
of their own; other words share classes of like frequency, endings classes of endings. Every decision is made by the hidden
layer, so both sides tell each of the `WORDS` words and `ENDINGS` endings from all others; before training a node decides
by the tokens below it in the whole corpus. Only words too rare for an embedding have even parts of their ending. A
document's score is the sum over its tokens of their log-probabilities given both sides.

Without a tree the same functions stop at classes, within which words have fixed shares (`Vocabulary.within`).

Training covers every token of every document. In each of `ROUNDS` rounds the documents of that round are learnt where they
lie: a task runs stochastic gradients in numpy from the common weights and returns the rows of weights that it has touched,
with the number of tokens behind each; Spark adds them up by row, and the driver gets the means, a table of a size fixed by
the network. What is gathered grows with the corpus: counts of every distinct word, and each task's rows."""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS, ENDINGS, REACH, HIDDEN = 15_360, 1023, 2, 16
#: Classes: words of their own, groups of words, groups of rare words by ending.
SINGLE, GROUPS, RARE = 40, 16, 8
CLASSES = SINGLE + GROUPS + RARE
EDGE = WORDS + ENDINGS
ROUNDS, BATCH, RATE = 2, 4096, 0.1
#: Words whose logits are worked out together, so that they stay in a core's cache.
_CHUNK = 1024
#: Nodes of a class, the heaviest ones, whose logits are worked out for all its words at once.
TOP = 32
#: Logits of no greater size can be raised to powers of e as they are.
_SAFE = 80
#: White space of str.split() beyond that of ASCII.
_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words whose tokens are kept. Texts that are cut into words at once. A block of documents takes no further ones beyond so many words.
_HELD, _TEXTS, _LONG = 200_000, 256, 1_000_000


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of many texts at once: (the words of all texts behind each other, how many each text has)."""
    lower = pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))  # a slice would go through what lies around it
    other = np.ones(len(texts), bool)
    if not _controls(lower):
        other = ~pc.string_is_ascii(lower).fill_null(True).to_numpy(zero_copy_only=False)
    if other.any():
        own = [_spaced((t or "").lower()) for t in texts.filter(pa.array(other)).to_pylist()]
        at = np.argsort(np.argsort(other, kind="stable"), kind="stable")
        lower = pa.concat_arrays([lower.filter(pa.array(~other)), pa.array(own, pa.string())]).take(pa.array(at))
    lower = pc.ascii_trim_whitespace(lower)
    split = pc.ascii_split_whitespace(lower)
    words, n = split.flatten(), split.value_lengths().fill_null(0).to_numpy()
    empty = pc.equal(lower, "").fill_null(False).to_numpy(zero_copy_only=False)
    if empty.any():  # these are split into one empty word
        words, n = words.filter(pc.not_equal(words, "")), np.where(empty, 0, n)
    return words, n


def _controls(texts: pa.Array) -> bool:
    """Whether a text has one of the four control characters that str.split() takes for white space and ASCII functions do not."""
    data = texts.buffers()[2]
    x = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return bool((x - np.uint8(0x1C) < 4).any())  # smaller numbers wrap around


def _spaced(text: str) -> str:
    """The text with a space for white space of str.split() that ASCII functions do not take for such."""
    for c in _SPACES[:4] if text.isascii() else _SPACES:
        if c in text:
            text = text.replace(c, " ")
    return text


def ending(word: str) -> int:
    return zlib.crc32(word[-3:].encode("utf-8", "replace")) % ENDINGS


def endings_of(words: pa.Array) -> pa.Array:
    """ending() of many words, worked out once for each different one."""
    found = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    return pa.array(list(map(ending, found.dictionary.to_pylist())), pa.int32()).take(found.indices)


class Tokens(dict):
    """Token of each word, worked out once for each word and emptied when it is full."""

    def __init__(self, frequent: list[str]):
        self.frequent = {w: i for i, w in enumerate(frequent)}
        super().__init__(self.frequent)

    def __missing__(self, word: str) -> int:
        if len(self) > _HELD:
            self.clear()
            self.update(self.frequent)
        found = self[word] = WORDS + ending(word)
        return found

    def of(self, text: str | None) -> bytes:
        """Tokens of a whole text as 16-bit numbers."""
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.uint16, len(words)).tobytes()


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts with REACH edges before, between and after, places of the texts' own tokens in order, number in each)."""
    n = np.array([len(x) // 2 for x in ids], np.int64)
    edge = np.full(REACH, EDGE, np.uint16).tobytes()
    tokens = np.frombuffer(edge.join([b"", *ids, b""]), np.uint16)
    return tokens, np.arange(n.sum()) + np.repeat(REACH * np.arange(1, len(ids) + 1), n), n


@dataclass
class Vocabulary:
    """The frequent words, each token's class, and its log-probability within it by corpus shares alone; how often each token
    occurs, and the log-probability of a word within its token: 0, or an even part of the words of an ending."""

    frequent: list[str]
    of_class: np.ndarray
    within: np.ndarray
    prior: np.ndarray
    counts: np.ndarray
    even: np.ndarray

    def ranks(self) -> np.ndarray:
        """The place of each token in the order of classes and, within one, of tokens."""
        out = np.empty(EDGE + 1, np.uint16)
        out[np.argsort(self.of_class, kind="stable")] = np.arange(EDGE + 1)
        return out

    @classmethod
    def of(cls, frequent: list[tuple[str, int]], endings: dict[int, tuple[int, int]]) -> Vocabulary:
        """frequent: words with counts, most frequent first. endings: of each ending of rare words (tokens, different words)."""
        n = np.zeros(EDGE + 1)
        n[: len(frequent)] = [c for _, c in frequent]
        group = np.zeros(EDGE + 1, np.int64)
        single = min(SINGLE, len(frequent))
        group[:single] = np.arange(single)
        tail = n[SINGLE : len(frequent)]
        if len(tail):  # groups of about the same number of tokens
            group[SINGLE : len(frequent)] = SINGLE + np.minimum(GROUPS - 1, (np.cumsum(tail) - tail) * GROUPS // max(tail.sum(), 1)).astype(np.int64)
        group[WORDS:EDGE] = SINGLE + GROUPS + np.arange(ENDINGS) % RARE
        total = np.bincount(group[: len(frequent)], n[: len(frequent)], CLASSES)
        within = np.zeros(EDGE + 1)
        within[: len(frequent)] = np.log(n[: len(frequent)] / np.maximum(total[group[: len(frequent)]], 1))
        even, different = np.zeros(EDGE + 1), np.zeros(RARE, np.int64)
        for k, (tokens, words) in endings.items():
            total[SINGLE + GROUPS + k % RARE] += tokens
            different[k % RARE] += words
            n[WORDS + k], even[WORDS + k] = tokens, -np.log(words)
        within[WORDS:EDGE] = -np.log(np.maximum(different, 1))[np.arange(ENDINGS) % RARE]
        prior = np.log((total + 1) / (total.sum() + CLASSES))
        return cls([w for w, _ in frequent], group, within.astype(np.float32), prior.astype(np.float32), n, even.astype(np.float32))


@dataclass
class Tree:
    """A Huffman tree in each class. A token's way is steps[first[t] : first[t] + depth[t]], from the class to the token: nodes
    and signs (1 or -1: which of its two sides). odds: by step, log of the tokens on the side that it takes to those on the other. n: nodes.

    A class's nodes lie behind each other, lighter ones first, so that the last TOP, from top[c] to last[c], are the upper end
    of its tree: near[t] steps of a way are at these, before all others; columns: by step, the place among them."""

    first: np.ndarray
    depth: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray
    odds: np.ndarray
    n: int
    top: np.ndarray
    last: np.ndarray
    near: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, vocab: Vocabulary) -> Tree:
        ways: list[list[tuple[int, int]]] = [[] for _ in range(EDGE + 1)]
        odds: list[float] = []
        bounds = [0]
        tokens = np.r_[np.arange(len(vocab.frequent)), np.arange(WORDS, EDGE)]
        for c in range(CLASSES):
            heap = [(max(float(vocab.counts[t]), 0.5), int(t), [int(t)]) for t in tokens[vocab.of_class[tokens] == c]]
            heapq.heapify(heap)
            while len(heap) > 1:
                (x, k, left), (y, j, right) = heapq.heappop(heap), heapq.heappop(heap)
                for side, sign in ((left, 1), (right, -1)):
                    for t in side:
                        ways[t].append((len(odds), sign))
                odds.append(float(np.log(x / y)))
                heapq.heappush(heap, (x + y, min(k, j), left + right))
            bounds.append(len(odds))
        depth = np.array(list(map(len, ways)), np.int64)
        steps = np.array([s for w in ways for s in w[::-1]], np.int64).reshape(-1, 2)
        nodes, signs = steps[:, 0], steps[:, 1].astype(np.float32)
        last = np.array(bounds[1:])
        top = np.maximum(bounds[:-1], last - TOP)
        columns = nodes - np.repeat(top[vocab.of_class], depth)
        ends = np.cumsum(depth)
        held = np.r_[0, np.cumsum(columns >= 0)]
        odds_of = np.array(odds, np.float32)[nodes] * signs
        return cls(ends - depth, depth, nodes.astype(np.uint16), signs, odds_of, len(odds), top, last, held[ends] - held[ends - depth], columns.astype(np.int16))

    def near_steps(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the targets' steps at upper nodes, target by target; number of each one's)."""
        n = self.near.take(target)
        return np.arange(n.sum()) + np.repeat(self.first.take(target) - (np.cumsum(n) - n), n), n

    def far_steps(self, target: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
        """(targets that have steps at other nodes, those with most first; how many of them take a first one, a second and so on;
        the steps, those of all first ones before all second ones)."""
        n = (self.depth - self.near).take(target)
        order = np.argsort((-n).astype(np.int8), kind="stable")[: np.count_nonzero(n)]
        own = target.take(order)
        at = (self.first + self.near).take(own)
        taking = (len(target) - np.cumsum(np.bincount(n)))[:-1].tolist()
        return order, taking, np.concatenate([at[:m] + k for k, m in enumerate(taking)] or [at[:0]])


#: Rows of a network before those of its nodes.
NODES = EDGE + 1 + 2 * REACH + 1 + CLASSES + CLASSES // HIDDEN


@dataclass
class Network:
    """All weights as rows of HIDDEN numbers: embeddings, scales of places, the hidden bias, the classes' rows and biases, and the nodes of a tree."""

    rows: np.ndarray

    @classmethod
    def new(cls, prior: np.ndarray, seed: int = 11, nodes: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        n = EDGE + 1
        rows = np.concatenate([rng.normal(0, 0.3, (n, HIDDEN)), np.ones((2 * REACH, HIDDEN)), np.zeros((1, HIDDEN)), rng.normal(0, 0.1, (CLASSES, HIDDEN)), prior.reshape(-1, HIDDEN), np.zeros((nodes, HIDDEN))])
        return cls(rows.astype(np.float32))

    def parts(self) -> tuple[np.ndarray, ...]:
        """Views: embeddings, scales, hidden bias, classes' rows, classes' biases."""
        cuts = list(accumulate([EDGE + 1, 2 * REACH, 1, CLASSES]))
        e, s, b, o, c = (self.rows[x:y] for x, y in zip([0, *cuts], [*cuts, NODES], strict=True))
        return e, s, b[0], o, c.reshape(-1)

    def nodes(self) -> np.ndarray:
        return self.rows[NODES:]

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        """The hidden layer for what stands at each place: embeddings (n, HIDDEN), not scaled yet."""
        _, s, b, _, _ = self.parts()
        h = around[0] * s[0]
        for x, scale in zip(around[1:], s[1:], strict=True):
            h += x * scale
        h += b
        return np.tanh(h, out=h)

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Logits of every class less their largest, a row for each of h."""
        _, _, _, o, c = self.parts()
        z = h @ o.T + c
        z -= z.max(axis=1, keepdims=True)
        return z

    def powers(self, h: np.ndarray, target: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """By _CHUNK rows of h, which have a last column of 1: where they are, e to the logit of every class, a row for each; sums of rows, logits
        of the targets. Where logits may be too large for that, they are taken less each row's largest."""
        _, _, _, o, c = self.parts()
        safe, both, one = (np.abs(o).sum(axis=1) + np.abs(c)).max() < _SAFE, np.column_stack([o, c]).T, np.ones(CLASSES, h.dtype)
        for k in range(0, len(h), _CHUNK):
            at = slice(k, k + _CHUNK)
            z = h[at] @ both if safe else self.logits(h[at, :HIDDEN])
            own = z[np.arange(len(z)), target[at]]
            np.exp(z, out=z)
            yield at, z, z @ one, own


class Decisions:
    """The steps down a tree of words in the order of their classes: for each its logit, first at upper nodes, where a class's
    words are worked out together, then at others."""

    def __init__(self, net: Network, tree: Tree, h: np.ndarray, target: np.ndarray, words: np.ndarray):
        self.tree, self.h, self.rows = tree, h, net.nodes()
        ends = np.searchsorted(target, np.arange(CLASSES + 1)).tolist()
        self.spans = [(x, y, i, j) for x, y, i, j in zip(ends, ends[1:], tree.top.tolist(), tree.last.tolist(), strict=False) if y > x and j > i]
        near, self.n = tree.near_steps(words)
        self.at = np.repeat(np.arange(0, TOP * len(words), TOP), self.n) + tree.columns.take(near)
        upper = np.empty((len(words), TOP), h.dtype)
        for x, y, i, j in self.spans:
            np.matmul(h[x:y], self.rows[i:j].T, out=upper[x:y, : j - i])
        self.order, self.taking, far = tree.far_steps(words)
        own = h.take(self.order, axis=0)
        self.far_h = np.concatenate([own[:m] for m in self.taking] or [own[:0]])
        self.far_nodes = tree.nodes.take(far)
        self.weights = self.rows.take(self.far_nodes, axis=0)
        steps = np.concatenate([near, far])
        self.signs, self.near_nodes = tree.signs.take(steps), tree.nodes.take(near)
        self.logit = np.concatenate([upper.reshape(-1).take(self.at), np.einsum("ij,ij->i", self.weights, self.far_h)])
        self.logit *= self.signs
        self.logit += tree.odds.take(steps)

    def lost(self) -> np.ndarray:
        """The sum over each word's steps of minus their log-probabilities."""
        each = np.log1p(np.exp(-self.logit))
        m = len(self.at)
        sums = np.r_[0, np.cumsum(each[:m], dtype=np.float64)]
        ends = np.cumsum(self.n)
        out, first = sums[ends] - sums[ends - self.n], m
        below = np.zeros(len(self.order))
        for m in self.taking:
            below[:m] += each[first : first + m]
            first += m
        out[self.order] += below
        return out

    def back(self, dh: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-loss, nodes touched, their gradients); what reaches h is added to dh."""
        e = np.exp(-self.logit)
        loss = float(np.log1p(e).sum())
        g = self.signs * (1 / (1 + e) - 1)
        m = len(self.at)
        upper = np.zeros((len(self.h), TOP), self.h.dtype)
        upper.reshape(-1)[self.at] = g[:m]
        sums = np.empty((self.tree.n, HIDDEN), self.h.dtype)
        for x, y, i, j in self.spans:
            own = upper[x:y, : j - i]
            dh[x:y] += own @ self.rows[i:j]
            np.matmul(own.T, self.h[x:y], out=sums[i:j])
        far = g[m:, None]
        self.weights *= far
        self.far_h *= far
        below, first = np.zeros((len(self.order), HIDDEN), dh.dtype), 0
        for m in self.taking:
            below[:m] += self.weights[first : first + m]
            first += m
        dh[self.order] += below
        met = np.zeros(self.tree.n, bool)
        met[self.near_nodes] = True
        near = np.flatnonzero(met)
        touched, dn = summed(self.far_h, self.far_nodes)
        return loss, np.concatenate([near, touched.astype(np.int64)]), np.concatenate([sums.take(near, axis=0), dn])


PLACES = [k for k in range(-REACH, REACH + 1) if k]


def summed(rows: np.ndarray, keys: np.ndarray, turns: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, the sum of the rows of each). The first rows of all keys are added in turns, what is left of frequent keys by reduceat."""
    if not len(keys):
        return keys, rows
    order = np.argsort(keys, kind="stable")  # 16-bit numbers sort fast
    ordered = keys.take(order)
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    n = np.diff(np.r_[first, len(keys)])
    most = np.argsort(-np.minimum(n, turns + 1).astype(np.int8), kind="stable")
    first, n = first[most], n[most]
    out = rows.take(order[first], axis=0)
    for k in range(1, turns):
        m = int(np.count_nonzero(n > k))
        out[:m] += rows.take(order.take(first[:m] + k), axis=0)
    m = int(np.count_nonzero(n > turns))
    if m:
        left = n[:m] - turns
        ends = np.cumsum(left)
        rest = rows.take(order.take(np.arange(ends[-1]) + np.repeat(first[:m] + turns - (ends - left), left)), axis=0)
        out[:m] += np.add.reduceat(rest.view(np.complex64), ends - left).view(np.float32)  # two columns at once
    return ordered[first], out


def gradients(net: Network, context: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-loss, embeddings touched, their gradients, gradients of all rows between embeddings and nodes), summed over a batch.

    context: tokens (2 * REACH, n), a row for each place. target: classes."""
    return _gradients(net, context, target, None, None)[:4]


def _gradients(net: Network, context: np.ndarray, target: np.ndarray, tree: Tree | None, words: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gradients(), of the words' whole ways with a tree; then the nodes touched and their gradients."""
    order = np.argsort(target, kind="stable")
    s = net.parts()[1]
    around = [net.parts()[0].take(c, axis=0) for c in context[:, order]]
    h = net.hidden(around)
    loss, dh, rest, nodes, dn = _errors(net, h, target[order], tree, None if words is None else words[order])
    touched, de = summed(np.concatenate([dh * scale for scale in s]), context[:, order].ravel())
    ds = np.stack([np.einsum("ij,ij->j", x, dh) for x in around])
    return loss, touched, de, np.concatenate([ds, rest]), nodes, dn


def _errors(net: Network, h: np.ndarray, target: np.ndarray, tree: Tree | None, words: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-loss, gradients before the hidden layer's tanh, gradients of all rows behind the scales and before the nodes, nodes
    touched, their gradients) for targets in the order of classes."""
    o = net.parts()[3]
    h1 = np.column_stack([h, np.ones(len(h), h.dtype)])
    dh, do, loss = np.empty_like(h), np.zeros((CLASSES, HIDDEN + 1), h.dtype), 0.0
    for at, z, total, logit in net.powers(h1, target):
        loss += float(np.log(total).sum() - logit.sum())
        z[np.arange(len(z)), target[at]] -= total
        part = (1 / total)[:, None]
        np.multiply(z @ o, part, out=dh[at])
        do += z.T @ (h1[at] * part)
    nodes, dn = np.zeros(0, np.int64), h[:0]
    if tree is not None:
        below, nodes, dn = Decisions(net, tree, h, target, words).back(dh)
        loss += below
    dh *= 1 - h * h
    return loss, dh, np.concatenate([np.ones(len(h), h.dtype)[None] @ dh, do[:, :HIDDEN], do[:, HIDDEN].reshape(-1, HIDDEN)]), nodes, dn


@dataclass
class Stretch:
    """Tokens behind each other and which of them are predicted. Embeddings are looked up once for each token, not for each place that it stands at."""

    tokens: np.ndarray
    own: np.ndarray
    embedded: np.ndarray

    @classmethod
    def of(cls, net: Network, tokens: np.ndarray, own: np.ndarray) -> Stretch:
        """own: ascending."""
        first = own[0] - REACH
        tokens = tokens[first : own[-1] + REACH + 1]
        return cls(tokens, own - own[0], net.parts()[0].take(tokens, axis=0))

    def around(self) -> list[np.ndarray]:
        """What stands at each place around all tokens but REACH at both ends."""
        n = len(self.tokens) - 2 * REACH
        return [self.embedded[REACH + p : REACH + p + n] for p in PLACES]

    def back(self, scales: np.ndarray, at: np.ndarray, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embeddings touched, their gradients, gradients of the scales), of gradients dh for the tokens `at`."""
        n = len(self.tokens) - 2 * REACH
        each = np.zeros((n, HIDDEN), dh.dtype)
        each[at] = dh
        predicted, beside = np.zeros(n, bool), np.zeros(len(self.tokens), bool)
        predicted[at] = True
        de, one = np.zeros((len(self.tokens), HIDDEN), dh.dtype), np.ones(n, dh.dtype)
        ds = []
        for p, scale, x in zip(PLACES, scales, self.around(), strict=True):
            de[REACH + p : REACH + p + n] += each * scale
            beside[REACH + p : REACH + p + n] |= predicted
            ds.append(one @ (x * each))
        if beside.all():
            return *summed(de, self.tokens), np.stack(ds)
        return *summed(de[beside], self.tokens[beside]), np.stack(ds)


class Learner:
    """Stochastic gradients with steps scaled by each row's own history."""

    def __init__(self, net: Network, vocabulary: Vocabulary, tree: Tree | None = None):
        self.net, self.vocabulary, self.tree = Network(net.rows.copy()), vocabulary, tree
        self.ranks = vocabulary.ranks()
        self.seen, self.size = np.zeros(len(net.rows)), np.full(len(net.rows), 1e-3)
        self.loss = 0.0

    def learn(self, tokens: np.ndarray, own: np.ndarray) -> None:
        rows, n = self.net.rows, EDGE + 1
        for at in range(0, len(own), BATCH):
            middle = own[at : at + BATCH]
            stretch = Stretch.of(self.net, tokens, middle)
            words = tokens[middle]
            order = np.argsort(self.ranks[words], kind="stable")  # 16-bit numbers sort fast
            places, words = stretch.own[order], words[order]
            h = self.net.hidden(stretch.around()).take(places, axis=0)
            loss, dh, rest, nodes, dn = _errors(self.net, h, self.vocabulary.of_class[words], self.tree, words)
            touched, de, ds = stretch.back(self.net.parts()[1], places, dh)
            rest = np.concatenate([ds, rest])
            self.loss += loss
            nodes = nodes + NODES
            for where, g in ((touched.astype(np.int64), de), (slice(n, NODES), rest), (nodes, dn)):
                size = self.size[where] + np.einsum("ij,ij->i", g, g) / HIDDEN
                self.size[where] = size
                g *= (-RATE / np.sqrt(size)).astype(np.float32)[:, None]
                g += rows[where] if isinstance(where, slice) else rows.take(where, axis=0)
                rows[where] = g
            self.seen[n:NODES] += len(middle)
            self.seen[touched] += 1
            self.seen[nodes] += 1


class Scorer:
    """Scores tokens by a network."""

    def __init__(self, net: Network, vocabulary: Vocabulary, tree: Tree | None = None):
        self.net, self.vocabulary, self.tree = net, vocabulary, tree
        self.ranks = vocabulary.ranks()

    def scores(self, tokens: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log-probability of each of the tokens at `own`, ascending, given both sides."""
        out = np.zeros(len(own))
        for at in range(0, len(own), BATCH):
            middle = own[at : at + BATCH]
            stretch = Stretch.of(self.net, tokens, middle)
            words = tokens[middle]
            order = np.argsort(self.ranks[words], kind="stable")
            words = words[order]
            target = self.vocabulary.of_class[words]
            h = self.net.hidden(stretch.around()).take(stretch.own[order], axis=0)
            h1, found = np.column_stack([h, np.ones(len(h), h.dtype)]), np.empty(len(h))
            for part, _, total, logit in self.net.powers(h1, target):
                found[part] = logit - np.log(total)
            if self.tree is None:
                found += self.vocabulary.within[words]
            else:
                found += self.vocabulary.even[words] - Decisions(self.net, self.tree, h, target, words).lost()
            out[at + order] = found
        return out


BLOCKS = "ids array<long>, sizes array<int>, local binary, words array<string>, counts array<long>, endings array<int>"


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for a run of documents of a task: their ids and numbers of words; their words as 32-bit numbers into the block's
    own table of different words, with how often each occurs and its ending. Texts are cut into words once, here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts = [], [], []

        def block() -> pa.RecordBatch:
            found = pa.concat_arrays(parts).dictionary_encode()
            words, local = found.dictionary.cast(pa.string()), found.indices.to_numpy()
            lists = pa.concat_arrays(ids), pa.array(np.concatenate(sizes), pa.int32()), words, pa.array(np.bincount(local, minlength=len(words))), endings_of(words)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays([*columns[:2], pa.array([local.tobytes()], pa.binary()), *columns[2:]], names=["ids", "sizes", "local", "words", "counts", "endings"])

        n = 0
        for b in batches:
            for at in range(0, b.num_rows, _TEXTS):
                words, each = split_words(b.column(1).slice(at, _TEXTS))
                ids.append(b.column(0).slice(at, _TEXTS))
                sizes.append(each)
                parts.append(words)
                n += len(words)
                if n > _LONG:
                    yield block()
                    ids, sizes, parts, n = [], [], [], 0
        if ids:
            yield block()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, BLOCKS)


def word_counts(cut_blocks: DataFrame) -> DataFrame:
    """(word, n, ending) of all texts. Blocks have counted their own words before these are shuffled."""
    each = cut_blocks.select(F.explode(F.arrays_zip("words", "counts", "endings")).alias("x")).select("x.*")
    return each.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("n"), F.first("endings").alias("ending"))


def vocabulary(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> Vocabulary:
    """The vocabulary of docs; see learnt_words."""
    return learnt_words(blocks(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))), words)


def learnt_words(cut_blocks: DataFrame, words: int = WORDS) -> Vocabulary:
    """The frequent words, ties in the order of the words, and sums over all others by ending. At most WORDS + ENDINGS rows reach the driver."""
    counted = cut(word_counts(cut_blocks))
    top = counted.orderBy(F.desc("n"), "word").limit(words).collect()
    frequent = [(r.word, r.n) for r in top]
    endings = {}
    if len(frequent) == words:
        word, n = frequent[-1]
        others = counted.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > F.lit(word))))
        endings = {r.ending: (r.tokens, r.words) for r in others.groupBy("ending").agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect()}
    return Vocabulary.of(frequent, endings)


def with_tokens(docs: DataFrame, frequent: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row: its text's tokens as 16-bit numbers."""
    return numbered(blocks(docs, id_col, text_col), frequent, id_col)


def numbered(cut_blocks: DataFrame, frequent: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, ids) for each document of blocks: its tokens as 16-bit numbers, looked up once for each different word of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(frequent, pa.string())
        for b in batches:
            for k in range(b.num_rows):
                ids, sizes, local, words, endings = (b.column(c)[k] for c in range(5))
                found = pc.index_in(words.values, known).fill_null(-1).to_numpy()
                found = np.where(found < 0, WORDS + endings.values.to_numpy(), found).astype(np.uint16)
                tokens = found[np.frombuffer(local.as_buffer(), np.int32)].tobytes()
                ends = np.cumsum(2 * sizes.values.to_numpy()).tolist()
                each = [tokens[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                for at in range(0, len(each), 256):
                    yield pa.RecordBatch.from_arrays([ids.values.slice(at, 256), pa.array(each[at : at + 256], pa.binary())], names=[id_col, "ids"])

    return cut_blocks.select("ids", "sizes", "local", "words", "endings").mapInArrow(run, f"`{id_col}` long, ids binary")


def learnt_round(rows: DataFrame, net: Network, vocab: Vocabulary, number: int, rounds: int = ROUNDS, tree: Tree | None = None) -> Network:
    """The mean of what tasks learn from their rows of this round (with `ids`), each row of weights weighed by the tokens that moved it."""
    packed = pickle.dumps((net, vocab, tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, k = Learner(*pickle.loads(packed)), number
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.column(0).slice(at, 64).to_pylist()
                learner.learn(*joined([t for i, t in enumerate(part, k) if i % rounds == 0])[:2])
                k += len(part)
        moved = np.flatnonzero(learner.seen)
        for at in range(0, len(moved), 5000):
            moved_rows = moved[at : at + 5000]
            values = [pa.array(c) for c in learner.net.rows[moved_rows].T]
            yield pa.RecordBatch.from_arrays([pa.array(moved_rows.astype(np.int32)), pa.array(learner.seen[moved_rows].astype(np.float32)), *values], names=["row", "seen", *names])

    names = [f"c{k}" for k in range(HIDDEN)]
    sent = rows.select("ids").mapInArrow(run, f"row int, seen float, {', '.join(f'{n} float' for n in names)}")
    means = sent.groupBy("row").agg(*[(F.sum(F.col(n) * F.col("seen").cast("double")) / F.sum(F.col("seen").cast("double"))).cast("float").alias(n) for n in names]).toArrow()
    out = net.rows.copy()
    if means.num_rows:
        out[means.column("row").to_numpy()] = np.column_stack([means.column(n).to_numpy() for n in names])
    return Network(out)


@lru_cache(maxsize=2)
def _scorer(packed: bytes) -> Scorer:
    return Scorer(*pickle.loads(packed))


def scores(rows: DataFrame, net: Network, vocab: Vocabulary, id_col: str = "doc_id", tree: Tree | None = None) -> DataFrame:
    """(id, n_tokens, pll, pll_mean) for each of with_tokens' rows: sum and mean of the log-probabilities of its tokens.

    A text without words, or null, has 0 tokens, a sum of 0 and no mean. Texts are scored whole; repeated rows score alike."""
    packed = pickle.dumps((net, vocab, tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(packed)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                tokens, own, n = joined(part.column(1).to_pylist())
                found = scorer.scores(tokens, own)
                total = np.array([float(found[e - k : e].sum()) for e, k in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)], names=[id_col, "n_tokens", "pll", "pll_mean"])

    return rows.select(id_col, "ids").mapInArrow(run, f"`{id_col}` long, n_tokens long, pll double, pll_mean double")


def train(rows: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, tree: Tree | None = None) -> Network:
    """A network trained on all of with_tokens' rows, a written table: every row in one of the rounds. No rows leave it untrained."""
    net = Network.new(vocab.prior, nodes=0 if tree is None else tree.n)
    for k in range(rounds):
        net = learnt_round(rows, net, vocab, k, rounds, tree)
    return net


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all of docs and score each of its rows. Texts are read once; null ids stay null, and an empty table scores nothing.

    Weights, and so scores, depend on how rows are dealt over tasks."""
    in_blocks = cut(blocks(docs, id_col, text_col))
    vocab = learnt_words(in_blocks)
    tree = Tree.of(vocab)
    rows = cut(numbered(in_blocks, vocab.frequent, id_col))
    return scores(rows, train(rows, vocab, tree=tree), vocab, id_col, tree)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Per document: its tokens and their summed and mean conditional log-probability."""
    return pseudo_likelihood(spark.read.parquet(f"{sf_dir}/documents.parquet"))
