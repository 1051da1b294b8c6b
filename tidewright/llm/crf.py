"""Linear-chain conditional random field over words, in numpy.

Words are runs of letters in lower case. Emissions are sums of hashed feature
weights (the word itself, prefixes, suffixes, character bigrams and trigrams);
transitions are learned with them by gradient steps on the log-likelihood.

Forward-backward runs over all texts of a slice at once: each text is cut into
blocks, every block's transfer matrix is computed in parallel, the matrices
are chained along each text, and the messages inside the blocks follow from
their entry vectors. This is exact and takes BLOCK steps instead of one step
for each word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from tidewright.llm.pretoken import LETTER, class_table
from tidewright.llm.textkernel import RunHasher, code_table, codes, mix, ragged, runs

BLOCK = 96
PREFIXES = (1, 2, 3, 4, 5, 6)
SUFFIXES = (1, 2, 3, 4)
_lower: list[np.ndarray] = []


def lower_table() -> np.ndarray:
    """Each code point in lower case, where that is one code point."""
    if not _lower:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x1E960):
            if not 0xD800 <= c < 0xE000:
                x = chr(c).lower()
                if len(x) == 1:
                    table[c] = ord(x)
        _lower.append(table)
    return _lower[0]


@dataclass
class Words:
    """Words of some texts: code points, starts, ends, first word of each text, each text's first code point."""

    c: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    at: np.ndarray

    @property
    def count(self) -> int:
        return len(self.starts)


def letter_words(texts: list[str]) -> Words:
    c, at = codes(texts)
    starts, ends = runs(class_table()[c] == LETTER)
    return Words(lower_table()[c], starts, ends, np.searchsorted(starts, at), at)


def different(w: Words) -> tuple[np.ndarray, Words]:
    """Place of each word among the different words, and these as one text; each is followed by a mark."""
    which, keys = pd.factorize(RunHasher(w.c)(w.starts, w.ends))
    one = np.zeros(len(keys), np.int64)
    one[which[::-1]] = np.arange(w.count - 1, -1, -1)
    length = w.ends[one] - w.starts[one]
    c = w.c[ragged(w.starts[one], length + 1)]
    ends = np.cumsum(length + 1) - 1
    return which, Words(c, ends - length, ends, np.array([0, len(keys)]), np.array([0, len(c)]))


def fixed_features(w: Words, bits: int) -> np.ndarray:
    """Indices of the word, prefix and suffix features; -1 where a word is too short. Shape: words, features."""
    length = w.ends - w.starts
    h = RunHasher(w.c)
    columns = [h(w.starts, w.ends) * np.uint64(3)]
    columns += [h(w.starts, np.minimum(w.starts + k, w.ends)) * np.uint64(5) for k in PREFIXES]
    columns += [h(np.maximum(w.ends - k, w.starts), w.ends) * np.uint64(7) for k in SUFFIXES]
    out = np.empty((w.count, len(columns)), np.int32)
    for j, x in enumerate(columns):
        out[:, j] = ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int32)
    for j, k in enumerate((*PREFIXES, *SUFFIXES), 1):
        out[length < k, j] = -1
    return out


def ngram_features(w: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the bigram and the trigram that start at each code point; 2**bits where they leave the word."""
    n = len(w.c)
    inside = np.zeros(n + 2, bool)
    inside[ragged(w.starts, w.ends - w.starts)] = True
    v = np.append(code_table()[w.c], np.zeros(2, np.uint64))
    none = np.int32(1 << bits)
    h2 = v[:n] * np.uint64(11) + v[1 : n + 1] * np.uint64(0x9E3779B97F4A7C15)
    h3 = h2 * np.uint64(13) + v[2 : n + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - bits)
    two = inside[:n] & inside[1 : n + 1]
    i2 = np.where(two, ((h2 ^ (h2 >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int32), none)
    i3 = np.where(two & inside[2 : n + 2], ((h3 ^ (h3 >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> shift).astype(np.int32), none)
    return i2, i3


@dataclass
class Crf:
    """weights: 2**bits + 1 rows (the last is zero), one column a label. trans: log-potentials."""

    bits: int
    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    trans: np.ndarray
    initial: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of each word and label; a repeated word is scored once."""
        which, w = different(words)
        return self.word_scores(w)[which]

    def word_scores(self, w: Words) -> np.ndarray:
        """Scores of each word and label, one by one."""
        fixed = fixed_features(w, self.bits)
        e = np.repeat(self.bias[None, :], w.count, 0)
        for j in range(fixed.shape[1]):
            e += self.weights[fixed[:, j]]
        if w.count:
            i2, i3 = ngram_features(w, self.bits)
            e += np.add.reduceat(self.weights[i2] + self.weights[i3], w.starts, axis=0)
        return e

    def marginals(self, w: Words) -> np.ndarray:
        """P(label | text) of each word by forward-backward."""
        return forward_backward(self.emissions(w), w.first, self.trans, self.initial)[0]


def new_crf(bits: int, labels: list[str]) -> Crf:
    n = len(labels)
    return Crf(bits, labels, np.zeros(((1 << bits) + 1, n), np.float32), np.zeros(n, np.float32), np.zeros((n, n)), np.zeros(n))


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word index of each cell (blocks x BLOCK; -1: none), each block's text, each text's first block, rank in the text."""
    sizes = np.diff(first)
    per = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), per)
    begin = np.cumsum(per) - per
    rank = np.arange(len(text)) - begin[text]
    cell = first[:-1][text][:, None] + rank[:, None] * BLOCK + np.arange(BLOCK)[None, :]
    cell[cell >= first[1:][text][:, None]] = -1
    return cell, text, begin, rank


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray, initial: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of each word, and the expected transitions if asked for. first: first word of each text, and the end."""
    n, k = e.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    t = np.exp(trans - trans.max())
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float64) + 1e-24
    heads = first[:-1][np.diff(first) > 0]
    x[heads] *= np.exp(initial - initial.max())
    cell, text, begin, rank = _blocks(first)
    nb = len(cell)
    live = cell >= 0
    is_head = np.zeros(n, bool)
    is_head[heads] = True
    head = live[:, 0] & is_head[np.maximum(cell[:, 0], 0)]
    xs = np.where(live[:, :, None], x[np.maximum(cell, 0)], 1.0)
    full = np.minimum(live.sum(1), BLOCK)
    width = int(full.max())
    # transfer matrix of each block
    p = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    many = int(np.bincount(text).max()) > 1
    if many:
        for j in range(width):
            q = (p.reshape(-1, k) @ t).reshape(nb, k, k)
            q = (q if j else np.where(head[:, None, None], p, q)) * xs[:, j, None, :]
            if j % 4 == 3:
                q /= q.max((1, 2), keepdims=True)
            p = np.where(live[:, j, None, None], q, p)
        p /= p.max((1, 2), keepdims=True)
    # entry vectors along each text, forwards and backwards
    ahead, behind = np.ones((nb, k)), np.ones((nb, k))
    if many:
        order = np.argsort(rank, kind="stable")
        cut = np.searchsorted(rank[order], np.arange(rank.max() + 2))
        for r in range(1, rank.max() + 1):
            b = order[cut[r] : cut[r + 1]]
            v = np.einsum("bi,bij->bj", ahead[b - 1], p[b - 1])
            ahead[b] = v / v.sum(1, keepdims=True)
        for r in range(rank.max(), 0, -1):
            b = order[cut[r] : cut[r + 1]]
            v = np.einsum("bij,bj->bi", p[b], behind[b])
            behind[b - 1] = v / v.sum(1, keepdims=True)
    alpha, beta = np.ones((nb, width, k)), np.ones((nb, width, k))
    v = ahead
    for j in range(width):
        u = (v @ t if j else np.where(head[:, None], v, v @ t)) * xs[:, j]
        if j % 4 == 3:
            u /= u.sum(1, keepdims=True)
        v = np.where(live[:, j, None], u, v)
        alpha[:, j] = v
    v = behind
    for j in range(width - 1, -1, -1):
        beta[:, j] = v
        u = (xs[:, j] * v) @ t.T
        if j % 4 == 0:
            u /= u.sum(1, keepdims=True)
        v = np.where(live[:, j, None], u, v)
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    out = np.empty((n, k))
    mask = live[:, :width]
    out[cell[:, :width][mask]] = m[mask]
    if not pairs:
        return out, None
    a, bx = np.empty((n, k)), np.empty((n, k))
    a[cell[:, :width][mask]] = alpha[mask]
    bx[cell[:, :width][mask]] = (beta * xs[:, :width])[mask]
    inner = np.flatnonzero(~is_head)
    before, after = a[inner - 1], bx[inner]
    return out, t * ((before / ((before @ t) * after).sum(1, keepdims=True)).T @ after)


def _smallest(x: np.ndarray) -> np.ndarray:
    """Values from 0 on in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _owners(u: Words, keep: np.ndarray) -> np.ndarray:
    """The word of each kept feature: fixed ones by column, then bigrams and trigrams."""
    every, owner = np.arange(u.count), np.repeat(np.arange(u.count), u.ends - u.starts)
    return np.concatenate([*[every] * (1 + len(PREFIXES) + len(SUFFIXES)), owner, owner])[keep]


def train(crf: Crf, sequences: Iterable[tuple[Words, np.ndarray]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-6, seed: int = 7) -> Crf:
    """Adagrad on the log-likelihood; each sequence is a batch: words of some texts, and a label for each word.

    The batches are read once; what stays of each are its different words and small indices, so that a generator of
    batches keeps the driver's memory low.
    """
    k, dims = len(crf.labels), (1 << crf.bits) + 1
    h = np.full((dims, k), 1e-2, np.float32)
    ht, hb = np.full((k, k), 1.0), np.full(k, 1.0)
    rng = np.random.default_rng(seed)
    prepared = []
    for w, y in sequences:
        if not w.count:
            continue
        which, u = different(w)
        fixed, (i2, i3) = fixed_features(u, crf.bits), ngram_features(u, crf.bits)
        letters = ragged(u.starts, u.ends - u.starts)
        index = np.concatenate([*fixed.T, i2[letters], i3[letters]])
        index[index < 0] = dims - 1
        keep = index < dims - 1
        cells, place = np.unique(index[keep], return_inverse=True)
        inner = np.setdiff1d(np.arange(w.count), w.first[:-1])
        seen = np.zeros((k, k))
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        prepared.append((w.first, y, _smallest(which), u, cells, _smallest(place), np.packbits(keep), len(keep), seen))
    for _ in range(epochs):
        for i in rng.permutation(len(prepared)):
            first, y, which, u, cells, place, kept, size, seen = prepared[i]
            who = _owners(u, np.unpackbits(kept, count=size).view(bool))
            texts, n = max(1, len(first) - 1), u.count
            m, xi = forward_backward(crf.word_scores(u)[which], first, crf.trans, crf.initial, pairs=True)
            g = -m
            g[np.arange(len(y)), y] += 1
            by_word = np.stack([np.bincount(which, g[:, j], n) for j in range(k)], 1)
            total = np.stack([np.bincount(place, by_word[who, j], len(cells)) for j in range(k)], 1)
            total = (total / texts - l2 * crf.weights[cells]).astype(np.float32)
            h[cells] += total * total
            crf.weights[cells] += rate * total / np.sqrt(h[cells])
            gt = (seen - xi) / texts
            ht += gt * gt
            crf.trans += rate * gt / np.sqrt(ht)
            gb = g.sum(0) / texts
            hb += gb * gb
            crf.bias += (rate * gb / np.sqrt(hb)).astype(np.float32)
    return crf
