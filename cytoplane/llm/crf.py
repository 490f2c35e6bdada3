"""Linear-chain conditional random fields over the words of texts, on hashed affix, n-gram and lexicon features.

Words are runs of ASCII letters and bytes from 0x80 on, A-Z lower-cased. A text's chain is cut into blocks only for
vectorisation: block transfer matrices are multiplied first, then each block's recursions start from exact messages, so
the marginals are those of the whole chain, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BITS = 18
SIZE = 1 << BITS
BLOCK = 96
LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True
ODD = np.uint32(2654435761)


def _slot(h: np.ndarray, salt: int) -> np.ndarray:
    """Slots 1 to SIZE-1; slot 0 stands for no feature."""
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * ODD
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32) | np.int32(1)


@dataclass
class Tokens:
    """The words of some texts: where they stand in the joined bytes, how many each text has, and their feature slots."""

    counts: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    grams: list[np.ndarray]
    affixes: np.ndarray
    word: np.ndarray
    offsets: np.ndarray


def tokenize(texts: list[bytes], prefixes: tuple[int, ...], suffixes: tuple[int, ...]) -> Tokens:
    raw = np.frombuffer(b"\n".join(texts) + b"\n" * 16, np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    offsets = np.cumsum(lengths) - lengths
    c = LOW[raw]
    c = np.where(LETTER[c], c, np.uint8(32))
    inside = np.flatnonzero(c != 32)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
    if not len(inside):
        none = np.empty(0, np.int64)
        return Tokens(np.zeros(len(texts), np.int64), none, none, none, [], np.empty((0, 0), np.int32), none, offsets)
    begin = inside[first]
    size = np.diff(np.append(first, len(inside)))
    end = begin + size
    owner = np.searchsorted(offsets, begin, "right") - 1
    w = c.astype(np.uint32)
    before, here, after = w[inside - 1] if inside[0] else np.concatenate([[np.uint32(32)], w[inside[1:] - 1]]), w[inside], w[inside + 1]
    pair = here * np.uint32(256) + after
    grams = [_slot(pair, 1), _slot(pair + before * np.uint32(65536), 2)]
    place = np.minimum(np.arange(len(inside)) - np.repeat(first, size), 63).astype(np.uint32)
    powers = np.cumprod(np.full(64, 16777619, np.uint32), dtype=np.uint32)
    word = np.add.reduceat((here + np.uint32(7)) * powers[place] * (here | np.uint32(1)), first).astype(np.uint32) ^ size.astype(np.uint32)
    cols, h = [], np.zeros(len(begin), np.uint32)
    for k in range(max(prefixes, default=0)):
        h = h * np.uint32(16777619) + w[np.minimum(begin + k, len(w) - 1)] + np.uint32(1)
        if k + 1 in prefixes:
            cols.append(np.where(size > k, _slot(h, 10 + k), 0))
    h = np.zeros(len(begin), np.uint32)
    for k in range(max(suffixes, default=0)):
        h = h * np.uint32(16777619) + w[np.maximum(end - 1 - k, 0)] + np.uint32(1)
        if k + 1 in suffixes:
            cols.append(np.where(size > k, _slot(h, 30 + k), 0))
    return Tokens(np.bincount(owner, minlength=len(texts)), begin, end, first, grams, np.stack(cols, 1), _slot(word, 50), offsets)


@dataclass
class Crf:
    labels: list
    prefixes: tuple[int, ...] = (1, 2, 3)
    suffixes: tuple[int, ...] = (1, 2, 3)
    weights: np.ndarray = field(default=None, repr=False)  # type: ignore[assignment]
    lexicon: np.ndarray = field(default=None, repr=False)  # type: ignore[assignment]
    moves: np.ndarray = field(default=None)  # type: ignore[assignment]
    lead: float = 0.0

    def __post_init__(self):
        k = len(self.labels)
        if self.weights is None:
            self.weights, self.lexicon, self.moves = np.zeros((SIZE, k), np.float32), np.zeros(SIZE, bool), np.zeros((k, k), np.float32)

    def tokens(self, texts: list[bytes]) -> Tokens:
        return tokenize(texts, self.prefixes, self.suffixes)

    def known(self, t: Tokens) -> np.ndarray:
        return np.where(self.lexicon[t.word], t.word, 0)

    def emissions(self, t: Tokens) -> np.ndarray:
        w = self.weights
        if not len(t.first):
            return np.empty((0, w.shape[1]), np.float32)
        grams = w[t.grams[0]]
        for g in t.grams[1:]:
            grams += w[g]
        out = np.add.reduceat(grams, t.first, axis=0)
        for k in range(t.affixes.shape[1]):
            out += w[t.affixes[:, k]]
        return out + w[self.known(t)]

    def marginals(self, em: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(label) of each word given its whole text; with pairs, also the summed P(label, next label)."""
        n, k = em.shape
        if not n:
            return (em, np.zeros((k, k))) if pairs else em
        step = np.exp(self.moves - self.moves.max()).astype(np.float32)
        psi = np.exp(em - em.max(axis=1, keepdims=True))
        per = -(-counts // BLOCK)
        doc_start = np.cumsum(counts) - counts
        nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(doc_start, per) + nth * BLOCK
        size = np.minimum(BLOCK, np.repeat(counts, per) - nth * BLOCK)
        by = np.argsort(-size, kind="stable")
        start_s, size_s = start[by], size[by]
        active = np.searchsorted(-size_s, -np.arange(int(size_s[0])), "left")  # blocks longer than each place
        m = np.broadcast_to(np.eye(k, dtype=np.float32), (len(by), k, k)).copy()
        for t, a in enumerate(active):
            x = (m[:a].reshape(-1, k) @ step).reshape(-1, k, k) * psi[start_s[:a] + t][:, None, :]
            m[:a] = x / x.sum(axis=(1, 2), keepdims=True)
        whole = np.empty_like(m)
        whole[by] = m
        come, go = np.full((len(start), k), 1 / k, np.float32), np.ones((len(start), k), np.float32)
        deep, first_block = int(per.max()), np.cumsum(per) - per
        for j in range(1, deep):
            b = first_block[per > j] + j
            x = np.einsum("ij,ijk->ik", come[b - 1], whole[b - 1])
            come[b] = x / x.sum(axis=1, keepdims=True)
        for j in range(deep - 2, -1, -1):
            b = first_block[per > j + 1] + j
            x = np.einsum("ijk,ik->ij", whole[b + 1], go[b + 1])
            go[b] = x / x.sum(axis=1, keepdims=True)
        alpha, beta = np.empty_like(em), np.empty_like(em)
        a_now, b_now = come[by], go[by]
        for t, a in enumerate(active):
            at = start_s[:a] + t
            x = (a_now[:a] @ step) * psi[at]
            a_now[:a] = x = x / x.sum(axis=1, keepdims=True)
            alpha[at] = x
        back = step.T.copy()
        for t in range(len(active) - 1, -1, -1):
            at = start_s[: active[t]] + t
            x = b_now[: active[t]]
            beta[at] = x
            x = (psi[at] * x) @ back
            b_now[: active[t]] = x / x.sum(axis=1, keepdims=True)
        out = alpha * beta
        out /= out.sum(axis=1, keepdims=True)
        if not pairs:
            return out
        left = np.setdiff1d(np.arange(n), (doc_start + counts - 1)[counts > 0], assume_unique=True)
        x = alpha[left][:, :, None] * step[None] * (psi[left + 1] * beta[left + 1])[:, None, :]
        return out, (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def fit(self, texts: list[bytes], gold: list[np.ndarray], epochs: int, rate: float = 0.3, at_once: int = 1 << 18, smooth: float = 1.0, seed: int = 7) -> Crf:
        """Maximum likelihood by AdaGrad on batches of texts of about at_once bytes. gold: each text's label index per word."""
        k = len(self.labels)
        order = np.random.default_rng(seed).permutation(len(texts))
        size = np.cumsum([len(texts[i]) for i in order])
        batches = [order[size // at_once == j] for j in range(int(size[-1] // at_once) + 1)] if len(order) else []
        seen, moved = np.full(self.weights.shape, 1e-3, np.float32), np.full((k, k), 1.0)
        for _ in range(epochs):
            for batch in batches:
                t = self.tokens([texts[i] for i in batch])
                y = np.concatenate([gold[i] for i in batch]) if len(batch) else np.empty(0, np.int64)
                if not len(y):
                    continue
                p, expected = self.marginals(self.emissions(t), t.counts, pairs=True)
                g = -p
                g[np.arange(len(y)), y] += 1
                g /= len(batch)
                inner = np.setdiff1d(np.arange(len(y)), np.cumsum(t.counts[t.counts > 0]) - 1, assume_unique=True)
                held = np.zeros((k, k))
                np.add.at(held, (y[inner], y[inner + 1]), 1)
                move = (held + smooth - expected - smooth * k * k * np.exp(self.moves) / np.exp(self.moves).sum()) / len(batch)
                size_of = np.diff(np.append(t.first, len(t.grams[0])))
                grad = np.zeros_like(self.weights)
                for j in range(k):
                    each = np.repeat(g[:, j], size_of)
                    for slots in t.grams:
                        grad[:, j] += np.bincount(slots, each, SIZE).astype(np.float32)
                    for slots in (*t.affixes.T, self.known(t)):
                        grad[:, j] += np.bincount(slots, g[:, j], SIZE).astype(np.float32)
                grad[0] = 0
                seen += grad**2
                self.weights += rate * grad / np.sqrt(seen)
                moved += move**2
                self.moves = np.clip(self.moves + 0.1 * move / np.sqrt(moved), -6, 6).astype(np.float32)
        return self
