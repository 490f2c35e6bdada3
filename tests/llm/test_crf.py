"""Language ID and toxicity against all label sequences of short texts, and what is learned against finite differences."""

import itertools
import math
import re

import numpy as np
import pytest

from cytoplane.llm import language_id, toxicity
from cytoplane.llm.crf import SIZE, Crf

WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")
TEXTS = ["", None, "12 ..", "Wort", "é", "ab cd", "der Hund; the DOG barks é", "a b\nc d-e", "un deux trois\t quatre", "x" * 300, "ß ſ 9 K", "aa aa aa aa aa aa"]


def model(labels, seed, lead=0.0):
    rng = np.random.default_rng(seed)
    crf = Crf(labels, lead=lead)
    k = len(labels)
    crf.weights = (rng.normal(size=(SIZE, k)) * 0.6).astype(np.float32)
    crf.weights[0] = 0
    crf.lexicon = rng.random(SIZE) < 0.5
    crf.moves = rng.normal(size=(k, k)).astype(np.float32)
    return crf


def start_of(crf):
    """The factor of a first label: as if an even share of labels stood before it."""
    return np.log(np.exp(crf.moves.astype(float)).mean(axis=0))


def sequences(crf, em, moves=None, start=None):
    """(label sequences, their log weights) of a text with these emissions."""
    moves = crf.moves.astype(float) if moves is None else moves
    start = start_of(crf) if start is None else start
    every = list(itertools.product(range(len(crf.labels)), repeat=len(em)))
    return every, np.array([start[s[0]] + sum(em[i][y] for i, y in enumerate(s)) + sum(moves[a, b] for a, b in zip(s, s[1:])) for s in every])


def posteriors(crf, text):
    """P(label) of each word of a text, summed over all sequences."""
    t = crf.tokens([text.encode()])
    em = crf.emissions(t).astype(float)
    if not len(em):
        return np.empty((0, len(crf.labels)))
    every, weight = sequences(crf, em)
    p = np.exp(weight - weight.max())
    p /= p.sum()
    out = np.zeros(em.shape)
    for s, q in zip(every, p):
        for i, y in enumerate(s):
            out[i, y] += q
    return out


@pytest.mark.parametrize("lead", [0.0, 2.0])
def test_language_of_a_text_equals_that_of_all_sequences(spark, lead):
    crf = model(["de", "en", "fr"], 1, lead)
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.label_documents(df, crf).collect()}
    for i, text in enumerate(TEXTS):
        p = posteriors(crf, text or "")
        assert len(p) == len(WORD.findall(text or ""))
        if not len(p):
            assert got[i] == ("und", 0.0)
            continue
        fade = np.exp(-np.arange(len(p)) / 10)
        share = (p.mean(axis=0) + lead * (p * fade[:, None]).sum(axis=0) / fade.sum()) / (1 + lead)
        assert got[i][0] == crf.labels[share.argmax()] and got[i][1] == pytest.approx(share.max(), abs=1e-4)


def test_read_out_equals_text_by_text():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 3, 0, 250, 2])
    p = rng.dirichlet(np.ones(4), counts.sum())
    got, at = language_id.read_out(p, counts, 1.5), 0
    for row, n in zip(got, counts):
        own = p[at : at + n]
        fade = np.exp(-np.arange(n) / 10)
        want = (own.mean(axis=0) + 1.5 * (own * fade[:, None]).sum(axis=0) / fade.sum()) / 2.5 if n else np.zeros(4)
        assert np.allclose(row, want, atol=1e-9)
        at += n


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_toxic_score_and_spans_equal_those_of_all_sequences(spark, least):
    crf = model([0, 1], 3)
    texts = [*TEXTS, "der Hund", "der Hund"]
    df = spark.createDataFrame([(i % 12, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, spans string, score int")
    got = sorted(((r.doc_id, r.text or "", r.score, tuple((s.start, s.end) for s in r.spans)) for r in toxicity.tag_documents(df, crf, least).collect()), key=lambda r: r[:2])
    want = []
    for i, text in enumerate(texts):
        p, words = posteriors(crf, text or "")[:, 1], [m.span() for m in WORD.finditer(text or "")]
        assert all(abs(v - least) > 1e-4 for v in p)
        spans = []
        for k, (a, b) in enumerate(words):
            if p[k] >= least:
                if k and p[k - 1] >= least:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
        want.append((i % 12, text or "", max(p, default=0.0), tuple(spans)))
    want.sort(key=lambda r: r[:2])
    assert [(*r[:2], r[3]) for r in got] == [(*r[:2], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-4)


def test_a_step_of_learning_follows_the_gradient():
    """One batch's step, undone to the gradient it was made from, against differences of the likelihood of all sequences."""
    texts, gold = [b"ab cd ab", b"cd", b"ef ab cd ab"], [np.array([0, 1, 0]), np.array([1]), np.array([1, 0, 0, 1])]
    crf, smooth, rate = model(["a", "b"], 4), 1.0, 0.3
    before, moves, start = crf.weights.copy(), crf.moves.astype(float).copy(), start_of(crf)

    def likelihood(weights, moves):
        own, total = Crf(crf.labels, weights=weights, lexicon=crf.lexicon, moves=crf.moves), 0.0
        for text, y in zip(texts, gold):
            every, weight = sequences(own, own.emissions(own.tokens([text])).astype(float), moves, start)
            total += weight[every.index(tuple(y))] - (weight.max() + math.log(np.exp(weight - weight.max()).sum()))
        return total

    t = crf.tokens(texts)
    used = np.unique(np.concatenate([*t.grams, t.affixes.ravel(), crf.known(t)]))
    used = used[used > 0]
    crf.fit(texts, gold, epochs=1, rate=rate, smooth=smooth)
    step = (crf.weights - before).astype(float)
    assert not step[np.setdiff1d(np.arange(SIZE), used)].any()
    made = np.sign(step) * np.sqrt(1e-3 * step**2 / np.maximum(rate**2 - step**2, 1e-12))
    for slot in used[:: max(1, len(used) // 12)]:
        for k in range(2):
            up, down = before.copy(), before.copy()
            up[slot, k] += 0.02
            down[slot, k] -= 0.02
            want = (likelihood(up, moves) - likelihood(down, moves)) / 0.04 / len(texts)
            assert made[slot, k] == pytest.approx(want, abs=2e-3)
    step = (crf.moves - moves) / 0.1
    made = np.sign(step) * np.sqrt(step**2 / (1 - step**2))
    even = lambda m: smooth * (m - math.log(np.exp(m).sum())).sum()
    for a, b in itertools.product(range(2), repeat=2):
        up, down = moves.copy(), moves.copy()
        up[a, b] += 1e-3
        down[a, b] -= 1e-3
        want = (likelihood(before, up) + even(up) - likelihood(before, down) - even(down)) / 2e-3 / len(texts)
        assert made[a, b] == pytest.approx(want, abs=2e-3)
