"""Language ID against a plain version: counts by dictionary, training and scores by scalar loops."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import langid

TEXTS = ["the cat and the dog", "der Hund und die Katze", "le chat est là", "the dog", "und die Katze über", "12 le -- chat 7"]
LABELS = ["en", "de", "fr", "en", "de", "fr"]
ODD = [None, "", "  ", "42 %", "a", "über", "над", "x1y", "\U0001f600", "été " * 300]


def plain_subwords(text: str) -> Counter:
    """Grams of 2 bytes with a letter, of 3 around a letter, of 4 around two."""
    folded = [ord(" ")]
    for b in text.encode():
        lower = b + 32 if 65 <= b <= 90 else b
        folded.append(lower if 97 <= lower <= 122 or lower >= 128 else 32)
    folded.append(32)
    found = Counter()
    for n in (2, 3, 4):
        for i in range(len(folded) - n + 1):
            gram = folded[i : i + n]
            inner = gram[1:-1]
            if any(b != 32 for b in gram) if n == 2 else all(b != 32 for b in inner):
                value = sum(b << (8 * k) for k, b in enumerate(gram))
                found[value * (0x9E3779B97F4A7C15 + 2 * n) % (1 << 64) >> (64 - langid.BUCKET_BITS)] += 1
    return found


def plain_softmax(logits: list[float]) -> list[float]:
    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


def plain_training(texts, labels, dim, epochs, rate, seed):
    """Stochastic gradient descent on whole texts, one number at a time."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    embed = rng.normal(0, 1 / dim, (1 << langid.BUCKET_BITS, dim)).tolist()
    for _ in texts:
        rng.integers(0, 9, 0)  # no short pieces are drawn
    weights, bias = [[0.0] * len(classes) for _ in range(dim)], [0.0] * len(classes)
    order, step = np.arange(len(texts)), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            counts = plain_subwords(texts[i])
            total = sum(counts.values())
            lr = rate * (1 - step / (epochs * len(texts)))
            step += 1
            hidden = [sum(c / total * embed[b][d] for b, c in counts.items()) for d in range(dim)]
            p = plain_softmax([bias[k] + sum(hidden[d] * weights[d][k] for d in range(dim)) for k in range(len(classes))])
            p[classes.index(labels[i])] -= 1
            back = [sum(weights[d][k] * p[k] for k in range(len(classes))) for d in range(dim)]
            for d in range(dim):
                for k in range(len(classes)):
                    weights[d][k] -= lr * hidden[d] * p[k]
                for b, c in counts.items():
                    embed[b][d] -= lr * math.sqrt(len(counts)) * c / total * back[d]
            bias = [x - lr * 0.1 * q for x, q in zip(bias, p, strict=True)]
    return classes, embed, weights, bias


@pytest.fixture(scope="module")
def model():
    return langid.train(TEXTS, LABELS, np.zeros(len(TEXTS), bool), dim=3, epochs=4, pieces=0)


@pytest.mark.parametrize("piece", [1 << 20, 64, 5, 1])
def test_subwords(monkeypatch, piece):
    monkeypatch.setattr(langid, "_PIECE", piece)
    for text in [*TEXTS, *[t for t in ODD if t]]:
        counts = langid.subwords(text.encode())
        assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == plain_subwords(text)


def test_training(model):
    classes, embed, weights, bias = plain_training(TEXTS, LABELS, 3, 4, 0.5, 7)
    assert model.classes == classes
    used = sorted(set().union(*map(plain_subwords, TEXTS)))
    want = [[sum(embed[b][d] * weights[d][k] for d in range(3)) for k in range(len(classes))] for b in used]
    np.testing.assert_allclose(model.scores[used], want, atol=1e-4)
    np.testing.assert_allclose(model.bias, bias, atol=1e-5)


def test_calibration():
    """The temperature is the one of the grid with least loss on the part held for it."""
    held = np.array([False, False, False, True, True, True])
    model = langid.train(TEXTS, LABELS, held, dim=3, epochs=4, pieces=0)
    logits = []
    for text in TEXTS[3:]:
        counts = plain_subwords(text)
        share = {b: c / sum(counts.values()) for b, c in counts.items()}
        logits.append([sum(s * float(model.scores[b][k]) for b, s in share.items()) + float(model.bias[k]) for k in range(3)])
    place = [model.classes.index(l) for l in LABELS[3:]]

    def loss(t: float) -> float:
        return -sum(math.log(plain_softmax([x / t for x in row])[k]) for row, k in zip(logits, place, strict=True))

    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.05, 10, 60))) + 1e-4
    p = [plain_softmax([x / model.temperature for x in row]) for row in logits]
    right = [row.index(max(row)) == k for row, k in zip(p, place, strict=True)]
    kept = [r for row, r in zip(p, right, strict=True) if max(row) >= model.threshold]
    assert not kept or sum(kept) >= 0.98 * len(kept)


def test_predictions(spark, model):
    rows = [*enumerate([*TEXTS, *ODD]), (None, "the cat"), (3, "the dog"), (3, "the dog")]
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.lang_pred), r.score, r.rejected) for r in langid.predict(docs, model).collect())
    want = []
    for i, text in rows:
        counts = plain_subwords(text or "")
        if not any(c.isalpha() for c in text or ""):
            lang, p, rejected = "und", 0.0, True
        else:
            total = sum(counts.values())
            logits = [sum(c / total * float(model.scores[b][k]) for b, c in counts.items()) + float(model.bias[k]) for k in range(3)]
            share = plain_softmax([x / model.temperature for x in logits])
            p = max(share)
            lang, rejected = model.classes[share.index(p)], p < model.threshold
        want.append(((i is None, i or 0, lang), p, rejected))
    want.sort()
    assert [(key, r) for key, _, r in got] == [(key, r) for key, _, r in want]
    np.testing.assert_allclose([p for _, p, _ in got], [p for _, p, _ in want], atol=1e-4)
    kept = langid.drop_rejected(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r for _, _, r in want)
