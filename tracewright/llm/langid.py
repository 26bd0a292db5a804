"""Language identification by averaged hashed subword embeddings.

A word's subwords are its n-grams of two to four bytes, with a space before and
after it.  A text is the average of their embeddings, and a linear softmax turns it
into probabilities.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  Probabilities are
calibrated by temperature on a part of the sample that training does not see, and
the rejection threshold is the lowest at which the accepted part of it reaches a
stated precision.

Averaging and the linear layer commute, so the trained model is one table of class
scores per bucket, which tasks add up over a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_sample, fold, in_a_task

NO_LANGUAGE = "und"
BUCKET_BITS = 15
#: A-Z become a-z, other ASCII characters than letters become spaces.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PIECE = 1 << 20


def subwords(text: bytes) -> np.ndarray:
    """How often each bucket occurs among the text's subwords; long texts in pieces."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    padded = b" " + text.translate(_LETTERS) + b" "
    for at in range(0, len(padded), _PIECE):
        a = np.frombuffer(padded[at : at + _PIECE + 3], np.uint8)
        starts = min(_PIECE, len(a))
        letter = a != 32
        code = a.astype(np.uint64)
        for n in (2, 3, 4):
            if len(a) < n:
                break
            m = len(a) - n + 1
            code = code[:m] | a[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
            inside = letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1] if n == 3 else letter[1 : m + 1] & letter[2 : m + 2]
            found = code[:starts][inside[:starts]] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) >> np.uint64(64 - BUCKET_BITS)
            total += np.bincount(found.view(np.int64), minlength=len(total))
    return total


def has_letter(text: bytes) -> bool:
    return bool(text.translate(_LETTERS).strip()) and any(c.isalpha() for c in text.decode())


@dataclass
class Model:
    classes: list[str]
    scores: np.ndarray  # buckets x classes: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _probabilities(logits: np.ndarray, temperature: float) -> np.ndarray:
    z = logits / temperature
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(
    texts: list[str], labels: list[str], held: np.ndarray, dim: int = 16, epochs: int = 3,
    rate: float = 0.5, pieces: int = 4, piece_words: int = 6, precision: float = 0.98, seed: int = 7,
) -> Model:
    """Fit on whole texts and on a few short pieces of each, so that short texts are
    learned as well; rows with ``held`` true only calibrate."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    embed = rng.normal(0, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    examples: tuple[list, list] = ([], [])
    for text, label, calibrate in zip(texts, labels, held, strict=True):
        words = text.encode().split()
        cuts = [words, *(words[i : i + rng.integers(1, piece_words + 1)] for i in rng.integers(0, max(1, len(words)), pieces))]
        for piece in cuts:
            counts = subwords(b" ".join(piece))
            ids = np.flatnonzero(counts).astype(np.int32)
            if len(ids):
                examples[int(calibrate)].append((ids, (counts[ids] / counts.sum()).astype(np.float32), classes.index(label)))
    order = np.arange(len(examples[0]))
    steps, step = max(1, epochs * len(order)), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            ids, share, y = examples[0][i]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ embed[ids]
            p = _probabilities(hidden @ weights + bias, 1.0)
            p[y] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            embed[ids] -= (lr * len(ids) ** 0.5) * share[:, None] * back
    model = Model(classes, embed @ weights, bias, 1.0, 0.0)
    judged = examples[1] or examples[0]
    if not judged:
        return model
    logits = np.array([s @ model.scores[i] for i, s, _ in judged]) + bias
    y = np.array([e[2] for e in judged])
    grid = np.geomspace(0.05, 10, 60)
    loss = [-np.log(np.maximum(_probabilities(logits, t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _probabilities(logits, model.temperature)
    best, right = p.max(1), p.argmax(1) == y
    for t in np.linspace(0, 0.95, 96):
        if (best >= t).sum() == 0 or right[best >= t].mean() >= precision:
            model.threshold = float(t)
            break
    return model


def fit(docs: DataFrame, max_rows: int = 6000, folds: int = 5, **options) -> Model | None:
    """Learn from rows with text and lang outside fold 0.

    ``max_rows`` bounds the sample, whose rows are drawn by a hash of id and text.  One
    task trains on it.  None if there is no such row."""
    rows = docs.where((fold(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    total = docs.where((fold(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull()).count()

    def learned(sample: pa.Table) -> Model:
        sample = sample.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
        held = np.array([zlib.crc32(f"calibrate {i}".encode()) % 5 == 0 for i in sample.column("doc_id").to_pylist()])
        return train(sample.column("text").to_pylist(), sample.column("lang").to_pylist(), held, **options)

    return in_a_task(bounded_sample(rows, total, max_rows, "doc_id", "text", "lang"), learned)


def _predict(text: bytes, model: Model | None) -> tuple[str, float, bool]:
    if not has_letter(text):
        return NO_LANGUAGE, 0.0, True
    counts = subwords(text)
    if model is None or not counts.any():
        return NO_LANGUAGE, 0.0, False
    ids = np.flatnonzero(counts)
    p = _probabilities(counts[ids].astype(np.float32) @ model.scores[ids] / counts.sum() + model.bias, model.temperature)
    best = int(p.argmax())
    return model.classes[best], float(p[best]), bool(p[best] < model.threshold)


def _scan(docs: DataFrame, model: Model | None, text_col: str, make, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield make(batch, [_predict(t, shared.value) for t in as_bytes(batch.column(text_col))])

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row.

    ``und`` with score 0 for null texts, texts without a letter, and without a
    model; ``rejected`` for texts without a letter and where the probability is
    below the threshold."""

    def make(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        langs, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["doc_id", "lang_pred", "score", "rejected"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias(text_col))
    return _scan(rows, model, text_col, make, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns stay.

    Null and empty texts and those without a letter go, whatever the ids; repeated rows
    stay or go together.  Without a model only those go; an empty table stays empty."""
    keep = lambda batch, found: batch.filter(pa.array([not x[2] for x in found], pa.bool_()))
    return _scan(docs, model, text_col, keep, docs.schema)
