"""Toxicity scores by weak supervision.

Lexicon voters (whole words) and pattern voters (beginnings and endings of words) are
mined by one task from a bounded sample of labelled rows.  A scan notes which of them
occur in each text.  A generative label model then estimates, from the counts of all
patterns of votes in the training rows, labelled or not, how often each voter speaks in
toxic and in clean texts, and how far voters agree beyond what the class explains;
voters that repeat one another share one vote.  Its posteriors are the labels on which
a sparse linear classifier is trained, over a bounded sample of labelled rows, and that
classifier scores all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, fold, in_a_task, list_column, staged

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡·•"


def word_features(word: str) -> tuple[str, ...]:
    """A word and the beginnings and endings that stand for patterns."""
    word = word.strip(_MARKS)
    if not word:
        return ()
    n = len(word)
    return (f"<{word}>", *(f"<{word[:k]}" for k in range(3, min(n, 8))), *(f"{word[-k:]}>" for k in range(3, min(n, 7))))


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


FEATURE_BITS = 23


class Features(dict):
    """Words to the hashed features they have, remembered up to a limit."""

    def __init__(self, limit: int = 1 << 16):
        self.limit = limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple(zlib.crc32(f.encode()) >> (32 - FEATURE_BITS) for f in word_features(word))
        return found

    def of(self, text: str | None) -> np.ndarray:
        found = {f for w in words_of(text) for f in self[w]}
        return np.fromiter(found, np.int64, len(found))


def presence(texts: list[str | None], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic and how many clean texts have each feature."""
    features, sums = Features(), [np.zeros(1 << FEATURE_BITS, np.int32) for _ in range(2)]
    for text, y in zip(texts, toxic, strict=True):
        sums[int(not y)][features.of(text)] += 1
    return sums[0], sums[1]


def telling(in1: np.ndarray, in0: np.ndarray, n1: float, n0: float, most: int, precision: float = 0.8) -> np.ndarray:
    """The features whose share of toxic texts is surely above that of all texts.

    ``in1`` and ``in0`` weigh the toxic and clean texts that have a feature, ``n1`` and
    ``n0`` all of them.  By Chernoff's bound, fewer than one in two runs would pick a
    feature by chance among all that are tested; best come first."""
    tested = np.flatnonzero(in1 + in0)
    in1, in0 = in1[tested].astype(np.float64), in0[tested].astype(np.float64)
    base, n = n1 / (n1 + n0), in1 + in0
    share = np.clip(in1 / n, 1e-12, 1 - 1e-12)
    excess = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / max(1e-12, 1 - base)))
    excess[(share < max(precision, base)) | (in1 < 2)] = 0
    best = np.argsort(-excess, kind="stable")[:most]
    return tested[best[excess[best] > np.log(2.0 * max(1, len(tested)))]]


def _dense(has: pa.ListArray, width: int) -> np.ndarray:
    """Lists of positions as rows of 0 and 1; a last column tells the empty rows."""
    sizes = np.diff(has.offsets.to_numpy())
    flat = has.flatten().to_numpy()
    row, ok = np.repeat(np.arange(len(has)), sizes), flat < width
    out = np.zeros((len(has), width + 1), np.float64)
    out[row[ok], flat[ok]] = 1
    out[:, width] = out[:, :width].sum(1) == 0
    return out


@dataclass
class LabelModel:
    """A voter speaks or is silent; that all are silent is a vote as well.  ``share`` is a
    voter's part of a vote: one over one plus its correlations with other voters, taken
    within the classes."""

    p1: np.ndarray
    p0: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + votes @ (self.share * np.log(self.p1 / self.p0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


TRUST = 0.98  # in a label
CORRELATED = 0.7


def _step(found: LabelModel | None, prior: float, votes: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sums over rows of votes that count ``n`` times; ``toxic`` is NaN without a label."""
    known = ~np.isnan(toxic)
    q = np.where(known, np.where(toxic == 1, TRUST, 1 - TRUST), found.posterior(votes) if found else prior)
    w1, w0, first = n * q, n * (1 - q), known if not found else np.ones(len(n))
    parts = [np.array([(w1 * first).sum(), (w0 * first).sum(), w1.sum(), n.sum(), (w1 * q).sum(), (w1 * (1 - q)).sum(), (w0 * (1 - q)).sum()])]
    return [*parts, (w1 * first) @ votes, (w0 * first) @ votes, w1 @ votes, w0 @ votes]


def _updated(sums: list[np.ndarray], both: np.ndarray) -> LabelModel:
    """The next model; ``both`` counts the rows in which two voters speak."""
    (f1, f0, t1, n, qq, qr, rr), s1, s0, a1, a0 = sums
    p1, p0 = (s1 + 0.5) / (f1 + 1), (s0 + 0.5) / (f0 + 1)
    cross = np.outer(a1, p1) + np.outer(a0, p0)
    mean = qq * np.outer(p1, p1) + qr * (np.outer(p1, p0) + np.outer(p0, p1)) + rr * np.outer(p0, p0)
    cov = (both - cross - cross.T + mean) / n
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    agree = np.clip(cov / scale[:, None] / scale[None, :], 0, 1)
    np.fill_diagonal(agree, 0)
    agree[agree < CORRELATED] = 0
    return LabelModel(p1, p0, 1 / (1 + agree.sum(1)), float(np.clip(t1 / n, 0.01, 0.5)))


def label_model(patterns: DataFrame, width: int, rounds: int = 12) -> LabelModel | None:
    """Expectation maximisation over ``patterns(votes, toxic, n)``: how many rows have
    these votes and this label or none.  The first round learns from labelled rows only.

    A round is one pass in which every task adds up what its patterns say; the driver
    gets sums over voters, never rows."""
    patterns = patterns.coalesce(64)

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        toxic = batch.column("toxic").cast(pa.float64()).to_numpy(zero_copy_only=False)
        return _dense(batch.column("votes"), width), toxic, batch.column("n").to_numpy().astype(np.float64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((width + 1, width + 1))
        for batch in batches:
            votes, _, n = columns(batch)
            both += votes.T @ (votes * n[:, None])
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], names=["i", "j", "n"])

    def total(found: LabelModel | None, prior: float) -> list[np.ndarray] | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if len(batch):
                    step = _step(found, prior, *columns(batch))
                    sums = step if sums is None else [a + b for a, b in zip(sums, step, strict=True)]
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums).tobytes()])], names=["sums"])

        parts = [np.frombuffer(r.sums) for r in patterns.mapInArrow(run, "sums binary").collect()]
        return np.split(np.sum(parts, axis=0), 7 + (width + 1) * np.arange(4)) if parts else None

    counts = patterns.mapInArrow(pairs, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((width + 1, width + 1))
    both[counts.column("i").to_numpy(), counts.column("j").to_numpy()] = counts.column("n").to_numpy()
    seen = patterns.where("toxic is not null").agg(F.sum("n").alias("n"), F.sum(F.col("toxic") * F.col("n")).alias("toxic")).first()
    if not seen.n or not seen.toxic:
        return None
    found, prior = None, float(np.clip(seen.toxic / seen.n, 0.01, 0.5))
    for _ in range(rounds):
        found = _updated(total(found, prior), both)
    return found


def linear_classifier(present: np.ndarray, target: np.ndarray, ridge: float = 0.5, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on soft labels, by Newton's method; the
    ridge spreads a weight over features that stand for the same thing."""
    j = present.shape[1]
    x = np.concatenate([present, np.ones((len(present), 1), np.float32)], axis=1)
    penalty = np.full(j + 1, ridge)
    penalty[j] = 1e-3
    w = np.zeros(j + 1)
    w[j] = np.log(np.clip(target.mean(), 1e-3, 0.999) / (1 - np.clip(target.mean(), 1e-3, 0.999)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + penalty * w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve.astype(np.float64), slope)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w[:j], float(w[j])


@dataclass
class Model:
    pool: np.ndarray  # hashed features, those that vote first
    weights: np.ndarray
    bias: float


NO_MODEL = Model(np.zeros(0, np.int64), np.zeros(0), -4.0)


def mine(docs: DataFrame, truth: DataFrame, max_labelled: int, most: int = 1000) -> np.ndarray:
    """The telling features of a sample of ``docs(doc_id, text)`` that ``truth`` labels."""

    def found(sample: pa.Table) -> np.ndarray:
        toxic = sample.column("toxic").to_numpy() == 1
        if not toxic.any():
            return NO_MODEL.pool
        return telling(*presence(sample.column("text").to_pylist(), toxic), toxic.sum(), (~toxic).sum(), most)

    pool = in_a_task(bounded_sample(docs.join(truth, "doc_id"), truth.count(), max_labelled, "doc_id", "text"), found)
    return NO_MODEL.pool if pool is None else pool


class _Chosen(Features):
    """Words to the places of their features in a pool."""

    def __init__(self, pool: np.ndarray, limit: int = 1 << 17):
        super().__init__(limit)
        self.place = {f: i for i, f in enumerate(pool.tolist())}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = super().__missing__(word)
        self[word] = tuple(self.place[f] for f in found if f in self.place)
        return self[word]


def found_features(docs: DataFrame, pool: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, has`` for every row: which features of the pool its whole text has."""
    shared = docs.sparkSession.sparkContext.broadcast(pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Chosen(shared.value)
        for batch in batches:
            has = [np.sort(table.of(t)).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(has, pa.int32())], names=["doc_id", "has"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, has array<int>")


def fit(features: DataFrame, truth: DataFrame, pool: np.ndarray, max_labelled: int, most_voters: int = 400, most_features: int = 600) -> Model:
    """The classifier, from ``features(doc_id, has)`` of all training rows.

    The first ``most_voters`` of the pool vote.  ``max_labelled`` bounds the rows on
    whose posteriors the classifier is trained."""
    width = min(most_voters, len(pool))
    labelled = features.join(truth, "doc_id", "left")
    votes = F.filter("has", lambda x: x < width)
    found = label_model(staged(labelled.groupBy(votes.alias("votes"), "toxic").agg(F.count("*").alias("n"))), width) if width else None
    if found is None:
        return NO_MODEL
    rows = bounded_sample(features.join(truth, "doc_id"), truth.count(), max_labelled, "doc_id", "has").select("has").toArrow()
    has = rows.column("has").combine_chunks()
    posterior = found.posterior(_dense(has, width))
    present = _dense(has, len(pool))[:, :-1].astype(np.float32)
    kept = telling(posterior @ present, (1 - posterior) @ present, posterior.sum(), (1 - posterior).sum(), most_features)
    weights = np.zeros(len(pool))
    weights[kept], bias = linear_classifier(present[:, kept], posterior)
    return Model(pool, weights, bias)


def score_features(features: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``features(doc_id, has)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.bias + _dense(batch.column("has"), len(model.pool))[:, :-1] @ model.weights
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, from its whole text alone."""
    return score_features(found_features(docs, model.pool, id_col, text_col), model)


def learn_and_score(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, folds: int = 5) -> tuple[DataFrame, Model]:
    """``doc_id, score`` for every row of ``docs``, and the model, which learns from the
    rows outside fold 0: words and classifier from at most ``max_labelled`` labelled rows
    (drawn by a hash of id and text), the label model from all rows.

    Null and empty texts get the score of a text without any feature.  A document with
    several labels counts as toxic if one says so; rows that repeat an id share its
    label.  Without labelled toxic rows to learn from, all scores are low."""
    docs = docs.select("doc_id", "text")
    outside = fold(F.col("doc_id"), folds) != 0
    truth = cut(labels.where(F.col("toxic").isNotNull() & outside).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    pool = mine(docs.where(outside), truth, max_labelled)
    features = staged(found_features(docs, pool))
    model = fit(features.where(outside), truth, pool, max_labelled)
    return score_features(features, model), model
