"""Language-model scoring by context-tree weighting over bytes.

A text is its words in lower case (A-Z), joined by one space, and one end byte.  A
byte is eight binary decisions; each decision, given the bits before it, has its own
tree of contexts over the preceding bytes.  A node of that tree predicts by the
Krichevsky-Trofimov estimate of its counts, and is weighted one half against its
children, at every depth from none to ``DEPTH``.  Block probabilities depend on
counts only, so the trees are learned from counts of byte (DEPTH+1)-grams:

1. Tasks count the grams of their training texts, and note those of the others.
2. Gram counts are dealt and sorted by their three nearest context bytes; a task takes
   a few contexts at a time, computes the weighted probabilities of all nodes below, and
   passes on those at depth three.
3. The three depths above are small groupings, up for the block probabilities and
   down for the posterior weights of the depths.
4. The tasks of step 2 then give each gram its log10 probability.
5. A scan adds them up.  The most frequent grams, at most a fixed number, are
   broadcast; a document's other grams are joined.

Word counts for the baseline go the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, as_bytes, cut, fold, list_column, staged

DEPTH = 5
SPLIT = 3  # depth at which contexts are dealt to tasks
END = b"\n"
HOT_GRAMS, HOT_WORDS = 1 << 20, 1 << 17
CHUNK = 1 << 20  # bytes handled at once
HELD = 1 << 21  # distinct grams or words a task holds before it passes them on
_HALF = float(np.log(0.5))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(LOWER_TABLE).split()


def gram_codes(stream: bytes) -> np.ndarray:
    """One code for each byte after the first DEPTH: those before it and itself."""
    a = np.frombuffer(stream, np.uint8).astype(np.int64)
    codes = a[DEPTH:].copy()
    for i in range(1, DEPTH + 1):
        codes |= a[DEPTH - i : len(a) - i] << (8 * i)
    return codes


def _chunks(stream: bytes) -> Iterator[bytes]:
    padded = END * DEPTH + stream
    for i in range(0, len(stream), CHUNK):
        yield padded[i : i + CHUNK + DEPTH]


def _streams(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (b" ".join(tokens(t)) + END for t in as_bytes(batch.column("text")))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``gram, n`` for every gram of ``docs(text, held_out)``; n counts training texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, waiting, size = [], 0, [], 0

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["gram", "n"])

        def counted():
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            return _merged([(keys >> 1, np.where(keys & 1, n, 0))])

        for batch in batches:
            for stream, out in zip(_streams(batch), batch.column("held_out").to_pylist(), strict=True):
                for chunk in _chunks(stream):
                    waiting.append(gram_codes(chunk) << 1 | (0 if out else 1))
                    size += len(chunk)
                    if size >= CHUNK:
                        parts.append(counted())
                        held += len(parts[-1][0])
                        waiting, size = [], 0
                    if held >= HELD:
                        parts = [_merged(parts)]
                        held = len(parts[0][0])
                        if held >= HELD // 2:
                            yield rows(parts[0])
                            parts, held = [], 0
        if waiting:
            parts.append(counted())
        if parts:
            yield rows(_merged(parts))

    return docs.select("text", "held_out").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over the training texts; the empty word stands for the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found = Counter()
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                found.update(tokens(text))
                found[b""] += 1
                if len(found) >= HELD // 8:
                    yield rows(found)
                    found.clear()
        if found:
            yield rows(found)

    return docs.where("not held_out").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    z = x + 8.0
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _log_gamma_sql(x: Column) -> Column:
    z, shift = x + 8.0, x
    for i in range(1, 8):
        shift = shift * (x + float(i))
    half_log = float(0.5 * np.log(2 * np.pi))
    return (z - 0.5) * F.log(z) - z + half_log + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


class Subtrees:
    """The trees below depth SPLIT for the grams of one task."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        symbol = grams & 255
        place = np.arange(8)
        self.bits = (symbol[:, None] >> (7 - place)) & 1
        nodes = (1 << place) | (symbol[:, None] >> (8 - place))
        n1, n0 = (counts[:, None] * self.bits).ravel(), (counts[:, None] * (1 - self.bits)).ravel()
        self.levels, below = {}, None
        for depth in range(DEPTH, SPLIT - 1, -1):
            keys = (((grams >> 8) & ((1 << 8 * depth) - 1))[:, None] << 8 | nodes).ravel()
            keys, at = np.unique(keys, return_inverse=True)
            a, b = np.bincount(at, n0, len(keys)), np.bincount(at, n1, len(keys))
            kt = log_kt(a, b)
            weighted, share = kt, np.ones(len(keys))
            if below is not None:
                parent = np.searchsorted(keys, below[0] & ((1 << 8 * (depth + 1)) - 1))
                weighted = _HALF + np.logaddexp(kt, np.bincount(parent, below[1], len(keys)))
                share = np.exp(_HALF + kt - weighted)
            self.levels[depth] = (keys, at.reshape(-1, 8), a, b, share)
            below = (keys, weighted)
        self.top = (below[0] >> 8, below[0] & 255, self.levels[SPLIT][2], self.levels[SPLIT][3], below[1])

    def ones(self) -> np.ndarray:
        """For each gram and bit, the probability of a one from depth SPLIT down."""
        p = None
        for depth in range(DEPTH, SPLIT - 1, -1):
            _, at, a, b, share = self.levels[depth]
            kt, share = ((b + 0.5) / (a + b + 1))[at], share[at]
            p = kt if p is None else share * kt + (1 - share) * p
        return p


def _by_context(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Rows that come in order of ``ctx``, in tables of about ``least`` rows; no context is in two."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        start = 0
        if size >= least:
            start = int(np.searchsorted(batch.column("ctx").to_numpy(), held[-1].column("ctx")[-1].as_py(), "right"))
            held.append(batch.slice(0, start))
            if start < len(batch):
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if start < len(batch):
            held.append(batch.slice(start))
            size += len(batch) - start
    if held:
        yield pa.Table.from_batches(held)


def _upper_weights(nodes: DataFrame) -> DataFrame:
    """``ctx, node, w, rest`` at depth SPLIT: the probability of a one is w plus rest
    times that from depth SPLIT down."""
    kt = lambda: (
        _log_gamma_sql(F.col("n0") + 0.5) + _log_gamma_sql(F.col("n1") + 0.5) - _log_gamma_sql(F.col("n0") + F.col("n1") + 1.0) - float(np.log(np.pi))
    )
    tables, below = {}, nodes
    for depth in range(SPLIT - 1, -1, -1):
        up = below.groupBy((F.col("ctx").bitwiseAND((1 << 8 * depth) - 1)).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")
        )
        up = up.withColumn("kt", kt())
        high = F.greatest("kt", "below")
        up = up.withColumn("weighted", F.lit(_HALF) + high + F.log(F.exp(F.col("kt") - high) + F.exp(F.col("below") - high)))
        share = F.exp(F.lit(_HALF) + F.col("kt") - F.col("weighted"))
        below = tables[depth] = cut(up.select("ctx", "node", "n0", "n1", "weighted", share.alias("share")))
    ratio = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    down = tables[0].select("ctx", "node", (F.col("share") * ratio).alias("w"), (1 - F.col("share")).alias("rest"))
    for depth in range(1, SPLIT + 1):
        above = down.select(F.col("ctx").alias("above"), F.col("node").alias("of"), "w", "rest")
        here = tables[depth] if depth < SPLIT else nodes
        joined = here.join(above, (F.col("node") == F.col("of")) & (F.col("ctx").bitwiseAND((1 << 8 * (depth - 1)) - 1) == F.col("above")))
        if depth == SPLIT:
            return joined.select("ctx", "node", "w", "rest")
        down = joined.select(
            "ctx", "node", (F.col("w") + F.col("rest") * F.col("share") * ratio).alias("w"), (F.col("rest") * (1 - F.col("share"))).alias("rest")
        )
    raise AssertionError


def learn(docs: DataFrame) -> DataFrame:
    """``gram, n, logp`` for every gram of ``docs(text, held_out)``."""
    grams = staged(gram_counts(docs).withColumn("ctx", F.shiftright("gram", 8).bitwiseAND((1 << 8 * SPLIT) - 1)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_context(batches):
            tree = Subtrees(found.column("gram").to_numpy(), found.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in tree.top], names=["ctx", "node", "n0", "n1", "weighted"])

    nodes = cut(grams.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(tops, "ctx long, node long, n0 double, n1 double, weighted double"))
    upper = _upper_weights(nodes)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _by_context(batches):
            own = found.filter(found.column("w").is_null())
            above = found.filter(found.column("w").is_valid())
            gram, n = own.column("gram").to_numpy(), own.column("n").to_numpy()
            tree = Subtrees(gram, n)
            key = above.column("ctx").to_numpy() << 8 | above.column("gram").to_numpy()
            order = np.argsort(key)
            at = order[np.searchsorted(key[order], tree.levels[SPLIT][0])][tree.levels[SPLIT][1]]
            one = above.column("w").to_numpy()[at] + above.column("rest").to_numpy()[at] * tree.ones()
            logp = np.log10(np.where(tree.bits == 1, one, 1 - one)).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n), pa.array(logp)], names=["gram", "n", "logp"])

    none = F.lit(None).cast("double")
    both = grams.select("ctx", "gram", "n", none.alias("w"), none.alias("rest")).union(
        upper.select("ctx", F.col("node").alias("gram"), F.lit(0).cast("long"), "w", "rest")
    )
    return staged(both.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(scored, "gram long, n long, logp double"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the highest counts, at most ``most``: whole steps of a fine logarithmic scale."""
    step = F.floor(F.log2(F.col("n") + 1) * 32)
    per = sorted(((r.s, r.k) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = float("inf"), 0
    for s, k in per:
        total += k
        if total > most or s < 32:
            break
        least = s
    return counts.where(step >= least) if least < float("inf") else counts.where("false")


class _Probed:
    """Gram codes to values, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 1.8))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left = np.arange(len(keys))
        for i in range(64):
            slots = self._slots(keys[left], i)
            free = self.keys[slots] == -1
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[left[put]], values[left[put]]
            left = np.delete(left, put)
            if not len(left):
                break

    def _slots(self, keys: np.ndarray, i: int) -> np.ndarray:
        mixed = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.view(np.int64) + i) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which keys have none."""
        slots = self._slots(keys, 0)
        out, missing = self.values[slots], self.keys[slots] != keys
        out[missing] = 0
        left = np.flatnonzero(missing & (self.keys[slots] != -1))
        for i in range(1, 64):
            if not len(left):
                break
            slots = self._slots(keys[left], i)
            at = self.keys[slots]
            right = at == keys[left]
            out[left[right]], missing[left[right]] = self.values[slots[right]], False
            left = left[~right & (at != -1)]
        return out, missing


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes,
    bits_per_byte`` for every row; logarithms to base 10 in the scores.

    Learns from the rows outside ``held_fold``.  Null texts count as empty; an empty
    text is its end alone.  Without training rows every count is 0.  Rows that repeat
    are scored each."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"))
    spark = docs.sparkSession
    words = staged(word_counts(docs))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = learn(docs)
    table = most_frequent(words, HOT_WORDS).toArrow()
    gains = np.concatenate(([0.0], np.log10(table.column("n").to_numpy().astype(np.float64) + 1)))
    grams = most_frequent(model, HOT_GRAMS).select("gram", "logp").toArrow()
    shared = spark.sparkContext.broadcast((table.column("word").to_pylist(), gains, grams.column("gram").to_numpy(), grams.column("logp").to_numpy().astype(np.float32)))
    del table, grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, gains, keys, values = shared.value
        known, probed = {w: i + 1 for i, w in enumerate(hot)}, _Probed(keys, values)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = {k: [] for k in ("n", "k", "base", "rare", "bytes", "logp", "grams")}
            for text in as_bytes(batch.column("text")):
                found = [*tokens(text), b""]
                at = np.fromiter((known.get(w, 0) for w in found), np.int64, len(found))
                out["n"].append(len(found))
                out["k"].append(int((at > 0).sum()))
                out["base"].append(float(gains[at].sum()))
                out["rare"].append([found[i] for i in np.flatnonzero(at == 0).tolist()])
                stream, total, rest = b" ".join(found[:-1]) + END, 0.0, []
                for chunk in _chunks(stream):
                    codes = gram_codes(chunk)
                    value, missing = probed.get(codes)
                    total += value.sum(dtype=np.float64)
                    rest.append(codes[missing])
                out["bytes"].append(len(stream))
                out["logp"].append(float(total))
                out["grams"].append(np.concatenate(rest))
            rows = pa.array(np.arange(row, row + len(batch)))
            row += len(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    rows, batch.column("doc_id"), batch.column("held_out"), pa.array(out["n"], pa.int64()), pa.array(out["k"], pa.int64()),
                    pa.array(out["base"], pa.float64()), pa.array(out["rare"], pa.list_(pa.binary())), pa.array(out["bytes"], pa.int64()),
                    pa.array(out["logp"], pa.float64()), list_column(out["grams"], pa.int64()),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "gain", "rare", "bytes", "logp", "grams"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, gain double, rare array<binary>, bytes long, logp double, grams array<long>"
    scanned = staged(docs.mapInArrow(run, schema))
    rare = scanned.select("row", F.explode("rare").alias("word")).join(words, "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_gain"))
    rest = scanned.select("row", F.explode("grams").alias("gram")).join(model.select("gram", F.col("logp").alias("lp")), "gram")
    rest = rest.groupBy("row").agg(F.sum("lp").alias("more_logp"))
    n, v = int(totals.n), int(totals.v)
    logp = F.col("logp") + F.coalesce("more_logp", F.lit(0.0))
    gain = F.col("gain") + F.coalesce("more_gain", F.lit(0.0))
    return (
        scanned.drop("rare", "grams").join(rare, "row", "left").join(rest, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (gain - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), logp.alias("score"), "bytes",
            (-logp / float(np.log10(2)) / F.col("bytes")).alias("bits_per_byte"),
        )
    )
