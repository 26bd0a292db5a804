"""Removal of long repeated passages by level-wise doubling.

A window of ``window`` words is repeated only if the shorter windows inside it are.
The first level therefore looks at windows of a quarter of the length, one chosen
for every run of the full length (the one of least hash, so equal passages choose
alike).  Those that occur in one document only are dropped; the others are extended
to twice the length, to the right and to the left, and judged again; what survives
is extended to the full length, where windows are compared one by one.  A level
passes on a filter of fixed size over its survivors, which may let others through
but loses none; the last level names windows by 96 bits, from two hashes of each word.

Of equal texts only the first document takes part; in the others everything that
lies in a window is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, bloom, bloom_has, long_array, mix64, slot_of, staged

LEVEL_BITS = 1 << 26
_SHIFT = np.uint64(64 - 26)
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST_ID = (1 << 63) - 1


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, for as many words as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def window_hashes(h: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Hashes of all windows of ``width`` words, from their words' hashes."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(h))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return mix64((sums[width:] - sums[:-width]) * down[: len(h) - width + 1])


def _first_least(values: np.ndarray, span: int) -> np.ndarray:
    """Where the least of each ``span`` consecutive values is, the first of equal ones.

    Positions ride in the low bits, counted anew in each block of a long text, and minima
    of twice the length come from two of the last."""
    block = 1 << 19
    if len(values) > block + span:
        starts = range(0, len(values) - span + 1, block)
        return np.concatenate([at + _first_least(values[at : at + block + span - 1], span) for at in starts])
    low = np.uint64((1 << 20) - 1)
    least = (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.arange(len(least), dtype=np.uint64)
    return (starts + ((least - starts) & low)).view(np.int64)


class Windows:
    """What a scan needs of one document at each level."""

    def __init__(self, window: int):
        self.window, self.quarter = window, max(1, -(-window // 4))
        self.half = min(2 * self.quarter, window)
        self.table, self.second, self.powers = WordHashes(), WordHashes(xxhash.xxh64_intdigest), _Powers()

    def of(self, text: bytes, filters: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Hashes to judge at the level after the given filters, and where they start; at the
        last level also each window's second hash."""
        words = text.split()
        h = self.table.array(words)
        n, none = len(h), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        if n < self.window:
            return none
        short = window_hashes(h, self.quarter, self.powers)
        owner = _first_least(short, self.window - self.quarter + 1)
        anchors = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
        if not filters:
            return short[anchors], anchors
        passed = bloom_has(filters[0], (short[anchors] >> _SHIFT).view(np.int64))
        anchors = anchors[passed]
        if not len(anchors):
            return none
        longer, step = window_hashes(h, self.half, self.powers), self.half - self.quarter
        right = anchors[anchors + self.half <= n]
        left = anchors[anchors >= step]
        sides = longer[right], mix64(longer[left - step] + np.uint64(1))
        if len(filters) == 1:
            return np.concatenate(sides), np.concatenate((right, left))
        good = [np.zeros(n + 1, bool) for _ in sides]
        for ok, at, side in zip(good, (right, left), sides, strict=True):
            ok[at[bloom_has(filters[1], (side >> _SHIFT).view(np.int64))]] = True
        alive = np.zeros(n + 1, bool)
        alive[anchors] = True
        starts = np.arange(len(owner))
        keep = alive[owner]
        keep &= good[0][owner] | (starts + self.window < owner + self.half)  # the window doesn't hold the right one
        keep &= good[1][owner] | (starts > owner - step)
        starts = starts[keep]
        if not len(starts):
            return none
        named, check = (window_hashes(x, self.window, self.powers)[starts] for x in (h, self.second.array(words)))
        return named, starts, check


def _judged(docs: DataFrame, window: int, filters: list[np.ndarray]) -> DataFrame:
    """``hash, doc_id, name, check, start`` of the windows to judge at the next level; ``name``
    is the text's hash, to tell texts of one id apart, ``check`` 32 bits of the window's second hash.
    Only the last level has the last three."""
    placed = len(filters) == 2
    names_of = ["hash", "doc_id", *["name", "check", "start"] * placed]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first, held, size = Windows(window), {}, [], 0

        def rows() -> pa.RecordBatch:
            sizes = [len(x[2]) for x in held]
            doc, name = (np.repeat(np.array([x[i] for x in held], np.int64), sizes) for i in (0, 1))
            columns = [pa.array(long_array(np.concatenate([x[2] for x in held]))), pa.array(doc)]
            if placed:
                starts, check = (np.concatenate([x[i] for x in held]) for i in (3, 4))
                columns += [pa.array(name), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(starts.astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=names_of)

        for batch in batches:
            ids, names, crcs = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "crc"))
            for doc, name, crc, text in zip(ids, names, crcs, as_bytes(batch.column("text")), strict=True):
                if first.get((name, crc), _LAST_ID + 1) <= doc:
                    continue
                first[name, crc] = doc
                found = windows.of(text, shared.value)
                if len(found[0]):
                    held.append((doc, name, *found))
                    size += len(found[0])
                    if size >= 1 << 17:
                        yield rows()
                        held, size = [], 0
        if held:
            yield rows()

    return docs.mapInArrow(run, "hash long, doc_id long" + ", name long, check int, start int" * placed)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_words, n_removed`` for every row.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller id, in the input; ``text`` holds the other
    words, joined by one space.  Null and empty texts have no words.  A null id
    counts as the largest.  Rows that repeat an id are one document: they don't make
    each other repeated."""
    docs = docs.select(
        F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumns({"text_hash": F.xxhash64("text"), "crc": F.crc32("text")})
    source, filters = docs.drop("given"), []
    for _ in range(2):
        ends = _judged(source, window, filters).groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        slot = F.shiftrightunsigned("hash", 38).alias("slot")
        filters.append(bloom(ends.where("low <> high").select(slot).distinct(), "slot", LEVEL_BITS))
    full = staged(_judged(source, window, filters))
    low = full.groupBy("hash", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("hash", "check", "low")
    hits = full.join(staged(low), ["hash", "check"]).where("low < doc_id")
    hits = hits.groupBy("doc_id", F.col("name").alias("text_hash")).agg(F.collect_list("start").alias("starts"))
    firsts = docs.groupBy("text_hash", "crc").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    known = firsts.join(hits, ["doc_id", "text_hash"], "left").where("n > 1 or starts is not null")
    known = staged(known.select("text_hash", "crc", F.col("doc_id").alias("first"), "starts"))
    # texts that nothing is known of stay where they are; the others meet what is known
    slots = known.select(slot_of(F.col("text_hash"), LEVEL_BITS).alias("slot")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bloom(slots, "slot", LEVEL_BITS))
    routed = docs.withColumn("slot", slot_of(F.col("text_hash"), LEVEL_BITS))

    def kept(batch: pa.RecordBatch, known: bool) -> pa.RecordBatch:
        texts, counts, removed = [], [], []
        firsts, starts = ((batch.column(c).to_pylist() if known else [None] * len(batch)) for c in ("first", "starts"))
        for doc, first, at, text in zip(batch.column("doc_id").to_pylist(), firsts, starts, as_bytes(batch.column("text")), strict=True):
            words = text.split()
            n, left = len(words), words
            if first is not None and doc > first and n >= window:
                left = []
            elif at:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, np.array(at) + window, -1)
                left = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0).tolist()]
            texts.append(b" ".join(left).decode())
            counts.append(n)
            removed.append(n - len(left))
        columns = [batch.column("given"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "n_removed"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield kept(batch.filter(pa.array(~bloom_has(bits.value, batch.column("slot").to_numpy()))), False)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom_has(bits.value, batch.column("slot").to_numpy())))

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (kept(batch, True) for batch in batches)

    out = "doc_id long, text string, n_words long, n_removed long"
    met = routed.mapInArrow(touched, routed.schema).join(known, ["text_hash", "crc"], "left").select("given", "doc_id", "text", "first", "starts")
    return routed.mapInArrow(untouched, out).unionByName(met.mapInArrow(after, out))
