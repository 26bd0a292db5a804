"""Benchmark decontamination.

The windows of the test items form an index that is broadcast while it is small (its
bytes are counted first); a larger benchmark is dealt into blocks of bounded size, a longer
item into pieces that share all words of a window but one.  The documents are scanned for
one block after the other, and each index is dropped before the next one is made, so the
driver and the workers hold one at a time.  A scan looks up the words of a document in the
benchmark's vocabulary, keeps the runs of known words long enough for a window, hashes the
windows in them, and verifies every hash that is found against the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, boxed, list_column, mix64, staged

#: A-Z become a-z; ASCII other than letters and digits separates words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MAX_BYTES = 8 << 20  # of benchmark text in one broadcast index
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WindowIndex:
    """Windows of ``n`` words of the items; an item of fewer is one window of its own length.

    Of each length the distinct windows are rows of one array, in order of their hashes;
    the items of a window are a range of another."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item_id for item_id, _ in items]
        held: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            size = min(n, len(ids))
            if size:
                held.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), at))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in held.items():
            owner = np.repeat(np.array([at for _, at in found], np.int32), [len(w) for w, _ in found])
            rows, which = np.unique(np.concatenate([w for w, _ in found]), axis=0, return_inverse=True)
            sums = self._sums(rows)
            order = np.argsort(sums, kind="stable")
            place = np.argsort(order)[which.ravel()]
            pairs = np.unique(np.stack([place, owner], 1), axis=0)
            starts = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
            self.windows[size] = sums[order], rows[order], starts, pairs[:, 1].astype(np.int32)

    @staticmethod
    def _sums(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows), np.uint64)
        for j in range(rows.shape[1]):
            total = mix64(total + rows[:, j].astype(np.uint64) + np.uint64(1))
        return total

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, positions of the words that are hit, items found."""
        found = words(text)
        hit, items = np.zeros(len(found), bool), set()
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in found), np.int32, len(found))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, (sums, rows, starts, owners) in self.windows.items():
            if len(ids) < size:
                continue
            begins = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(begins):
                continue
            own = ids[begins[:, None] + np.arange(size)]
            hashes = self._sums(own)
            low, high = np.searchsorted(sums, hashes), np.searchsorted(sums, hashes, "right")
            for i in np.flatnonzero(low < high).tolist():  # a hash may stand for several windows
                for at in range(low[i], high[i]):
                    if (rows[at] == own[i]).all():
                        hit[begins[i] : begins[i] + size] = True
                        items.update(self.names[x] for x in owners[starts[at] : starts[at + 1]])
        return len(found), np.flatnonzero(hit), items


def _pieces(items: DataFrame, n: int, max_bytes: int) -> DataFrame:
    """Items of more than ``max_bytes`` as pieces; a window of ``n`` words is in one of them whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                found = words(text)
                if len(text) <= max_bytes or len(found) <= n:
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(found)], pa.binary())], names=["item_id", "text"])
                    continue
                per = max(1, max_bytes * len(found) // max(1, 2 * len(text)))
                for at in range(0, len(found) - n + 1, per):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(found[at : at + per + n - 1])], pa.binary())], names=["item_id", "text"])

    return items.mapInArrow(run, "item_id string, text binary")


def _blocks(benchmark: DataFrame, n: int, max_bytes: int) -> tuple[int, Callable[[int], WindowIndex]]:
    """Number of blocks of about ``max_bytes`` each, and what makes the index of one; one block if
    all items fit.

    An index takes some 20 to 40 bytes for a byte of text at most.  A benchmark of several
    blocks is read once, and kept by block in the shared folder."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).where("text is not null")
    total = items.select(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = -(-int(total) // max_bytes) or 1
    if parts == 1:
        return 1, lambda _: WindowIndex([(r.item_id or "", r.text.encode()) for r in items.collect()], n)
    pieces = _pieces(items, n, max_bytes).withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    kept = staged(pieces.repartition("block").sortWithinPartitions("block"))
    return parts, lambda k: WindowIndex([(r.item_id or "", bytes(r.text)) for r in kept.where(F.col("block") == k).select("item_id", "text").collect()], n)


def _over_batches(shared, text_col: str, make: Callable[[pa.RecordBatch, list], pa.RecordBatch]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            yield make(batch, [at.scan(t) for t in as_bytes(batch.column(text_col))])

    return run


def _each_block(rows: DataFrame, benchmark: DataFrame, n: int, max_bytes: int, text_col: str, make: Callable, schema, narrow: bool = False) -> list[DataFrame]:
    """What ``make`` makes of the rows and their hits, for each block of the benchmark.

    One block is one lazy scan.  Of several each scan is written before the next begins;
    with ``narrow`` a scan reads what the one before left, else all read the same rows."""
    parts, index_of = _blocks(benchmark, n, max_bytes)
    out: list[DataFrame] = []
    for k in range(parts):
        shared = rows.sparkSession.sparkContext.broadcast(index_of(k))
        found = rows.mapInArrow(_over_batches(shared, text_col, make(not k)), schema)
        if parts == 1:
            return [found]
        out.append(staged(found))
        shared.destroy()
        rows = out[-1] if narrow else rows
    return out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every row: the positions of the words that
    lie in an occurrence of a benchmark window, and the ids of the items found.

    Null and empty texts have no words; items without words are in no document;
    items with equal texts are all found.  Repeated rows stay repeated, with null ids among
    them; other columns make no difference."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def make(first: bool):
        def rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([x[0] for x in found], pa.int64()),
                    list_column([x[1] for x in found], pa.int32()), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                    pa.array([int(first)] * len(found), pa.int32()),
                ],
                names=["doc_id", "text_hash", "n_words", "hits", "items", "copies"],
            )
            return out if first else out.filter(pa.array([len(x[1]) > 0 for x in found], pa.bool_()))

        return rows

    schema = "doc_id long, text_hash long, n_words long, hits array<int>, items array<string>, copies int"
    parts = _each_block(base, benchmark, n, max_bytes, "text", make, schema)
    every = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return every.select("doc_id", "n_words", "hits", "items", "text_hash")
    # rows that repeat id and text have the same hits: those with any are one row before they meet
    same = ["doc_id", "text_hash", "n_words"]
    once = every.where("size(hits) > 0").dropDuplicates([*same, "hits", "items"])
    merged = once.groupBy(*same).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    rows = every.where("copies = 1").select(*same)
    joined = rows.join(merged.withColumnsRenamed({c: f"_{c}" for c in same}), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("n_words") == F.col("_n_words")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; all columns stay.

    Null and empty texts stay, whatever the ids; repeated rows stay or go together; with
    an empty benchmark all stay.  No column name clashes."""
    clean = lambda _: lambda batch, found: batch.filter(pa.array([len(x[1]) == 0 for x in found], pa.bool_()))
    return _each_block(docs, benchmark, n, max_bytes, text_col, clean, docs.schema, narrow=True)[-1]


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of benchmark windows removed from their texts.

    From each run of hit words the text goes from the run's first byte to its last;
    what stands between other words stays.  Texts without hits are unchanged."""
    import re

    hits = benchmark_hits(docs, benchmark, n, max_bytes, id_col, text_col).where(F.size("hits") > 0)
    hits = hits.select("doc_id", "text_hash", "hits").distinct()
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    @F.pandas_udf("string")
    def removed(text, positions):
        out = []
        for t, hit in zip(text, positions, strict=True):
            if hit is None:
                out.append(t)
                continue
            body = t.encode()
            spans = [m.span() for m in word.finditer(body)]
            kept, at, hit = [], 0, sorted(hit)
            for i, h in enumerate(hit):
                if not i or hit[i - 1] != h - 1:
                    kept.append(body[at : spans[h][0]])
                at = spans[h][1]
            out.append(b"".join([*kept, body[at:]]).decode())
        return __import__("pandas").Series(out, dtype=object)

    rows = boxed(docs, id=F.col(id_col).cast("long"), of=F.xxhash64(text_col))
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("text_hash")), "left")
    text = removed(F.col("row")[text_col], F.col("hits"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
