"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

A model file of the BPE kind with byte fallback is read here; its library is not needed.
Words are cut where no piece of the vocabulary can reach across, so they are encoded by
themselves, and a word that was met before is looked up.  New words lie in flat arrays of
symbols.  In each round the least rank of a pair is found for every word by a segmented
minimum, all its places are merged at once from the left, the arrays are compacted, and
words without a pair leave.

Merging all places at once is what merging one after the other gives as long as no pair
with the new symbol ranks before it or beside it.  A word with several places for a symbol
that the vocabulary has such a pair for (runs of blanks, whose pieces all have one score)
is finished by a heap.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, list_column

# Fixed values of the model format: field numbers, piece types, the blank's symbol.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_KIND = 2
BLANK = "▁"

_SHIFT = 21  # symbols are pieces, and characters beyond them: below 2^21
_NONE = np.int32(2**31 - 1)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tracewright-each-byte", _each_byte)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message of the file's encoding."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def _sorted_pairs(keys: list[int], *values: list[int]) -> tuple[np.ndarray, ...]:
    keys = np.array(keys, np.int64)
    order = np.argsort(keys)
    return keys[order], *(np.array(v, np.int32)[order] for v in values)


class PieceModel:
    """Vocabulary and merge tables of one model file."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(data):
            if field == PIECES:
                found = dict(_fields(value))
                pieces.append((found[1].decode(), struct.unpack("<f", found.get(2, bytes(4)))[0], found.get(3, NORMAL)))
            elif field == TRAINER:
                trainer = dict(_fields(value))
            elif field == NORMALIZER:
                normalizer = dict(_fields(value))
        # defaults of the format where a field is absent: 3 and 4 of the normaliser are true
        self.prefix = bool(normalizer.get(3, 1))
        if trainer.get(3, 1) != BPE_KIND or not trainer.get(35, 0):
            raise ValueError("only BPE models with byte fallback can be used")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models that normalise texts can't be used")
        if {kind for *_, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with pieces of the user can't be used")
        self.size = len(pieces)
        self.begin, self.end = (next((i for i, p in enumerate(pieces) if p[0] == s and p[2] == CONTROL), None) for s in ("<s>", "</s>"))
        if self.begin is None or self.end is None:
            raise ValueError("the model has no begin or end id")
        self.byte_id = np.zeros(256, np.uint32)
        self.shown: list[bytes] = []
        self.starts_blank = [kind == NORMAL and text.startswith(BLANK) for text, _, kind in pieces]
        self.silent = [kind == CONTROL for *_, kind in pieces]
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(text[1:-1], 16)] = i
            shown = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind)
            self.shown.append(bytes([int(text[1:-1], 16)]) if kind == BYTE else text.replace(BLANK, " ").encode() if shown is None else shown)
        self._merges([(i, text, score) for i, (text, score, kind) in enumerate(pieces) if kind == NORMAL])

    def _merges(self, normal: list[tuple[int, str, float]]) -> None:
        ids = {text: i for i, text, _ in normal}
        scores = np.full(self.size, -np.inf)
        scores[[i for i, *_ in normal]] = [s for *_, s in normal]
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int64)
        symbol = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else None)
        keys, ranks, into, near = [], [], [], set()
        self.early = np.zeros(self.size, bool)  # a pair with it may rank before or beside it
        for i, text, _ in normal:
            if len(text) == 1:
                self.char[ord(text)] = i
            near.update(zip(map(ord, text), map(ord, text[1:])))
            for cut in range(1, len(text)):
                left, right = symbol(text[:cut]), symbol(text[cut:])
                if left is None or right is None:
                    continue
                keys.append(left << _SHIFT | right)
                ranks.append(int(rank[i]))
                into.append(i)
                for part in (left, right):
                    if part < self.size and rank[i] <= rank[part]:
                        self.early[part] = True
        self.keys, self.ranks, self.into = _sorted_pairs(keys, ranks, into)
        self.of_pair = dict(zip(keys, zip(ranks, into, strict=True), strict=True))
        self.near = np.array(sorted(a << _SHIFT | b for a, b in near), np.int64)
        #: no piece has a blank after another character, so texts can be split before blanks
        self.splits = not any(b == ord(BLANK) != a for a, b in near)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int32)
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.into[at]

    def _by_heap(self, sym: list[int]) -> list[tuple[int, int]]:
        """Merges one after the other, the least rank first and then the leftmost: symbols and places."""
        before, after, size = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1], [1] * len(sym)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0:
                return
            if found := self.of_pair.get(sym[a] << _SHIFT | sym[b]):
                heapq.heappush(heap, (found[0], a, b, size[a] + size[b], found[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, n, into = heapq.heappop(heap)
            if not size[a] or not size[b] or size[a] + size[b] != n:
                continue
            sym[a], size[a], size[b], after[a] = into, n, 0, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [(s, i) for i, (s, n) in enumerate(zip(sym, size, strict=True)) if n]

    def merged(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        first = np.zeros(len(points) + 1, bool)
        first[bounds] = True
        if len(points) > 1 and len(self.near):
            pair = points[:-1] << _SHIFT | points[1:]
            first[1:-1] |= self.near[np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)] != pair
        sym, seg, at = self.char[points], np.cumsum(first[:-1]), np.arange(len(points))
        out_sym, out_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        new = np.ones(len(sym), bool)  # symbols whose pairs are to be looked up
        while len(sym):
            asked = np.flatnonzero((new | np.append(new[1:], False)) & np.append(seg[:-1] == seg[1:], False))
            rank[new] = _NONE
            rank[asked], into[asked] = self._pairs(sym[asked], sym[asked + 1])
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            counts = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            hit = rank == np.repeat(least, counts)
            by_heap = (np.add.reduceat(hit & (rank != _NONE) & self.early[into], starts) > 0) & (np.add.reduceat(hit, starts) > 1)
            for s in np.flatnonzero(by_heap).tolist():
                span = slice(starts[s], starts[s] + counts[s])
                found = self._by_heap(sym[span].tolist())
                out_sym.append(np.array([x for x, _ in found], np.int64))
                out_at.append(at[span][[i for _, i in found]])
            over = np.repeat(by_heap, counts)
            done = np.repeat(least == _NONE, counts)
            out_sym.append(sym[done])
            out_at.append(at[done])
            hit &= ~(done | over)
            # of places that overlap every other one from the left is merged
            index = np.arange(len(sym))
            begins = hit & ~np.concatenate(([False], hit[:-1]))
            hit &= (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            sym = np.where(hit, into, sym)
            live = ~(done | over)
            live[1:] &= ~hit[:-1]
            sym, seg, at, rank, into, new = sym[live], seg[live], at[live], rank[live], into[live], hit[live]
        sym, at = np.concatenate(out_sym), np.concatenate(out_at)
        order = np.argsort(at)
        return self._as_ids(sym[order], at[order], bounds)

    def _as_ids(self, sym: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Symbols as ids, characters beyond the vocabulary as those of their bytes."""
        point = sym - self.size
        width = np.where(point < 0, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        ids = np.repeat(sym, width).astype("<u4")
        ends = np.cumsum(width)
        for i in np.flatnonzero(point >= 0).tolist():
            ids[ends[i] - width[i] : ends[i]] = self.byte_id[list(chr(point[i]).encode())]
        offsets = np.concatenate(([0], ends))[np.searchsorted(at, bounds)]
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time."""
        if not text:
            return
        text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if not self.splits:
            yield [text]
            return
        begin = 0
        while begin < len(text):
            end = begin + SPAN
            while 0 <= end < len(text) and not (text[end] == BLANK != text[end - 1]):
                end = text.find(BLANK, end + 1)
            end = len(text) if end < 0 else min(end, len(text))
            yield _WORD.findall(text, begin, end)
            begin = end

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks for their symbol, one before the first piece left out, bytes as
        UTF-8 with each invalid one replaced."""
        parts, held, first = [], [], True
        for i in ids:
            if not self.silent[i]:
                shown = self.shown[i]
                held.append(shown[1:] if first and self.prefix and self.starts_blank[i] else shown)
                first = False
            elif held:
                parts.append(b"".join(held))
                held = []
        parts.append(b"".join(held))
        return "".join(p.decode("utf-8", "tracewright-each-byte") for p in parts)


SPAN = 1 << 20  # characters that are worked on at a time
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Encoder:
    """A model with the words met of late: about two times ``limit`` at most, none longer
    than ``longest``."""

    def __init__(self, model: PieceModel, limit: int = 1 << 17, longest: int = 64):
        self.model, self.limit, self.longest = model, limit, longest
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text between begin and end, as little-endian unsigned 32-bit integers."""
        begin, end = (struct.pack("<I", i) for i in (self.model.begin, self.model.end))
        out: list[list[bytes]] = [[begin] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for n, text in enumerate(texts):
            for words in self.model.words(text):
                held.append((n, words))
                size += sum(map(len, words))
                if size >= SPAN:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return [b"".join([*parts, end]) for parts in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        met = set().union(*(words for _, words in held))
        ids = {w: x for w in met if (x := self.known.get(w) or self.earlier.get(w))}
        new = [w for w in met if w not in ids]
        ids.update(zip(new, self.model.merged(new), strict=True))
        for n, words in held:
            out[n].append(b"".join(map(ids.__getitem__, words)))
        if len(self.known) > self.limit:
            self.known, self.earlier = {}, self.known
        self.known.update(item for item in ids.items() if len(item[0]) <= self.longest)


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    return Encoder(PieceModel(data))


def _model_bytes(docs: DataFrame, model_path: str):
    data = Path(model_path).read_bytes()
    PieceModel(data)  # a model that can't be used is an error here, not in tasks
    return docs.sparkSession.sparkContext.broadcast(data)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """Texts some at a time, a null as empty, by their number and size."""
    held, size = [], 0
    for i in range(len(column)):
        held.append(column[i].as_py() or "")
        size += len(held[-1])
        if len(held) >= 512 or size >= SPAN:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(docs: DataFrame, model_path: str, packed_ids: bool) -> DataFrame:
    """Whole rows with their ids; packed ones come with the text decoded from them."""
    shared = _model_bytes(docs, model_path)
    rows = boxed(docs, text=F.col("text"))
    more = "ids binary, decoded string" if packed_ids else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            at = 0
            for texts in _texts(batch.column("text")):
                found = encoder.encode(texts)
                ids = [np.frombuffer(x, "<u4") for x in found]
                row = batch.column("row").slice(at, len(texts))
                at += len(texts)
                if packed_ids:
                    decoded = pa.array([encoder.model.decode(x.tolist()) for x in ids], pa.string())
                    yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.binary()), decoded], names=["row", "ids", "decoded"])
                else:
                    yield pa.RecordBatch.from_arrays([row, list_column(ids, pa.int32())], names=["row", "ids"])

    fields = [T.StructField("row", rows.schema["row"].dataType), *T.StructType.fromDDL(more).fields]
    return rows.mapInArrow(run, T.StructType(fields))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """All of each row of ``docs`` as ``row``, and ``ids``, begin and end among them.

    A null text counts as empty and has these two ids.  Null and repeated ids and
    repeated rows make no difference, texts of any length are encoded whole, an empty
    table gives an empty one, and no column name clashes.  Only the model, a file of
    fixed size, is sent to the workers; nothing is shuffled."""
    return _encoded(docs, model_path, False)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of its ids; null ids give null, and an id beyond the
    vocabulary is an error, as in the library."""
    shared = _model_bytes(rows, model_path)

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202  pandas Series; annotations here would be read by Spark
        model = _encoder(shared.value).model
        return ids.map(lambda x: None if x is None else model.decode(list(x)))

    return rows.withColumn("decoded", text_of(F.col(ids_col)))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``row``, ``ids`` as the bytes of little-endian
    unsigned 32-bit integers, and ``decoded``.  Odd rows are as in ``encode``."""
    return _encoded(docs, model_path, True)
