"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, shared_dir, staged  # noqa: F401  the other modules take them from here

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: bytes.split() with no argument splits on exactly the bytes 20 and 09 to 0D.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns, and all of ``docs`` in one struct ``row``, so that no name clashes."""
    return docs.select(*[c.alias(name) for name, c in columns.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def row_hash(docs: DataFrame, row: str = "row") -> Column:
    """A hash of all columns of ``docs``, which stand in the struct ``row``.

    Spark has no hash of maps and variants; columns that hold one count as JSON."""

    def hashable(kind: T.DataType) -> bool:
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return not isinstance(kind, T.MapType | T.VariantType) and all(map(hashable, inner))

    column = lambda name: F.col(row)[name]
    return F.xxhash64(*[column(f.name) if hashable(f.dataType) else F.to_json(F.struct(column(f.name))) for f in docs.schema.fields])


def bounded_sample(rows: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """At most ``most`` of ``total`` rows, drawn by a hash of ``key``; the same ones each time."""
    point = F.xxhash64(*key)
    share = min(1.0, 1.05 * most / max(total, 1))
    drawn = rows if share >= 1 else rows.where(F.pmod(point, F.lit(1 << 30)) < int(share * (1 << 30)))
    return drawn.orderBy(point, *key).limit(most)


def in_a_task(sample: DataFrame, make: Callable[[pa.Table], object]) -> object | None:
    """What ``make`` does with a bounded sample, worked out by one task: only its result
    comes to the driver.  None for an empty sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(pa.Table.from_batches(held)))])], names=["made"])

    found = sample.repartition(1).mapInArrow(run, "made binary").first()
    return pickle.loads(found.made) if found else None


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


BLOOM_BITS = 1 << 23


def slot_of(key: Column, bits: int = BLOOM_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bloom(slots: DataFrame, column: str, bits: int = BLOOM_BITS) -> np.ndarray:
    """A filter of a fixed number of bits with those of ``slots`` set.

    It never keeps out a key that was put in.  As its size doesn't grow with the
    keys, over very many keys it keeps out fewer of the others, which costs time
    only."""
    slot = F.col(column) + 1  # the bitmap functions number from one
    parts = (
        slots.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("part")).toArrow()
    )
    out = np.zeros(bits // 8, np.uint8)
    for bucket, part in zip(parts.column("bucket").to_pylist(), parts.column("part").to_pylist(), strict=True):
        at = int(bucket - 1) << 12
        out[at : at + (1 << 12)] = np.frombuffer(part, np.uint8)
    return out


def bloom_has(filter_bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (filter_bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


class WordHashes(dict):
    """Word bytes to a 64-bit hash, kept for words seen; emptied beyond ``limit``."""

    def __init__(self, of: Callable[[bytes], int] | None = None, limit: int = 1 << 17):
        import xxhash

        self.limit, self.of = limit, of or xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.of(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """Texts of an Arrow column as UTF-8, a null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for at in range(0, len(column), 512):  # few texts are Python objects at a time
        for x in column.slice(at, 512).cast(pa.large_binary()).to_pylist():
            yield x or b""


def long_array(values: np.ndarray) -> np.ndarray:
    """uint64 bits as the signed longs that Spark has."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
