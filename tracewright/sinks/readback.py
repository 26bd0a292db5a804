"""Exported artifacts as tables again, a range of traces or samples at a time.

Each reads the files of a manifest in tasks and holds a few rows of one file."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import LABELS
from .formats import PNG_SIGNATURE

STEP = 1 << 20  # bytes that are taken at a time


def _per_file(manifest: DataFrame, artifact: str, read: Callable[[str], Iterator[list[pa.Array]]], schema: str) -> DataFrame:
    """What ``read`` makes of each file, with the section's id before it."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section, path in zip(batch.column("section_id").to_pylist(), batch.column("path").to_pylist(), strict=True):
                for columns in read(path):
                    yield pa.RecordBatch.from_arrays([pa.array([section] * len(columns[0]), pa.string()), *columns], names=["section_id", *names])

    files = manifest.where((F.col("status") == "written") & (F.col("artifact") == artifact)).select("section_id", "path")
    return files.repartition("path").mapInArrow(run, f"section_id string, {schema}")


def _rows_of(take: Callable[[int], bytes], row: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``n`` rows of ``row`` bytes each, some at a time, with the number of the first."""
    per = max(1, STEP // max(1, row))
    for first in range(0, n, per):
        k = min(per, n - first)
        yield first, np.frombuffer(take(k * row), np.uint8).reshape(k, row)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def masks_of(manifest: DataFrame) -> DataFrame:
    """``section_id, label_id, trace_idx, mask`` of archives; labels outside the catalog by their number."""
    ids = {n.replace(" ", "_"): i for i, n, *_ in LABELS}

    def read(path: str) -> Iterator[list[pa.Array]]:
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                key = name.removesuffix(".npy")
                label = ids.get(key) or int(key.removeprefix("label_"))
                with z.open(name) as f:
                    np.lib.format.read_magic(f)
                    (h, w), _, _ = np.lib.format.read_array_header_1_0(f)
                    for first, rows in _rows_of(f.read, w, h):
                        n = len(rows)
                        yield [pa.array([label] * n, pa.int32()), pa.array(np.arange(first, first + n, dtype=np.int32)), _lists(rows.astype(bool), pa.bool_())]

    return _per_file(manifest, "masks_npz", read, "label_id int, trace_idx int, mask array<boolean>")


def _inflated(f) -> Callable[[int], bytes]:
    """Bytes of an image's stream, from its data chunks as they come."""
    inflate, held, pending = zlib.decompressobj(), bytearray(), b""

    def take(n: int) -> bytes:
        nonlocal pending
        while len(held) < n:
            if not pending:
                size, kind = struct.unpack(">I4s", f.read(8))
                if kind == b"IEND":
                    held.extend(inflate.flush())
                    break
                data = f.read(size)
                f.read(4)
                pending = data if kind == b"IDAT" else b""
                continue
            held.extend(inflate.decompress(pending, n))
            pending = inflate.unconsumed_tail
        out = bytes(held[:n])
        del held[:n]
        return out

    return take


def overlays_of(manifest: DataFrame) -> DataFrame:
    """``section_id, trace_idx, r, g, b`` of images that the sink wrote."""

    def read(path: str) -> Iterator[list[pa.Array]]:
        with open(path, "rb") as f:
            if f.read(8) != PNG_SIGNATURE:
                raise ValueError(f"{path}: not a PNG file")
            w, h = struct.unpack(">8xII9x", f.read(25))
            for first, rows in _rows_of(_inflated(f), 1 + 3 * w, h):
                rgb = rows[:, 1:].reshape(len(rows), w, 3).astype(np.int32)
                yield [pa.array(np.arange(first, first + len(rows), dtype=np.int32)), *(_lists(np.ascontiguousarray(rgb[:, :, k]), pa.int32()) for k in range(3))]

    return _per_file(manifest, "overlay_png", read, "trace_idx int, r array<int>, g array<int>, b array<int>")


def volumes_of(manifest: DataFrame) -> DataFrame:
    """``section_id, sample_idx, label_ids`` (of all traces) of label volumes that the sink wrote."""

    def read(path: str) -> Iterator[list[pa.Array]]:
        with open(path, "rb") as f:
            head = f.read(1 << 12)
            extent = head.split(b'WholeExtent="', 1)[1].split(b'"', 1)[0].split()
            h, w = int(extent[1]), int(extent[3])
            f.seek(head.index(b"_", head.index(b"<AppendedData")) + 1 + 8)
            for first, rows in _rows_of(f.read, 4 * h, w):
                yield [pa.array(np.arange(first, first + len(rows), dtype=np.int32)), _lists(np.ascontiguousarray(rows).view("<i4"), pa.int32())]

    return _per_file(manifest, "labels_vti", read, "sample_idx int, label_ids array<int>")
