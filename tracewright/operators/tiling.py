"""Overlapping tiles over padded sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import covering_starts, gray_level, tile_starts
from ..sources.segy import window_starts_between as _between
from .normalize import gray_traces, section_shape

TILE, STRIDE = 1024, 512
BATCH_BYTES = 1 << 22  # of tiles that are passed on together


def padded_shape(shapes: DataFrame, tile: int = TILE) -> DataFrame:
    return shapes.select(
        "section_id", F.greatest("n_traces", F.lit(tile)).alias("padded_h"), F.greatest("n_samples", F.lit(tile)).alias("padded_w"),
        F.col("n_traces").alias("orig_h"), F.col("n_samples").alias("orig_w"),
    )


def tile_grid(shapes: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """``section_id, tile_y, tile_x, padded_h, padded_w, orig_h, orig_w``: all windows."""
    padded = padded_shape(shapes, tile)
    rows = padded.withColumn("tile_y", F.explode(tile_starts(F.col("padded_h"), tile, stride)))
    rows = rows.withColumn("tile_x", F.explode(tile_starts(F.col("padded_w"), tile, stride)))
    return rows.select("section_id", "tile_y", "tile_x", "padded_h", "padded_w", "orig_h", "orig_w")


def edge_pad(gray: DataFrame, tile: int = TILE, shapes: DataFrame | None = None) -> DataFrame:
    """Grey traces, grown at the bottom and right to the tile size by repeating the edge.

    The last trace becomes several rows where it stands; nothing is joined but shapes,
    which are worked out from ``gray`` only where none are given."""
    padded = padded_shape(section_shape(gray, "gray") if shapes is None else shapes, tile)
    rows = gray.join(F.broadcast(padded), "section_id")
    wide = F.concat("gray", F.array_repeat(F.element_at("gray", -1), F.col("padded_w") - F.size("gray")))
    until = F.when(F.col("trace_idx") == F.col("orig_h") - 1, F.col("padded_h") - 1).otherwise(F.col("trace_idx"))
    rows = rows.withColumn("gray", F.when(F.size("gray") > 0, wide).otherwise(F.col("gray")))
    return rows.withColumn("trace_idx", F.explode(F.sequence("trace_idx", until.cast("int")))).select(
        "section_id", "trace_idx", "gray", "padded_h", "padded_w", "orig_h", "orig_w"
    )


def crop(padded: DataFrame, values_col: str = "gray") -> DataFrame:
    """Rows and values of the unpadded section."""
    return padded.where("trace_idx < orig_h").withColumn(values_col, F.slice(values_col, F.lit(1), F.col("orig_w")))


def tile_pixels(padded: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """How many tiles cover each pixel: ``section_id, trace_idx, sample_idx, n_tiles``.

    Counted along each axis by itself, so no pixel meets a tile in a join."""
    rows = padded.withColumn("ys", F.size(covering_starts(F.col("padded_h"), F.col("trace_idx"), tile, stride)))
    rows = rows.select("section_id", "trace_idx", "ys", "padded_w", F.explode(F.sequence(F.lit(0), F.col("padded_w") - 1)).alias("sample_idx"))
    xs = F.size(covering_starts(F.col("padded_w"), F.col("sample_idx"), tile, stride))
    return rows.select("section_id", "trace_idx", "sample_idx", (F.col("ys") * xs).alias("n_tiles"))


def tile_cut(padded: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """``section_id, tile_y, tile_x, pixels``: tiles as bytes, trace after trace.

    A trace goes to the bands of tiles that cover it (two inside a section at half
    overlap), and the columns are cut after the shuffle, so it is moved twice and not
    four times.  A group is one band of ``tile`` traces; its tiles are slices of one
    array of bytes."""
    banded = padded.withColumn("tile_y", F.explode(covering_starts(F.col("padded_h"), F.col("trace_idx"), tile, stride)))
    bands = banded.groupBy("section_id", "tile_y", "padded_w").agg(F.array_sort(F.collect_list(F.struct("trace_idx", "gray"))).alias("band"))
    bands = bands.select("section_id", "tile_y", tile_starts(F.col("padded_w"), tile, stride).alias("xs"), F.transform("band", lambda t: t["gray"]).alias("band"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def tiles() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["section_id", "tile_y", "tile_x", "pixels"])

        for batch in batches:
            bands, every = batch.column("band"), batch.column("xs")
            for section, y, band, xs in zip(batch.column("section_id").to_pylist(), batch.column("tile_y").to_pylist(), bands, every, strict=True):
                traces = band.values
                image = traces.flatten().to_numpy().astype(np.uint8).reshape(len(traces), -1)
                for x in xs.values.to_pylist():
                    held.append((section, y, x, np.ascontiguousarray(image[:, x : x + tile]).tobytes()))
                    size += len(held[-1][3])
                    if size >= BATCH_BYTES:
                        yield tiles()
                        held, size = [], 0
        if held:
            yield tiles()

    return bands.mapInArrow(cut, "section_id string, tile_y int, tile_x int, pixels binary")


#: How long blocks of a section are, in strides (at half overlap), and how many are aimed at.
FEWEST_UNITS, MOST_UNITS, BLOCKS = 4, 16, 64


def deal_blocks(gray: DataFrame, shapes: DataFrame, tile: int = TILE, stride: int = STRIDE, whole: bool = True) -> DataFrame:
    """Traces as bytes (``gray_bytes``) dealt by blocks of bands and in order, for ``block_tiles``.

    A trace is moved once, and those at the ends of a block twice.  With ``whole`` a block has
    all tiles that reach its traces, so that nothing is left to fuse between blocks; at half
    overlap that is one band more for each 4 (short sections) to 16 (long ones).  Otherwise
    each tile is cut once, in the block that it begins in."""
    traces, y = F.col("n_traces"), covering_starts(F.greatest("n_traces", F.lit(tile)), F.col("trace_idx"), tile, stride)
    unit = max(stride, tile - stride)
    size = unit * F.greatest(F.lit(FEWEST_UNITS), F.least(F.lit(MOST_UNITS), F.ceil(traces / (BLOCKS * unit)))).cast("int")
    block = lambda trace: F.floor(trace / F.col("size")).cast("int")
    last = F.element_at("ys", -1)
    last = F.least(block(last + (tile - 1)), block(traces - 1)) if whole else block(last)
    rows = gray.join(F.broadcast(shapes.where("n_samples > 0")), "section_id").withColumns({"ys": y, "size": size}).where("size(ys) > 0")
    rows = rows.withColumn("block", F.explode(F.sequence(block(F.col("ys")[0]), last)))
    # a block costs much more than its bytes say: without a number Spark would make one task of many
    spark = gray.sparkSession
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.select("section_id", "block", "trace_idx", "gray", "n_traces", "n_samples", "size").repartition(tasks, "section_id", "block")
    return rows.sortWithinPartitions("section_id", "block", "trace_idx")


def block_tiles(batches: Iterator[pa.RecordBatch], tile: int, stride: int, whole: bool) -> Iterator[tuple]:
    """The tiles of ``deal_blocks`` in a task, band after band: section, first trace and sample,
    traces and samples of the section, first and last trace (not included) that the block is
    asked for, the traces that the band lacks (0 in its tiles), and the image.

    One band is held, as bytes."""

    def band(key: tuple, y: int, rows: dict) -> Iterator[tuple]:
        section, block, n_traces, n_samples, size = key
        width, until = max(tile, n_samples), min(n_traces, y + tile)
        image = np.zeros((tile, width), np.uint8)
        for t, row in rows.items():
            if y <= t < until:
                image[t - y, : len(row)] = row
                image[t - y, len(row) :] = row[-1] if len(row) else 0
        image[until - y :] = image[until - y - 1]
        absent = [t for t in range(y, until) if t not in rows] if len(rows) < until - y else []
        own = (block * size, min((block + 1) * size, n_traces)) if whole else (0, n_traces)
        for x in [0] if width == tile else sorted({*range(0, width - tile + 1, stride), width - tile}):
            yield section, y, x, n_traces, n_samples, *own, absent, np.ascontiguousarray(image[:, x : x + tile])

    key, ys, rows = None, [], {}  # the block, its bands that are still to come, and their traces so far
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in ("section_id", "block", "n_traces", "n_samples", "size")), strict=True)
        for now, t, row in zip(keys, batch.column("trace_idx").to_pylist(), batch.column("gray"), strict=True):
            while ys and rows and (now != key or t >= ys[0] + tile):
                yield from band(key, ys.pop(0), rows)
                rows = {k: v for k, v in rows.items() if ys and k >= ys[0]}
            if now != key:
                key, rows = now, {}
                _, block, n_traces, _, size = now
                ys = _between(n_traces, tile, stride, block * size - (tile - 1 if whole else 0), min((block + 1) * size, n_traces) - 1)
            while ys and t >= ys[0] + tile:  # no trace of it is there
                ys.pop(0)
            rows.setdefault(t, np.frombuffer(row.as_buffer(), np.uint8).copy())
    while ys and rows:
        yield from band(key, ys.pop(0), rows)
        rows = {k: v for k, v in rows.items() if ys and k >= ys[0]}


MOST_BOUNDS = 1 << 16


def tile_cut_scanned(bands: DataFrame, bounds: DataFrame, tile: int = TILE, stride: int = STRIDE) -> DataFrame:
    """The tiles of ``tile_cut`` from the bands of a source (``read_bands``), without a shuffle, with
    ``n_traces`` and ``n_samples`` of the section; a band's tiles follow one another.

    ``bounds`` are sent to the bands while they are at most ``MOST_BOUNDS`` sections; beyond
    that traces are padded and dealt as usual.  A task holds one band, as bytes."""
    traces = bands.where("status = 'ok'")
    if bounds.limit(MOST_BOUNDS + 1).count() > MOST_BOUNDS:
        once = traces.dropDuplicates(["section_id", "trace_idx"])
        cut = tile_cut(edge_pad(gray_traces(once, bounds), tile), tile, stride)
        return cut.join(section_shape(once), "section_id").sortWithinPartitions("section_id", "tile_y", "tile_x")
    levels = F.transform("samples", lambda v: gray_level(v, F.col("lo"), F.col("hi")))
    gray = traces.join(F.broadcast(bounds), "section_id").select("section_id", "tile_y", "trace_idx", "n_traces", "n_samples", levels.alias("gray"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, rows = None, []

        def tiles() -> pa.RecordBatch:
            section, y, n_traces, n_samples = band
            image = np.stack(rows)
            image = np.pad(image, ((0, max(0, tile - len(rows))), (0, max(0, tile - n_samples))), "edge")
            width = image.shape[1]
            xs = [0] if width == tile else sorted({*range(0, width - tile + 1, stride), width - tile})
            pixels = [np.ascontiguousarray(image[:, x : x + tile]).tobytes() for x in xs]
            n, whole = len(xs), lambda v: pa.array([v] * len(xs), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([section] * n), whole(y), pa.array(xs, pa.int32()), pa.array(pixels, pa.binary()), whole(n_traces), whole(n_samples)], names=["section_id", "tile_y", "tile_x", "pixels", "n_traces", "n_samples"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("section_id", "tile_y", "n_traces", "n_samples")), strict=True)
            levels = batch.column("gray")
            for key, one in zip(keys, levels, strict=True):
                if key != band:
                    band, rows = key, []
                rows.append(one.values.to_numpy().astype(np.uint8))
                if len(rows) == min(tile, key[2] - key[1]):
                    yield tiles()
                    rows = []

    return gray.where("n_samples > 0").mapInArrow(cut, "section_id string, tile_y int, tile_x int, pixels binary, n_traces int, n_samples int")
