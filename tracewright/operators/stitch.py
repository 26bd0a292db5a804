"""Fusing overlapping tile scores into section maps by their maximum."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources.segy import window_starts_between as _between
from .scoring import Scorer, scored
from .tiling import block_tiles


def strips_long(strips: DataFrame) -> DataFrame:
    """Placed pixels: ``section_id, label_id, trace_idx, sample_idx, prob``; failed tiles have none."""
    return strips.select(
        "section_id", "label_id", (F.col("tile_y") + F.col("row_off")).alias("trace_idx"), "tile_x", F.posexplode("probs").alias("off", "prob")
    ).select("section_id", "label_id", "trace_idx", (F.col("tile_x") + F.col("off")).alias("sample_idx"), "prob")


def stitch_long(pixels: DataFrame) -> DataFrame:
    """One row per pixel with the greatest of 0 and its scores; NaN wins."""
    keys = ["section_id", "label_id", "trace_idx", "sample_idx"]
    return pixels.groupBy(*keys).agg(F.greatest(F.lit(0.0).cast("float"), F.max("prob")).alias("prob"))


def stitch_strips(strips: DataFrame) -> DataFrame:
    """The rows of ``stitch_long`` over ``strips_long``, from traces that are fused before they
    become pixels."""
    return strips_long(fuse_strips(strips))


def fuse_strips(strips: DataFrame) -> DataFrame:
    """Strips that don't overlap: one for each stretch of a trace that some strip covers, with the
    greatest of 0 and its scores; NaN wins.

    Only strips are shuffled.  Those of a trace follow one another and are folded as they
    come, so a task holds a batch of them and one trace, however often strips repeat."""
    keys = ["section_id", "label_id", "trace_idx"]
    placed = strips.where("size(probs) > 0").select("section_id", "label_id", (F.col("tile_y") + F.col("row_off")).alias("trace_idx"), "tile_x", F.col("probs").cast("array<float>").alias("probs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_trace = None  # the last trace of the batches so far may go on
        for batch in batches:
            if batch.num_rows:
                fused, last = _folded(batch if open_trace is None else pa.concat_batches([open_trace, batch]))
                open_trace = fused.slice(last)
                yield _as_strips(fused.slice(0, last))
        if open_trace is not None:
            yield _as_strips(open_trace)

    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schemas.STRIPS)


def _folded(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, int]:
    """Placed strips, those of a trace one after the other, fused to stretches; and the number of
    the stretch that the last trace begins with."""
    codes = batch.column("section_id").dictionary_encode().indices, batch.column("label_id"), batch.column("trace_idx")
    new = np.zeros(len(batch), bool)
    new[0] = True
    for c in codes:
        lost, values = c.is_null().to_numpy(zero_copy_only=False), pc.fill_null(c, 0).to_numpy()
        new[1:] |= (values[1:] != values[:-1]) | (lost[1:] != lost[:-1])
    firsts = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    parts, xs = batch.column("probs"), batch.column("tile_x").to_numpy().astype(np.int64)
    lengths = np.diff(parts.offsets.to_numpy())
    low, high = np.minimum.reduceat(xs, firsts), np.maximum.reduceat(xs + lengths, firsts)
    ends = np.cumsum(high - low)
    begins = ends - (high - low)
    out, covered = np.zeros(int(ends[-1]), np.float32), np.zeros(int(ends[-1]), bool)
    flat, at = pc.fill_null(parts.flatten(), 0.0).to_numpy(), 0
    for begin, n in zip((begins[of] + xs - low[of]).tolist(), lengths.tolist(), strict=True):
        np.maximum(out[begin : begin + n], flat[at : at + n], out=out[begin : begin + n])
        covered[begin : begin + n] = True
        at += n
    starts, stops = covered.copy(), covered.copy()
    starts[1:] &= ~covered[:-1]
    stops[:-1] &= ~covered[1:]
    starts[begins] = stops[ends - 1] = True  # both ends of a trace are covered
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    trace = np.searchsorted(begins, starts, "right") - 1
    probs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int32)), pa.array(out[covered]))
    same = pa.array(firsts[trace])
    columns = [*(batch.column(c).take(same) for c in ("section_id", "label_id", "trace_idx")), pa.array((low[trace] + starts - begins[trace]).astype(np.int32)), probs]
    fused = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return fused, int(np.searchsorted(trace, trace[-1]))


def _as_strips(fused: pa.RecordBatch) -> pa.RecordBatch:
    section, label, trace, x, probs = fused.columns
    return pa.RecordBatch.from_arrays([section, label, trace, x, pa.array(np.zeros(len(fused), np.int32)), probs], names=["section_id", "label_id", "tile_y", "tile_x", "row_off", "probs"])


def stitch_packed(strips: DataFrame, shapes: DataFrame) -> DataFrame:
    """``section_id, label_id, trace_idx, probs``, cropped to the section.

    Only the strips themselves are shuffled.  Those of a trace are few (of the tiles along
    it, twice), and are folded into one array.  Traces and samples under no tile are 0 if
    another tile of the label reaches the trace; NaN wins."""
    return stitch_with_failures(strips.where("probs is not null"), shapes).select("section_id", "label_id", "trace_idx", "probs")


def stitch_with_failures(strips: DataFrame, shapes: DataFrame) -> DataFrame:
    """``stitch_packed`` with the tiles that failed, in one pass over the scored strips.

    A row of these has ``error``, the tile's first trace as ``trace_idx``, in ``tile_xs``
    the first samples of its tiles, and neither label nor ``probs``."""
    lost = F.col("probs").isNull()
    placed = strips if "error" in strips.columns else strips.withColumn("error", F.lit(None).cast("string"))
    placed = placed.join(F.broadcast(shapes), "section_id").withColumn("trace_idx", F.col("tile_y") + F.coalesce("row_off", F.lit(0)))
    placed = placed.where((lost & F.col("error").isNotNull()) | (~lost & F.expr("trace_idx < n_traces and tile_x < n_samples")))
    lists = placed.groupBy("section_id", "label_id", "trace_idx", "n_samples", "error").agg(F.collect_list("tile_x").alias("xs"), F.collect_list("probs").alias("parts"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = batch.column("error").is_valid().to_numpy(zero_copy_only=False)
            widths = np.where(failed, 0, batch.column("n_samples").to_numpy()).astype(np.int64)
            ends = np.cumsum(widths)
            out = np.zeros(int(widths.sum()), np.float32)
            xs, parts = batch.column("xs"), batch.column("parts")
            of = np.repeat(np.arange(len(batch)), np.diff(parts.offsets.to_numpy()))
            starts = xs.filter(pa.array(~failed)).flatten().to_numpy()  # a failed row has no parts
            values = parts.flatten()
            lengths = np.diff(values.offsets.to_numpy())
            flat, at = values.flatten().to_numpy(), 0
            for row, x, n in zip(of.tolist(), starts.tolist(), lengths.tolist(), strict=True):
                begin, keep = int(ends[row] - widths[row]) + x, min(n, int(widths[row]) - x)
                np.maximum(out[begin : begin + keep], flat[at : at + keep], out=out[begin : begin + keep])
                at += n
            probs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("section_id", "label_id", "trace_idx")), probs, xs, batch.column("error")], names=["section_id", "label_id", "trace_idx", "probs", "tile_xs", "error"])

    return lists.mapInArrow(fold, "section_id string, label_id int, trace_idx int, probs array<float>, tile_xs array<int>, error string")


_SCANNED_NAMES = ["section_id", "label_id", "trace_idx", "probs", "seam", "tile_xs", "error"]
SCANNED = "section_id string, label_id int, trace_idx int, probs array<float>, seam boolean, tile_xs array<int>, error string"


def fuse_scanned(tiles: DataFrame, make_scorer: Callable[[], Scorer], tile: int, stride: int) -> DataFrame:
    """Tiles that are in order of bands within their partitions (``tile_cut_scanned``), scored and
    fused where they lie: ``section_id, label_id, trace_idx, probs, seam``.

    A task adds its bands to one window of traces as they come and passes on what no later
    band reaches.  A trace is a seam if a band of another task covers it too.  Tiles that
    fail are rows as in ``stitch_with_failures``.  A task holds a band of maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def images() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("section_id", "tile_y", "tile_x", "n_traces", "n_samples", "pixels")), strict=True):
                    key = tuple(x.as_py() for x in row[:5])
                    yield *key, 0, key[3], [], np.frombuffer(row[5].as_buffer(), np.uint8).reshape(tile, -1)

        yield from _together(_fused(images(), make_scorer, tile, stride))

    return tiles.select("section_id", "tile_y", "tile_x", "n_traces", "n_samples", "pixels").mapInArrow(run, SCANNED)


def fuse_blocks(traces: DataFrame, make_scorer: Callable[[], Scorer], tile: int, stride: int, whole: bool = True) -> DataFrame:
    """The same from traces dealt by blocks (``deal_blocks``, as ``whole`` there), whose tiles are
    cut, scored and fused in one task.  With ``whole`` no trace is a seam.  Traces that a
    section lacks have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _together(_fused(block_tiles(batches, tile, stride, whole), make_scorer, tile, stride))

    return traces.mapInArrow(run, SCANNED)


def _fused(tiles: Iterator[tuple], make_scorer: Callable[[], Scorer], tile: int, stride: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``fuse_scanned`` from a task's tiles as ``block_tiles`` gives them."""
    window, section, seen = {}, None, []  # by label: the first trace, and maps from there on
    lacking = set()  # traces that bands of the section lack

    def passed(until: int | None) -> Iterator[pa.RecordBatch]:
        """Rows of the traces before ``until``; of all that are left where it is None."""
        name, n_traces, n_samples, *own = section
        for label, (first, maps) in list(window.items()):
            n = len(maps) if until is None else max(0, min(until, first + len(maps)) - first)
            window[label] = (first + n, maps[n:])
            traces = np.arange(first, first + n)
            asked = (traces >= own[0]) & (traces < own[1])
            if lacking:
                asked &= ~np.isin(traces, list(lacking))
            if not asked.all():
                traces, maps = traces[asked], maps[:n][asked]
            if n := len(traces):
                # bands that reach these traces: those of this task, and a few around them
                others = [y for y in _between(n_traces, tile, stride, int(traces[0]) - tile + 1, int(traces[-1])) if y not in seen]
                seam = np.zeros(n, bool)
                for y in others:
                    seam |= (traces >= y) & (traces < y + tile)
                probs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_samples), pa.array(maps[:n].ravel()))
                columns = [pa.array([name] * n, pa.string()), pa.array([label] * n, pa.int32()), pa.array(traces.astype(np.int32)), probs, pa.array(seam), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=_SCANNED_NAMES)
        if until is None:
            window.clear()
        lacking.difference_update([t for t in lacking if until is None or t < until])

    for key, found, error in scored(((x[:8], x[1], x[2], x[8]) for x in tiles), make_scorer):
        at = (key[0], *key[3:7])
        if section is not None and (at != section or key[1] not in seen):
            # bands that a task has end where the next one of them begins
            yield from passed(key[1] if at == section and key[1] > seen[-1] else None)
            seen = seen if at == section and key[1] > seen[-1] else []
        section = at
        lacking.update(key[7] or ())
        if key[1] not in seen:
            seen.append(key[1])
        if error is not None:
            if not key[5] <= key[1] < key[6]:
                continue  # the block that the tile begins in tells of it
            columns = [pa.array([key[0]]), pa.nulls(1, pa.int32()), pa.array([key[1]], pa.int32()), pa.nulls(1, pa.list_(pa.float32())), pa.array([False]), pa.array([[key[2]]], pa.list_(pa.int32())), pa.array([error])]
            yield pa.RecordBatch.from_arrays(columns, names=_SCANNED_NAMES)
            continue
        h, w = min(tile, key[3] - key[1]), min(tile, key[4] - key[2])
        for label, probs in found:
            first, maps = window.get(label, (key[1], np.zeros((0, key[4]), np.float32)))
            first = first if len(maps) else key[1]  # traces between the bands of a task aren't its own
            if short := key[1] + h - first - len(maps):
                maps = np.concatenate([maps, np.zeros((max(0, short), key[4]), np.float32)])
            probs = np.asarray(probs, np.float32)[:h, :w]
            part = maps[key[1] - first : key[1] - first + probs.shape[0], key[2] : key[2] + probs.shape[1]]
            np.maximum(part, probs, out=part)
            window[label] = (first, maps)
    if section is not None:
        yield from passed(None)


BATCH_BYTES = 1 << 22  # of maps that are passed on together


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for one in batches:
        held.append(one)
        size += one.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def join_seams(scanned: DataFrame) -> DataFrame:
    """``section_id, label_id, trace_idx, probs`` of ``fuse_scanned``: only seams are shuffled.

    The parts of a seam are those of the few tasks that share it.  ``scanned`` is used twice,
    so it should be a table that was written."""
    kept = scanned.where("error is null and not seam").select("section_id", "label_id", "trace_idx", "probs")
    parts = scanned.where("error is null and seam").groupBy("section_id", "label_id", "trace_idx").agg(F.collect_list("probs").alias("parts"))
    most = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: F.greatest(p, q)))
    return kept.unionByName(parts.select("section_id", "label_id", "trace_idx", most.alias("probs")))


def packed_long(maps: DataFrame, values_col: str = "probs", name: str = "prob") -> DataFrame:
    return maps.select("section_id", "label_id", "trace_idx", F.posexplode(values_col).alias("sample_idx", name))
