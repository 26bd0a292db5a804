"""Masks and what is counted over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_on

THRESHOLD = 0.5


def binarize(pixels: DataFrame, threshold: float = THRESHOLD, prob_col: str = "prob", name: str = "mask") -> DataFrame:
    """Long probabilities with a boolean mask."""
    return pixels.withColumn(name, is_on(F.col(prob_col), threshold))


def binarize_packed(maps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``section_id, label_id, trace_idx, mask`` with an array of booleans per trace."""
    return maps.select("section_id", "label_id", "trace_idx", F.transform("probs", lambda p: is_on(p, threshold)).alias("mask"))


BITS = "section_id string, label_id int, trace_idx int, n_samples int, bits binary"


def _bits(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Booleans of rows of given sizes, a bit each, a row from a byte on; rows of one size at once."""
    if len(sizes) and (sizes == sizes[0]).all():
        return [x.tobytes() for x in np.packbits(flat.reshape(len(sizes), -1), axis=1)] if sizes[0] else [b""] * len(sizes)
    return [np.packbits(x).tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def binarize_bits(maps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``section_id, label_id, trace_idx, n_samples, bits``: masks of a bit a pixel, the first in
    the highest bit of a byte; bits beyond the last sample are off.  NaN and null never reach
    the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("probs")
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            with np.errstate(invalid="ignore"):
                on = np.asarray(flat, np.float32) >= np.float32(threshold)
            columns = [*(batch.column(c) for c in ("section_id", "label_id", "trace_idx")), pa.array(sizes.astype(np.int32)), pa.array(_bits(on, sizes), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["section_id", "label_id", "trace_idx", "n_samples", "bits"])

    return maps.select("section_id", "label_id", "trace_idx", F.col("probs").cast("array<float>")).mapInArrow(run, BITS)


def masks_from_bits(bits: DataFrame) -> DataFrame:
    """``section_id, label_id, trace_idx, mask`` with an array of booleans per trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_samples").to_numpy()
            rows = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(batch.column("bits").to_pylist(), sizes, strict=True)]
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            mask = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(bool) if rows else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("section_id", "label_id", "trace_idx")), mask], names=["section_id", "label_id", "trace_idx", "mask"])

    return bits.mapInArrow(run, "section_id string, label_id int, trace_idx int, mask array<boolean>")


def _ones(bits: Column) -> Column:
    return F.bitmap_count(bits)


def bit_counts(bits: DataFrame) -> DataFrame:
    """Partial counts for ``coverage``; bits are counted as they lie."""
    return bits.select("section_id", "label_id", _ones(F.col("bits")).alias("n_on"), F.col("n_samples").cast("long").alias("n"))


def bits_any(bits: DataFrame) -> DataFrame:
    """``mask_any`` of bit masks."""
    return bits.groupBy("section_id", "label_id").agg(F.bool_or(_ones(F.col("bits")) > 0).alias("mask_any"))


def label_volume_bits(bits: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``section_id, trace_idx, label_ids`` from bit masks: of a trace's masks the highest label.

    The masks of a trace, at most one for each label, meet as bits."""
    known = bits if labels is None else bits.join(F.broadcast(labels.select("label_id")), "label_id", "left_semi")
    lists = known.groupBy("section_id", "trace_idx").agg(F.max("n_samples").alias("n_samples"), F.array_sort(F.collect_list(F.struct("label_id", "bits"))).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, masks in zip(batch.column("n_samples").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                ids = np.zeros(n, np.int32)
                for m in masks:  # in order of labels, so a later one wins
                    on = np.unpackbits(np.frombuffer(m["bits"], np.uint8))[:n].astype(bool)
                    ids[: len(on)][on] = m["label_id"]
                out.append(ids)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("section_id"), batch.column("trace_idx"), ids], names=["section_id", "trace_idx", "label_ids"])

    return lists.mapInArrow(run, "section_id string, trace_idx int, label_ids array<int>")


def threshold_curve(maps: DataFrame, steps: int = 1000) -> DataFrame:
    """``section_id, label_id, step, n_on, n``: pixels that reach ``step / steps``, for all steps
    from 0 to ``steps`` that some pixel reaches.

    Each trace is a histogram over the steps; they are added up and summed from the top.
    A step holds the pixels that reach it and not the next, compared as 32-bit floats, so
    a count equals that of a mask at this threshold.  NaN is counted in ``n`` only."""
    marks = (np.arange(steps + 1) / steps).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("probs")
            flat, sizes = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float32), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), sizes)
            step = np.where(np.isnan(flat), -1, np.searchsorted(marks, flat, "right") - 1)
            cells, n = np.unique(row.astype(np.int64) * (steps + 2) + step + 1, return_counts=True)
            of = pa.array(cells // (steps + 2))
            columns = [batch.column("section_id").take(of), batch.column("label_id").take(of), pa.array((cells % (steps + 2) - 1).astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["section_id", "label_id", "step", "k"])

    cells = maps.select("section_id", "label_id", F.col("probs").cast("array<float>")).mapInArrow(run, "section_id string, label_id int, step int, k long")
    counts = cells.groupBy("section_id", "label_id", "step").agg(F.sum("k").alias("k"))
    curves = counts.groupBy("section_id", "label_id").agg(F.sum("k").alias("n"), F.max("step").alias("top"), F.map_from_entries(F.collect_list(F.struct("step", "k"))).alias("held"))
    down = F.sequence(F.col("top"), F.lit(0), F.lit(-1))
    every = curves.where("top >= 0").select("section_id", "label_id", "n", F.posexplode(F.transform(down, lambda s: F.coalesce(F.col("held")[s], F.lit(0).cast("long")))).alias("i", "k"), "top")
    above = Window.partitionBy("section_id", "label_id").orderBy("i")
    return every.select("section_id", "label_id", (F.col("top") - F.col("i")).alias("step"), F.sum("k").over(above).alias("n_on"), "n")


def mask_any(pixels: DataFrame) -> DataFrame:
    """Whether a label's mask has any pixel: ``section_id, label_id, mask_any``."""
    return pixels.groupBy("section_id", "label_id").agg(F.bool_or("mask").alias("mask_any"))


def coverage(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``section_id, label_id, label, pct, pct_text`` for every section and label.

    ``counts(section_id, label_id, n_on, n)`` are partial counts, of pixels or traces; a
    label without a mask covers 0 per cent."""
    sums = counts.groupBy("section_id", "label_id").agg(F.sum("n_on").alias("n_on"), F.sum("n").alias("n"))
    # a row per section with its few labels, so that counts are worked out once
    held = sums.groupBy("section_id").agg(F.collect_list(F.struct("label_id", "n_on", "n")).alias("held"))
    every = held.crossJoin(F.broadcast(labels.select("label_id", "label")))
    own = F.get(F.filter("held", lambda h: h["label_id"] == F.col("label_id")), F.lit(0))
    pct = F.coalesce(100.0 * own["n_on"] / F.when(own["n"] > 0, own["n"]), F.lit(0.0))
    found = every.withColumn("pct", pct)
    return found.select("section_id", "label_id", "label", "pct", F.format_string("%.2f%%", "pct").alias("pct_text"))


def pixel_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("section_id", "label_id").agg(F.sum(F.col("mask").cast("long")).alias("n_on"), F.count("*").alias("n"))


def packed_counts(masks: DataFrame) -> DataFrame:
    on = F.size(F.filter("mask", lambda m: m)).cast("long")
    return masks.select("section_id", "label_id", on.alias("n_on"), F.size("mask").cast("long").alias("n"))


def label_volume(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """One label per pixel: the highest id whose mask is on, else 0.

    Labels outside the catalog don't count; the catalog is a fixed handful of rows."""
    known = F.broadcast(labels.select(F.col("label_id").alias("known")))
    joined = pixels.join(known, F.col("label_id") == F.col("known"), "left")
    top = F.coalesce(F.max(F.when(F.col("mask"), F.col("known"))), F.lit(0)).cast("int")
    return joined.groupBy("section_id", "trace_idx", "sample_idx").agg(top.alias("label_id"))


def label_volume_packed(masks: DataFrame) -> DataFrame:
    """``section_id, trace_idx, label_ids``: per trace the labels' masks are folded."""
    ids = F.transform("mask", lambda m: F.when(m, F.col("label_id")).otherwise(F.lit(0)))
    lists = masks.withColumn("ids", ids).groupBy("section_id", "trace_idx").agg(F.collect_list("ids").alias("lists"))
    fused = F.aggregate(
        "lists", F.transform(F.element_at("lists", 1), lambda _: F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda p, q: F.greatest(p, q))
    )
    return lists.select("section_id", "trace_idx", fused.alias("label_ids"))
