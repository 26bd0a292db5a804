"""From traces to masks: the whole chain as lazy tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..operators import masks as M
from ..operators import normalize, overlay, scoring, stitch, tiling
from ..sinks import files
from ..sources.segy import read_bands, read_segy
from ..storage import staged


@dataclass
class Segmentation:
    """Every step is a table that can be saved, queried and thresholded again."""

    bounds: DataFrame
    gray: DataFrame
    tiles: DataFrame
    failures: DataFrame
    prob_maps: DataFrame
    masks: DataFrame
    coverage: DataFrame
    labels: DataFrame
    bits: DataFrame
    shapes: DataFrame


def segment_sections(
    traces: DataFrame, *, tile: int = tiling.TILE, stride: int = tiling.STRIDE, threshold: float = M.THRESHOLD, prompts: Sequence[str] | None = None,
    make_scorer: Callable[[], scoring.Scorer] | None = None, bounds: DataFrame | None = None, exact_in_one_pass: bool = False,
    stage: bool = False,
) -> Segmentation:
    """Normalise, tile, score, stitch and threshold all sections at once.

    Bounds are exact in two passes unless one buffer per section will do.  Traces are
    read for the bounds, for the shapes and for the grey levels; ``stage`` keeps them as
    Parquet first, which pays where reading means decoding, and keeps the fused maps with
    the failures, so that tiles are scored once whatever is asked for.  Without it nothing
    but traces as bytes is shuffled, and tiles over the end of a block of traces (a fifth of
    them in short sections, a seventeenth in long ones) are scored for both blocks: a costly
    scorer wants ``stage``.  Labels that the scorer lacks have no mask and cover nothing.
    Tiles it fails on are rows of ``failures``; other tiles go on."""
    traces = staged(traces) if stage else traces
    labels = catalog.label_catalog(traces.sparkSession, prompts)
    if bounds is None:
        bounds = normalize.clip_bounds_in_buffer(normalize.samples_long(traces)) if exact_in_one_pass else normalize.clip_bounds_of_traces(traces)
    ids = tuple(x[0] for x in catalog.LABELS if not prompts or x[1] in prompts)
    gray = normalize.gray_traces(traces, bounds)
    shapes = normalize.section_shape(traces)
    tiles = tiling.tile_cut(tiling.edge_pad(gray, tile, shapes), tile, stride)
    blocks = tiling.deal_blocks(normalize.gray_bytes(traces, bounds), shapes, tile, stride, whole=not stage)
    fused = stitch.fuse_blocks(blocks, make_scorer or (lambda: scoring.ClosedFormScorer(ids)), tile, stride, whole=not stage)
    fused = staged(fused) if stage else fused
    failures = fused.where("error is not null").select("section_id", F.col("trace_idx").alias("tile_y"), F.explode("tile_xs").alias("tile_x"), "error")
    maps = stitch.join_seams(fused) if stage else fused.where("error is null")
    maps = maps.join(F.broadcast(labels.select("label_id")), "label_id").select("section_id", "label_id", "trace_idx", "probs")
    bits = M.binarize_bits(maps, threshold)
    return Segmentation(bounds, gray, tiles, failures, maps, M.binarize_packed(maps, threshold), M.coverage(M.bit_counts(bits), labels), labels, bits, shapes)


def segment_files(
    spark: SparkSession, *patterns: str, tile: int = tiling.TILE, stride: int = tiling.STRIDE, threshold: float = M.THRESHOLD,
    make_scorer: Callable[[], scoring.Scorer] = scoring.ClosedFormScorer, bounds: DataFrame | None = None, bands_per_partition: int = 4,
) -> Segmentation:
    """``segment_sections`` over 2D files, without a shuffle of samples or tiles.

    Tasks read whole bands, cut, score and fuse them; what they fused is written, and only
    traces that bands of two tasks cover are shuffled.  More bands in a partition mean
    fewer of these."""
    rows = read_segy(spark, *patterns).where("status = 'ok'")
    traces = rows.select("section_id", "trace_idx", "samples")
    labels = catalog.label_catalog(spark)
    bounds = normalize.clip_bounds_two_pass(normalize.samples_long(traces)) if bounds is None else bounds
    tiles = tiling.tile_cut_scanned(read_bands(spark, *patterns, tile=tile, stride=stride, bands_per_partition=bands_per_partition), bounds, tile, stride)
    fused = staged(stitch.fuse_scanned(tiles, make_scorer, tile, stride))
    failures = fused.where("error is not null").select("section_id", F.col("trace_idx").alias("tile_y"), F.explode("tile_xs").alias("tile_x"), "error")
    maps = stitch.join_seams(fused).join(F.broadcast(labels.select("label_id")), "label_id").select("section_id", "label_id", "trace_idx", "probs")
    bits = M.binarize_bits(maps, threshold)
    gray = normalize.gray_traces(traces, bounds)
    return Segmentation(bounds, gray, tiles, failures, maps, M.binarize_packed(maps, threshold), M.coverage(M.bit_counts(bits), labels), labels, bits, normalize.section_shape(traces))


def overlay_traces(result: Segmentation, only: Sequence[str] | None = None, alpha: float = overlay.ALPHA) -> DataFrame:
    return overlay.overlay_packed(result.gray, result.masks, result.labels, only, alpha)


def save_tables(result: Segmentation, folder: str) -> None:
    """``prob_maps`` and ``masks`` as Parquet tables in a folder, a part for each label."""
    for name in ("prob_maps", "masks"):
        getattr(result, name).write.mode("overwrite").partitionBy("label_id").parquet(f"{folder.rstrip('/')}/{name}")


def export_all(result: Segmentation, folder: str, *, trace_spacing: float = 25.0, sample_interval: float = 4.0, only: Sequence[str] | None = None, most_pixels: int = files.MOST_PIXELS) -> DataFrame:
    """Overlay, archive and volume of every section, one file of each; the manifest of what was written.

    Masks are kept once, a bit a pixel, so tiles aren't scored for each kind of file; all
    files are written in one transaction."""
    bits = staged(result.bits)
    masks = M.masks_from_bits(bits)
    drawn = overlay.overlay_packed(result.gray, masks, result.labels, only)
    pieces = [
        files.png_pieces(drawn, folder, most_pixels, result.shapes), files.npz_pieces(masks, folder, most_pixels, result.shapes),
        files.vti_pieces(M.label_volume_bits(bits), folder, most_pixels, result.shapes),
    ]
    return files.export_together(bits.sparkSession, pieces, folder, trace_spacing=trace_spacing, sample_interval=sample_interval)


def run_manifest(read: DataFrame, written: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Status per input and artifact: inputs that couldn't be read, sections with tiles that
    couldn't be scored, and what became of the others, with ``n_nan``, the section's samples
    that are no numbers and count for no bound (null where ``read`` is without samples)."""
    none = F.lit(None).cast("string")
    failed = read.where("status <> 'ok'").select("section_id", "path", F.lit("input").alias("artifact"), "status", none.alias("error"))
    found = failed.distinct().unionByName(written, allowMissingColumns=True)
    if failures is not None:
        lost = failures.groupBy("section_id").agg(F.min("error").alias("error"))
        lost = lost.select("section_id", none.alias("path"), F.lit("scores").alias("artifact"), F.lit("failed").alias("status"), "error")
        found = found.unionByName(lost, allowMissingColumns=True)
    if "samples" not in read.columns:
        return found.withColumn("n_nan", F.lit(None).cast("long"))
    nan = F.size(F.filter("samples", lambda v: F.isnan(v))).cast("long")
    nans = read.where("status = 'ok'").groupBy(F.col("section_id").alias("of")).agg(F.sum(nan).alias("n_nan"))
    return found.join(nans, F.col("section_id") == F.col("of"), "left").drop("of")
