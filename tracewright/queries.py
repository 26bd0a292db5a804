"""The registered queries of the section operators, and their DuckDB SQL.

All read the driver's tables through ``fixtures``.  Percentile bounds are rounded to
nine decimals here, in both engines, so that a last bit can't flip a grey level; the
operators themselves never round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog, fixtures
from .functions import columns as C
from .operators import masks, normalize, overlay, scoring, stitch, tiling
from .plans import segment
from .sinks import files, readback
from .sources import bounds as kept
from .sources import segy
from .storage import new_folder, staged
from .streaming import fusion

TILE, STRIDE = 32, 16
FILE_PIXELS = 1 << 12  # small pieces, so that a file is many tasks' work here too


def _rounded(bounds: DataFrame, digits: int = 9) -> DataFrame:
    return bounds.select("section_id", F.round("lo", digits).alias("lo"), F.round("hi", digits).alias("hi"))


def _gray(traces: DataFrame) -> DataFrame:
    return normalize.gray_traces(traces, _rounded(normalize.clip_bounds(normalize.samples_long(traces))))


def _padded(spark, sf_dir, tile=TILE) -> DataFrame:
    return tiling.edge_pad(_gray(fixtures.line(spark, sf_dir)), tile)


def _tiles(spark, sf_dir) -> DataFrame:
    return tiling.tile_cut(_padded(spark, sf_dir), TILE, STRIDE)


def _strips(spark, sf_dir) -> DataFrame:
    return scoring.score_tiles(_tiles(spark, sf_dir), tile=TILE)


def _segmented(spark, sf_dir, source=fixtures.line, **options) -> segment.Segmentation:
    traces = source(spark, sf_dir)
    bounds = _rounded(normalize.clip_bounds_two_pass(normalize.samples_long(traces)))
    return segment.segment_sections(traces, tile=TILE, stride=STRIDE, bounds=bounds, **options)


def _fused(spark, sf_dir) -> DataFrame:
    return stitch.stitch_long(fixtures.scores(spark, sf_dir))


def _event_masks(spark, sf_dir, threshold=0.5) -> DataFrame:
    return masks.binarize(_fused(spark, sf_dir), threshold)


def label_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = fixtures.scores(spark, sf_dir).groupBy("label_id").agg(F.count("*").alias("n_scores"))
    return catalog.label_catalog(spark).join(seen, "label_id", "left").select("label_id", "label", "r", "g", "b", "n_scores")


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.file_catalog(spark, [f"{sf_dir}/*.parquet", f"{sf_dir}/part*.parquet", f"{sf_dir}/missing.sgy"])


def samples_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.samples_long(fixtures.line(spark, sf_dir))


def section_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fixtures.line(spark, sf_dir).unionByName(fixtures.volume(spark, sf_dir).select("section_id", "trace_idx", "samples"))
    return normalize.section_shape(both)


def inline_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = fixtures.volume(spark, sf_dir).drop("trace_idx")
    return segy.inline_slices(cube).select("section_id", "inline_no", "xline_no", "trace_idx", F.col("samples")[0].alias("first_sample"))


def _bounds(spark, sf_dir, find) -> DataFrame:
    line = normalize.samples_long(fixtures.line(spark, sf_dir)).select("section_id", "amplitude")
    return _rounded(find(fixtures.big(spark, sf_dir).unionByName(line)), 6)


def clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, normalize.clip_bounds)


def clip_bounds_2pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir, normalize.clip_bounds_two_pass)


def _histogram(samples: DataFrame) -> DataFrame:
    gray = normalize.gray_samples(samples, _rounded(normalize.clip_bounds(samples)))
    return gray.groupBy("section_id", "gray").agg(F.count("*").alias("n"))


def normalize_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(fixtures.big(spark, sf_dir))


def normalize_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(fixtures.big(spark, sf_dir).withColumn("amplitude", F.when(F.col("amplitude").isNotNull(), F.lit(7.5).cast("float"))))


def to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = _gray(fixtures.line(spark, sf_dir)).select("section_id", "trace_idx", F.posexplode("gray").alias("sample_idx", "gray"))
    return normalize.to_rgb(gray).select("trace_idx", "sample_idx", "rgb.r", "rgb.g", "rgb.b")


def tile_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.dims(spark, sf_dir).distinct().select("dim", F.explode(C.tile_starts(F.col("dim"), 1024, 512)).alias("start"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_grid(section_shape(spark, sf_dir), TILE, STRIDE)


def edge_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = tiling.edge_pad(_gray(fixtures.volume(spark, sf_dir)), 96)
    return padded.select("section_id", "trace_idx", F.posexplode("gray").alias("sample_idx", "gray"))


def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cropped = tiling.crop(tiling.edge_pad(_gray(fixtures.volume(spark, sf_dir)), 96))
    return cropped.select("section_id", "trace_idx", F.posexplode("gray").alias("sample_idx", "gray"))


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_pixels(_padded(spark, sf_dir), TILE, STRIDE).select("trace_idx", "sample_idx", "n_tiles")


def tile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(_tiles(spark, sf_dir))


def _sums(tiles: DataFrame) -> DataFrame:
    """Size and sum of each tile's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("pixels")]
            sums = pa.array([len(x) for x in found], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("tile_y"), batch.column("tile_x"), *sums], names=["tile_y", "tile_x", "n_pixels", "sum_gray"])

    return tiles.select("tile_y", "tile_x", "pixels").mapInArrow(run, "tile_y int, tile_x int, n_pixels long, sum_gray long")


def prompt_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.prompt_fanout(_tiles(spark, sf_dir), catalog.label_catalog(spark)).select("tile_y", "tile_x", "label_id", "label")


def score_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _strips(spark, sf_dir).select("label_id", "tile_y", "tile_x", "row_off", F.posexplode("probs").alias("col_off", "prob"))
    return pixels.select("label_id", "tile_y", "tile_x", "row_off", "col_off", F.round(F.col("prob").cast("double"), 5).alias("prob"))


def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = normalize.samples_long(fixtures.line(spark, sf_dir))
    return samples.select("trace_idx", "sample_idx", F.round(C.sigmoid(F.col("amplitude")).cast("double"), 5).alias("prob"))


def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = fixtures.line(spark, sf_dir).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(15))))
    grids = grids.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(15))))
    value = C.bilinear(F.col("samples"), 8, 8, F.col("row"), F.col("col"), 16, 16)
    return grids.select("trace_idx", "row", "col", (F.round(value, 5) + 0.0).alias("value"))


def _as_pixels(fused: DataFrame) -> DataFrame:
    return fused.select("label_id", "trace_idx", "sample_idx", F.round(F.col("prob").cast("double"), 5).alias("prob"))


def stitch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_pixels(stitch.stitch_strips(_strips(spark, sf_dir)))


def stitch_max_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = normalize.section_shape(fixtures.line(spark, sf_dir))
    return _as_pixels(stitch.packed_long(stitch.stitch_packed(_strips(spark, sf_dir), shapes)))


def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = masks.binarize(masks.binarize(_fused(spark, sf_dir), 0.5, name="mask_50"), 0.7, name="mask_70")
    return both.select("label_id", "trace_idx", "sample_idx", "mask_50", "mask_70")


def mask_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_any(_event_masks(spark, sf_dir, 0.7)).select("label_id", "mask_any")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = masks.coverage(masks.pixel_counts(_event_masks(spark, sf_dir, 0.3)), catalog.label_catalog(spark))
    return found.select("label_id", "label", F.round("pct", 6).alias("pct"), "pct_text")


def label_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.label_volume(_event_masks(spark, sf_dir, 0.3), catalog.label_catalog(spark)).select("trace_idx", "sample_idx", "label_id")


def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = overlay.layer_filter(_event_masks(spark, sf_dir, 0.3), catalog.label_catalog(spark), ["salt body", "fault"])
    return layers.groupBy("draw_order", "label_id", "label").agg(F.sum(F.col("mask").cast("long")).alias("n_on"))


def overlay_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = _event_masks(spark, sf_dir, 0.1)
    labels = catalog.label_catalog(spark)
    base = pixels.select("section_id", "trace_idx", "sample_idx").distinct().withColumn("gray", F.lit(128))
    return overlay.overlay_blend(base, overlay.layer_filter(pixels, labels), labels).drop("section_id")


def mask_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.mask_keys(label_catalog(spark, sf_dir)).select("label_id", "key", "n_scores")


def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("data/"), F.col("p_brand"), F.lit("/line."), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.lit(".sgy")))
    paths = fixtures.read(spark, sf_dir, "part").select(path.alias("path"))
    return catalog.artifact_names(paths).select("path", "stem", "overlay_name", "archive_name", "volume_name", "unique_stem")


def segment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _segmented(spark, sf_dir).coverage
    return found.select("label_id", "label", F.round("pct", 6).alias("pct"))


def segment_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _segmented(spark, sf_dir, lambda s, d: fixtures.volume(s, d).select("section_id", "trace_idx", "samples"), threshold=0.7).coverage
    return found.select("section_id", "label_id", F.round("pct", 6).alias("pct"))


def _written_segy(spark, sf_dir, source) -> str:
    folder = new_folder(spark, "segy")
    lost = files.export_segy(source, folder, most_pixels=FILE_PIXELS).where("status <> 'written'").agg(F.count("*").alias("n"), F.max(F.struct("section_id", "status", "error")).alias("one")).first()
    if lost.n:
        raise RuntimeError(f"{lost.n} files not written, such as {lost.one}")
    return folder


def segy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written_segy(spark, sf_dir, fixtures.line(spark, sf_dir))
    rows = segy.read_segy(spark, f"{folder}/*.sgy", traces_per_partition=128)
    return rows.select("trace_idx", "status", F.posexplode("samples").alias("sample_idx", "amplitude"))


def segy_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written_segy(spark, sf_dir, fixtures.volume(spark, sf_dir))
    rows = segy.inline_slices(segy.read_segy(spark, f"{folder}/*.sgy", geometry="3d").where("status = 'ok'"))
    return rows.select("inline_no", "xline_no", "trace_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("sum_samples"))


def segy_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few inlines of one cube by its header index."""
    folder = new_folder(spark, "cube")
    cube = fixtures.volume(spark, sf_dir).withColumn("trace_idx", F.col("xline_no")).withColumn("section_id", F.lit("cube"))
    files.export_segy(cube, folder, most_pixels=FILE_PIXELS)
    segy.index_segy(spark, f"{folder}/index", f"{folder}/*.sgy")
    rows = segy.read_segy(spark, f"{folder}/*.sgy", geometry="3d", index=f"{folder}/index")
    rows = segy.inline_slices(rows.where("inline_no in (3, 7) and status = 'ok'"))
    return rows.select("inline_no", "xline_no", "trace_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 4).alias("sum_samples"))


def clip_bounds_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each inline over two cubes, the second added to what is kept of the first."""
    folder, inline = new_folder(spark, "halves"), F.regexp_extract("section_id", r"#(-?\d+)$", 1).cast("int")
    half = F.concat(F.lit("half"), (F.col("xline_no") % 2).cast("string"))
    cube = fixtures.volume(spark, sf_dir).withColumns({"section_id": half, "trace_idx": F.floor(F.col("xline_no") / 2).cast("int")})
    files.export_segy(cube, folder, most_pixels=FILE_PIXELS)
    find = lambda name: kept.kept_bounds(spark, f"{folder}/kept", f"{folder}/{name}*.sgy", geometry="3d", by=inline, traces_per_range=256)
    find("half0")
    found = find("half").select(inline.alias("inline_no"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
    return found.distinct()


def tile_cut_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles cut by the tasks that read the file."""
    folder = _written_segy(spark, sf_dir, fixtures.line(spark, sf_dir))
    rows = segy.read_segy(spark, f"{folder}/*.sgy").where("status = 'ok'")
    bounds = _rounded(normalize.clip_bounds(normalize.samples_long(rows)))
    tiles = tiling.tile_cut_scanned(segy.read_bands(spark, f"{folder}/*.sgy", tile=TILE, stride=STRIDE, bands_per_partition=3), bounds, TILE, STRIDE)
    return _sums(tiles)


def segment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of the chain whose tasks read, cut, score and fuse whole bands."""
    folder = _written_segy(spark, sf_dir, fixtures.line(spark, sf_dir))
    bounds = _rounded(normalize.clip_bounds(normalize.samples_long(segy.read_segy(spark, f"{folder}/*.sgy").where("status = 'ok'"))))
    done = segment.segment_files(spark, f"{folder}/*.sgy", tile=TILE, stride=STRIDE, bounds=bounds, bands_per_partition=3)
    return _as_pixels(stitch.packed_long(done.prob_maps))


def _totals(kind: str, manifest: DataFrame) -> DataFrame:
    """What the files of a kind hold, read back: ``section_id, artifact, key, total``."""
    name = lambda c: F.col(c).cast("string")
    if kind == "npz":
        on = F.size(F.filter("mask", lambda m: m)).cast("long")
        held = readback.masks_of(manifest).select("section_id", F.lit("masks_npz").alias("artifact"), name("label_id").alias("key"), on.alias("total"))
    elif kind == "png":
        add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
        held = readback.overlays_of(manifest).select("section_id", F.lit("overlay_png").alias("artifact"), F.explode(F.create_map(*[x for c in "rgb" for x in (F.lit(c), add(c))])).alias("key", "total"))
    else:
        held = readback.volumes_of(manifest).select("section_id", F.lit("labels_vti").alias("artifact"), F.explode("label_ids").alias("id")).select("section_id", "artifact", name("id").alias("key"), F.lit(1).cast("long").alias("total"))
    return held.groupBy("section_id", "artifact", "key").agg(F.sum("total").alias("total"))


def export_npz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals("npz", files.export_npz(_segmented(spark, sf_dir).masks, new_folder(spark, "npz"), FILE_PIXELS))


def export_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals("png", files.export_png(segment.overlay_traces(_segmented(spark, sf_dir)), new_folder(spark, "png"), FILE_PIXELS))


def export_vti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _segmented(spark, sf_dir)
    return _totals("vti", files.export_vti(masks.label_volume_packed(done.masks), new_folder(spark, "vti"), most_pixels=FILE_PIXELS, shapes=done.shapes))


def export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = segment.export_all(_segmented(spark, sf_dir), new_folder(spark, "all"), most_pixels=FILE_PIXELS)
    return reduce(DataFrame.unionByName, [_totals(kind, manifest) for kind in ("npz", "png", "vti")])


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth trace has a NaN, which the manifest counts."""
    line = fixtures.line(spark, sf_dir)
    broken = F.when(F.col("trace_idx") % 9 == 0, F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("samples", F.lit(2), F.size("samples") - 1))).otherwise(F.col("samples"))
    folder = _written_segy(spark, sf_dir, line.withColumn("samples", broken))
    rows = segy.read_segy(spark, f"{folder}/*.sgy", f"{folder}/missing.sgy")
    good = rows.where("status = 'ok'").select("section_id", "trace_idx", "samples")
    done = segment.segment_sections(good, tile=TILE, stride=STRIDE, stage=True)
    manifest = segment.run_manifest(rows, files.export_npz(done.masks, new_folder(spark, "run"), FILE_PIXELS), done.failures)
    return manifest.select(F.regexp_extract("section_id", r"([^/]*)$", 1).alias("file"), "artifact", "status", "n_nan")


def mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and emptiness of masks of a bit a pixel."""
    bits = staged(masks.binarize_bits(_segmented(spark, sf_dir).prob_maps, 0.7))
    counts = masks.bit_counts(bits).groupBy("section_id", "label_id").agg(F.sum("n_on").alias("n_on"), F.sum("n").alias("n"))
    return counts.join(masks.bits_any(bits), ["section_id", "label_id"]).select("label_id", "n_on", "n", "mask_any")


def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.threshold_curve(_segmented(spark, sf_dir).prob_maps, 200).select("label_id", "step", "n_on", "n")


def segment_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with its usual windows, over a section larger than them."""
    traces = fixtures.large(spark, sf_dir)
    done = segment.segment_sections(traces, bounds=_rounded(normalize.clip_bounds_of_traces(traces)))
    return done.coverage.select("label_id", "label", F.round("pct", 6).alias("pct"))


def streaming_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips put into a folder in two parts, fused as a stream."""
    folder, fused = new_folder(spark, "strips"), new_folder(spark, "fused")
    strips = staged(_strips(spark, sf_dir))
    strips.where("tile_y % 32 = 0").write.mode("append").parquet(folder)
    strips.where("tile_y % 32 <> 0").write.mode("append").parquet(folder)
    fusion.keep_fused(fusion.placed_scores(spark, folder), new_folder(spark, "stream"), fused).awaitTermination()
    return _as_pixels(fusion.fused_scores(spark, fused))


_NAMES = (
    "segment_sections segment_volume label_catalog file_catalog samples_long section_shape inline_slices clip_bounds clip_bounds_2pass normalize_gray "
    "normalize_degenerate to_rgb tile_starts tile_grid edge_pad crop tile_pixels tile_cut prompt_fanout score_tiles sigmoid bilinear_resize stitch_max "
    "stitch_max_packed binarize mask_any coverage label_volume layer_filter overlay_blend mask_keys artifact_names segy_scan segy_volume export_npz "
    "export_png export_vti export_all run_manifest streaming_fusion mask_bits threshold_curve segment_default segy_inline clip_bounds_kept tile_cut_scan segment_scan"
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in _NAMES.split()}

# --- the same in SQL ------------------------------------------------------------------

_LINE = """fx_line AS (SELECT 'line' AS section_id, CAST(vec_id AS INT) AS trace_idx, embedding AS samples FROM embeddings)"""
_VOLUME = """fx_volume AS (SELECT 'volume#' || label AS section_id, CAST(label AS INT) AS inline_no, CAST(vec_id AS INT) AS xline_no,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS trace_idx, embedding AS samples FROM embeddings)"""
#: Three traces for each vector, 1280 samples wide.
_LARGE = """fx_large AS (SELECT 'large' AS section_id, CAST(3 * vec_id + r AS INT) AS trace_idx,
  list_transform(range(0, 1280), lambda j: CAST(embedding[j % 64 + 1] + CAST((j // 64) % 5 AS FLOAT) AS FLOAT)) AS samples FROM embeddings, (SELECT unnest(range(0, 3)) AS r))"""
_BIG = "fx_big AS (SELECT l_returnflag AS section_id, CAST(l_extendedprice AS FLOAT) AS amplitude FROM lineitem)"
_SCORES = """fx_scores AS (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS label_id,
  CAST(user_id AS INT) AS trace_idx, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS INT) AS sample_idx,
  CAST(greatest(0.0, least(1.0, value / 500)) AS FLOAT) AS prob FROM events),
fused AS (SELECT label_id, trace_idx, sample_idx, greatest(CAST(0 AS FLOAT), max(prob)) AS prob FROM fx_scores GROUP BY ALL)"""
_LABELS = """labels5(label_id, label, r, g, b) AS (VALUES (1, 'fault', 255, 0, 0), (2, 'channel', 0, 0, 255), (3, 'seismic facies', 0, 200, 0),
  (4, 'salt body', 255, 220, 0), (5, 'horizon', 0, 255, 255))"""


def _flat(table: str) -> str:
    return f"""flat AS (SELECT section_id, trace_idx, CAST(i - 1 AS INT) AS sample_idx, samples[i] AS amplitude
  FROM (SELECT *, unnest(range(1, len(samples) + 1)) AS i FROM {table}))"""


def _levels(table: str, extra: str = "") -> str:
    return f"""bounds AS (SELECT section_id, round(quantile_cont(CAST(amplitude AS DOUBLE), 0.02), 9) AS lo, round(quantile_cont(CAST(amplitude AS DOUBLE), 0.98), 9) AS hi
  FROM {table} WHERE NOT isnan(amplitude) GROUP BY 1),
gray AS (SELECT section_id, {extra} CAST(CASE WHEN hi > lo THEN floor((least(greatest(CAST(amplitude AS DOUBLE), lo), hi) - lo) / (hi - lo) * 255) ELSE 0 END AS SMALLINT) AS gray
  FROM {table} JOIN bounds USING (section_id))"""


_GRAY = f"{_LINE}, {_flat('fx_line')}, {_levels('flat', 'trace_idx, sample_idx,')}"
_GRAY_VOLUME = f"{_VOLUME}, {_flat('fx_volume')}, {_levels('flat', 'trace_idx, sample_idx,')}"
_ON = "(prob >= CAST({t} AS FLOAT) AND NOT isnan(prob))"


def _starts(dim: str, tile: int, stride: int) -> str:
    return f"CASE WHEN {dim} <= {tile} THEN [0] ELSE list_distinct(list_concat(range(0, {dim} - {tile} + 1, {stride}), [{dim} - {tile}])) END"


_SHAPES = f"""shapes AS (SELECT section_id, CAST(max(trace_idx) + 1 AS INT) AS n_traces, CAST(max(len(samples)) AS INT) AS n_samples FROM fx_line GROUP BY 1)"""
_GRID = f"""ys AS (SELECT CAST(unnest({_starts('greatest(n_traces, 32)', 32, 16)}) AS INT) AS tile_y FROM shapes),
xs AS (SELECT CAST(unnest({_starts('greatest(n_samples, 32)', 32, 16)}) AS INT) AS tile_x FROM shapes)"""
_SCORED = f"""{_GRAY}, {_SHAPES}, {_GRID}, {_LABELS},
scored AS (SELECT label_id, tile_y, tile_x, trace_idx, sample_idx, gray / 255.0::DOUBLE - label_id / 6.0::DOUBLE + ((31 * tile_y + 17 * tile_x) % 7) / 10.0::DOUBLE - 0.3::DOUBLE AS u
  FROM gray JOIN ys ON trace_idx >= tile_y AND trace_idx < tile_y + 32 JOIN xs ON sample_idx >= tile_x AND sample_idx < tile_x + 32, labels5),
probs AS (SELECT *, CAST(0.5::DOUBLE + 0.5::DOUBLE * u / (1 + abs(u)) AS FLOAT) AS prob FROM scored)"""
_STITCHED = f"""WITH {_SCORED}
SELECT label_id, trace_idx, sample_idx, round(CAST(greatest(CAST(0 AS FLOAT), max(prob)) AS DOUBLE), 5) AS prob FROM probs GROUP BY 1, 2, 3"""
_CLIPPED = f"""WITH {_LINE}, {_flat('fx_line')}, {_BIG},
every AS (SELECT section_id, amplitude FROM flat UNION ALL SELECT * FROM fx_big)
SELECT section_id, round(quantile_cont(CAST(amplitude AS DOUBLE), 0.02), 6) AS lo, round(quantile_cont(CAST(amplitude AS DOUBLE), 0.98), 6) AS hi FROM every GROUP BY 1"""


def _blend(c: str, base: str = "128") -> str:
    """Nested compositing of the five labels over a grey level for one channel."""
    inner = base
    for i in range(1, 6):
        inner = f"(CASE WHEN on{i} THEN ((SELECT {c} FROM labels5 WHERE label_id = {i}) * 114 + {inner} * 141 + 127) // 255 ELSE {inner} END)"
    return f"CAST({inner} AS INT) AS {c}"


ORACLE_SQL: dict[str, str] = {
    "segment_sections": f"""WITH {_SCORED},
fused AS (SELECT label_id, trace_idx, sample_idx, greatest(CAST(0 AS FLOAT), max(prob)) AS prob FROM probs GROUP BY 1, 2, 3)
SELECT label_id, label, round(100.0::DOUBLE * sum(CASE WHEN {_ON.format(t=0.5)} THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM fused JOIN labels5 USING (label_id) GROUP BY 1, 2""",
    "segment_volume": f"""WITH {_GRAY_VOLUME}, {_LABELS},
shapes AS (SELECT section_id, CAST(max(trace_idx) + 1 AS INT) AS n_traces FROM fx_volume GROUP BY 1),
ys AS (SELECT section_id, CAST(unnest({_starts('greatest(n_traces, 32)', 32, 16)}) AS INT) AS tile_y FROM shapes),
xs AS (SELECT unnest([0, 16, 32]) AS tile_x),
scored AS (SELECT gray.section_id, label_id, trace_idx, sample_idx, gray / 255.0::DOUBLE - label_id / 6.0::DOUBLE + ((31 * tile_y + 17 * tile_x) % 7) / 10.0::DOUBLE - 0.3::DOUBLE AS u
  FROM gray JOIN ys ON gray.section_id = ys.section_id AND trace_idx >= tile_y AND trace_idx < tile_y + 32 JOIN xs ON sample_idx >= tile_x AND sample_idx < tile_x + 32, labels5),
fused AS (SELECT section_id, label_id, trace_idx, sample_idx, max(CAST(0.5::DOUBLE + 0.5::DOUBLE * u / (1 + abs(u)) AS FLOAT)) AS prob FROM scored GROUP BY ALL)
SELECT section_id, label_id, round(100.0::DOUBLE * sum(CASE WHEN {_ON.format(t=0.7)} THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM fused GROUP BY 1, 2""",
    "label_catalog": f"""WITH {_LABELS}, {_SCORES}
SELECT label_id, label, r, g, b, n_scores FROM labels5 LEFT JOIN (SELECT label_id, count(*) AS n_scores FROM fx_scores GROUP BY 1) USING (label_id)""",
    "samples_long": f"WITH {_LINE}, {_flat('fx_line')} SELECT * FROM flat",
    "section_shape": f"""WITH {_LINE}, {_VOLUME}, u AS (SELECT section_id, trace_idx, samples FROM fx_line UNION ALL SELECT section_id, trace_idx, samples FROM fx_volume)
SELECT section_id, CAST(max(trace_idx) + 1 AS INT) AS n_traces, CAST(max(len(samples)) AS INT) AS n_samples FROM u GROUP BY 1""",
    "inline_slices": f"WITH {_VOLUME} SELECT section_id, inline_no, xline_no, trace_idx, samples[1] AS first_sample FROM fx_volume",
    "clip_bounds": _CLIPPED,
    "clip_bounds_2pass": _CLIPPED,
    "clip_bounds_kept": f"""WITH {_VOLUME}, v AS (SELECT inline_no, unnest(samples) AS amplitude FROM fx_volume)
SELECT inline_no, round(quantile_cont(CAST(amplitude AS DOUBLE), 0.02), 6) AS lo, round(quantile_cont(CAST(amplitude AS DOUBLE), 0.98), 6) AS hi FROM v GROUP BY 1""",
    "normalize_gray": f"WITH {_BIG}, {_levels('fx_big')} SELECT section_id, gray, count(*) AS n FROM gray GROUP BY 1, 2",
    "normalize_degenerate": "SELECT l_returnflag AS section_id, CAST(0 AS SMALLINT) AS gray, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "to_rgb": f"WITH {_GRAY} SELECT trace_idx, sample_idx, gray AS r, gray AS g, gray AS b FROM gray",
    "tile_starts": f"""WITH d AS (SELECT DISTINCT CAST(p_size * 60 + p_partkey % 7 AS INT) AS dim FROM part)
SELECT dim, CAST(unnest({_starts('dim', 1024, 512)}) AS INT) AS start FROM d""",
    "tile_grid": f"""WITH {_LINE}, {_VOLUME}, u AS (SELECT section_id, trace_idx, samples FROM fx_line UNION ALL SELECT section_id, trace_idx, samples FROM fx_volume),
s AS (SELECT section_id, CAST(max(trace_idx) + 1 AS INT) AS orig_h, CAST(max(len(samples)) AS INT) AS orig_w FROM u GROUP BY 1),
p AS (SELECT *, greatest(orig_h, 32) AS padded_h, greatest(orig_w, 32) AS padded_w FROM s),
y AS (SELECT *, CAST(unnest({_starts('padded_h', 32, 16)}) AS INT) AS tile_y FROM p)
SELECT section_id, tile_y, CAST(unnest({_starts('padded_w', 32, 16)}) AS INT) AS tile_x, padded_h, padded_w, orig_h, orig_w FROM y""",
    "edge_pad": f"""WITH {_GRAY_VOLUME}, s AS (SELECT section_id, max(trace_idx) + 1 AS h, max(sample_idx) + 1 AS w FROM gray GROUP BY 1),
y AS (SELECT section_id, h, w, unnest(range(0, greatest(h, 96))) AS r FROM s),
g AS (SELECT section_id, h, w, r, unnest(range(0, greatest(w, 96))) AS c FROM y)
SELECT g.section_id, CAST(r AS INT) AS trace_idx, CAST(c AS INT) AS sample_idx, gray FROM g JOIN gray ON gray.section_id = g.section_id
  AND gray.trace_idx = least(r, h - 1) AND gray.sample_idx = least(c, w - 1)""",
    "crop": f"WITH {_GRAY_VOLUME} SELECT section_id, trace_idx, sample_idx, gray FROM gray",
    "tile_pixels": f"""WITH {_GRAY}, {_SHAPES}, {_GRID}
SELECT trace_idx, sample_idx, CAST(count(*) AS INT) AS n_tiles FROM gray JOIN ys ON trace_idx >= tile_y AND trace_idx < tile_y + 32
  JOIN xs ON sample_idx >= tile_x AND sample_idx < tile_x + 32 GROUP BY 1, 2""",
    "tile_cut": f"""WITH {_GRAY}, {_SHAPES}, {_GRID}
SELECT tile_y, tile_x, count(*) AS n_pixels, CAST(sum(gray) AS BIGINT) AS sum_gray FROM gray JOIN ys ON trace_idx >= tile_y AND trace_idx < tile_y + 32
  JOIN xs ON sample_idx >= tile_x AND sample_idx < tile_x + 32 GROUP BY 1, 2""",
    "prompt_fanout": f"WITH {_LINE}, {_SHAPES}, {_GRID}, {_LABELS} SELECT tile_y, tile_x, label_id, label FROM ys, xs, labels5",
    "score_tiles": f"""WITH {_SCORED}
SELECT label_id, tile_y, tile_x, CAST(trace_idx - tile_y AS INT) AS row_off, CAST(sample_idx - tile_x AS INT) AS col_off, round(CAST(prob AS DOUBLE), 5) AS prob
FROM probs""",
    "sigmoid": f"WITH {_LINE}, {_flat('fx_line')} SELECT trace_idx, sample_idx, round(CAST(CAST(1 / (1 + exp(-CAST(amplitude AS DOUBLE))) AS FLOAT) AS DOUBLE), 5) AS prob FROM flat",
    "bilinear_resize": f"""WITH {_LINE}, g AS (SELECT trace_idx, samples, CAST(r AS INT) AS "row", CAST(c AS INT) AS "col", greatest(0.0::DOUBLE, (r + 0.5::DOUBLE) * 8 / 16 - 0.5::DOUBLE) AS y,
    greatest(0.0::DOUBLE, (c + 0.5::DOUBLE) * 8 / 16 - 0.5::DOUBLE) AS x FROM fx_line, (SELECT unnest(range(0, 16)) AS r), (SELECT unnest(range(0, 16)) AS c)),
  n AS (SELECT *, CAST(floor(y) AS INT) AS y0, CAST(floor(x) AS INT) AS x0, least(CAST(floor(y) AS INT) + 1, 7) AS y1, least(CAST(floor(x) AS INT) + 1, 7) AS x1 FROM g)
SELECT trace_idx, "row", "col", round(CAST(samples[y0 * 8 + x0 + 1] AS DOUBLE) * (1 - (y - y0)) * (1 - (x - x0)) + CAST(samples[y0 * 8 + x1 + 1] AS DOUBLE) * (1 - (y - y0)) * (x - x0)
  + CAST(samples[y1 * 8 + x0 + 1] AS DOUBLE) * (y - y0) * (1 - (x - x0)) + CAST(samples[y1 * 8 + x1 + 1] AS DOUBLE) * (y - y0) * (x - x0), 5) + 0.0::DOUBLE AS value FROM n""",
    "stitch_max": _STITCHED,
    "stitch_max_packed": _STITCHED,
    "streaming_fusion": _STITCHED,
    "binarize": f"WITH {_SCORES} SELECT label_id, trace_idx, sample_idx, {_ON.format(t=0.5)} AS mask_50, {_ON.format(t=0.7)} AS mask_70 FROM fused",
    "mask_any": f"WITH {_SCORES} SELECT label_id, bool_or({_ON.format(t=0.7)}) AS mask_any FROM fused GROUP BY 1",
    "coverage": f"""WITH {_SCORES}, {_LABELS}, c AS (SELECT label_id, 100.0::DOUBLE * sum(CASE WHEN {_ON.format(t=0.3)} THEN 1 ELSE 0 END) / count(*) AS pct FROM fused GROUP BY 1)
SELECT label_id, label, round(coalesce(pct, 0.0), 6) AS pct, printf('%.2f%%', coalesce(pct, 0.0)) AS pct_text FROM labels5 LEFT JOIN c USING (label_id)""",
    "label_volume": f"""WITH {_SCORES} SELECT trace_idx, sample_idx, CAST(coalesce(max(CASE WHEN {_ON.format(t=0.3)} THEN label_id END), 0) AS INT) AS label_id FROM fused GROUP BY 1, 2""",
    "layer_filter": f"""WITH {_SCORES}, {_LABELS} SELECT CASE label WHEN 'salt body' THEN 1 ELSE 2 END AS draw_order, label_id, label,
  CAST(sum(CASE WHEN {_ON.format(t=0.3)} THEN 1 ELSE 0 END) AS BIGINT) AS n_on FROM fused JOIN labels5 USING (label_id) WHERE label IN ('salt body', 'fault') GROUP BY 1, 2, 3""",
    "overlay_blend": f"""WITH {_SCORES}, {_LABELS}, o AS (SELECT trace_idx, sample_idx, {', '.join(f'coalesce(bool_or({_ON.format(t=0.1)}) FILTER (WHERE label_id = {i}), false) AS on{i}' for i in range(1, 6))}
  FROM fused GROUP BY 1, 2) SELECT trace_idx, sample_idx, {_blend('r')}, {_blend('g')}, {_blend('b')} FROM o""",
    "mask_keys": f"""WITH {_LABELS}, {_SCORES} SELECT label_id, replace(label, ' ', '_') AS key, n_scores
FROM labels5 LEFT JOIN (SELECT label_id, count(*) AS n_scores FROM fx_scores GROUP BY 1) USING (label_id)""",
    "artifact_names": r"""WITH p AS (SELECT 'data/' || p_brand || '/line.' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.sgy' END AS path FROM part),
s AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM p)
SELECT path, stem, stem || '_overlay.png' AS overlay_name, stem || '_masks.npz' AS archive_name, stem || '_masks.vti' AS volume_name, stem || '-' || substr(md5(path), 1, 8) AS unique_stem FROM s""",
    "segy_scan": f"WITH {_LINE}, {_flat('fx_line')} SELECT trace_idx, 'ok' AS status, sample_idx, amplitude FROM flat",
    "segy_volume": f"WITH {_VOLUME} SELECT inline_no, xline_no, trace_idx, round(list_sum([CAST(x AS DOUBLE) FOR x IN samples]), 4) AS sum_samples FROM fx_volume",
}

ORACLE_SQL["segy_inline"] = ORACLE_SQL["segy_volume"] + " WHERE inline_no IN (3, 7)"
ORACLE_SQL["tile_cut_scan"] = ORACLE_SQL["tile_cut"]
ORACLE_SQL["segment_scan"] = _STITCHED
_FUSED = f"""{_SCORED},
stitched AS (SELECT label_id, trace_idx, sample_idx, greatest(CAST(0 AS FLOAT), max(prob)) AS prob FROM probs GROUP BY 1, 2, 3)"""
_TOTALS = {
    "npz": f"""SELECT 'line' AS section_id, 'masks_npz' AS artifact, CAST(label_id AS VARCHAR) AS key,
  CAST(sum(CASE WHEN {_ON.format(t=0.5)} THEN 1 ELSE 0 END) AS BIGINT) AS total FROM stitched GROUP BY label_id""",
    "vti": f"""SELECT 'line', 'labels_vti', CAST(id AS VARCHAR), count(*) FROM (
  SELECT coalesce(max(CASE WHEN {_ON.format(t=0.5)} THEN label_id END), 0) AS id FROM stitched GROUP BY trace_idx, sample_idx) GROUP BY id""",
    "png": f"""SELECT 'line', 'overlay_png', c, CAST(sum(CASE c WHEN 'r' THEN r WHEN 'g' THEN g ELSE b END) AS BIGINT) FROM (
  SELECT {_blend('r', 'gray')}, {_blend('g', 'gray')}, {_blend('b', 'gray')} FROM (
    SELECT any_value(CAST(gray AS INT)) AS gray, {', '.join(f'coalesce(bool_or({_ON.format(t=0.5)}) FILTER (WHERE label_id = {i}), false) AS on{i}' for i in range(1, 6))}
    FROM stitched JOIN gray USING (trace_idx, sample_idx) GROUP BY trace_idx, sample_idx)), (VALUES ('r'), ('g'), ('b')) AS v(c) GROUP BY c""",
}
_NAMED = "SELECT * FROM ({}) AS t(section_id, artifact, key, total)"
ORACLE_SQL |= {f"export_{k}": f"WITH {_FUSED} {_NAMED.format(sql)}" for k, sql in _TOTALS.items()} | {
    "export_all": f"WITH {_FUSED} {_NAMED.format(' UNION ALL '.join(_TOTALS.values()))}",
    # the name ends in the CRC-32 of "line"
    "run_manifest": """SELECT 'missing.sgy' AS file, 'input' AS artifact, 'missing' AS status, CAST(NULL AS BIGINT) AS n_nan
UNION ALL SELECT 'line-d114b4f6.sgy', 'masks_npz', 'written', (SELECT count(*) FROM embeddings WHERE vec_id % 9 = 0)""",
    "mask_bits": f"""WITH {_FUSED} SELECT label_id, CAST(sum(CASE WHEN {_ON.format(t=0.7)} THEN 1 ELSE 0 END) AS BIGINT) AS n_on, count(*) AS n,
  bool_or({_ON.format(t=0.7)}) AS mask_any FROM stitched GROUP BY 1""",
    "threshold_curve": f"""WITH {_FUSED}, s AS (SELECT CAST(unnest(range(0, 201)) AS INT) AS step),
c AS (SELECT label_id, prob, count(*) AS k FROM stitched GROUP BY 1, 2), n AS (SELECT label_id, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY 1)
SELECT label_id, step, CAST(sum(k) AS BIGINT) AS n_on, any_value(n) AS n FROM c JOIN n USING (label_id) JOIN s ON prob >= CAST(step / 200.0::DOUBLE AS FLOAT) GROUP BY 1, 2""",
    "segment_default": f"""WITH {_LARGE}, {_flat('fx_large')}, {_levels('flat', 'trace_idx, sample_idx,')}, {_LABELS},
shape AS (SELECT 3 * (max(vec_id) + 1) AS h FROM embeddings),
ys AS (SELECT CAST(unnest({_starts('greatest(h, 1024)', 1024, 512)}) AS INT) AS tile_y FROM shape),
xs AS (SELECT unnest([0, 256]) AS tile_x),
tiles AS (SELECT trace_idx, sample_idx, gray, (31 * tile_y + 17 * tile_x) % 7 AS turn FROM gray JOIN ys ON trace_idx >= tile_y AND trace_idx < tile_y + 1024
  JOIN xs ON sample_idx >= tile_x AND sample_idx < tile_x + 1024),
best AS (SELECT trace_idx, sample_idx, any_value(gray) AS gray, max(turn) AS turn FROM tiles GROUP BY 1, 2),
scored AS (SELECT label_id, gray / 255.0::DOUBLE - label_id / 6.0::DOUBLE + turn / 10.0::DOUBLE - 0.3::DOUBLE AS u FROM best, labels5),
fused AS (SELECT label_id, CAST(0.5::DOUBLE + 0.5::DOUBLE * u / (1 + abs(u)) AS FLOAT) AS prob FROM scored)
SELECT label_id, label, round(100.0::DOUBLE * sum(CASE WHEN {_ON.format(t=0.5)} THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM fused JOIN labels5 USING (label_id) GROUP BY 1, 2""",
}
