"""The section operators against small NumPy versions written from their definitions."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import broadcast_scans
from tracewright import catalog, schemas
from tracewright.functions import columns as C
from tracewright.operators import masks, normalize, overlay, scoring, stitch, tiling
from tracewright.plans import segment
from tracewright.sinks import files

RNG = np.random.default_rng(3)


def traces(spark, **sections):
    rows = [(name, i, [float(v) for v in row]) for name, a in sections.items() for i, row in enumerate(np.asarray(a, np.float32))]
    return spark.createDataFrame(rows, schemas.TRACES)


def np_gray(a):
    a = np.asarray(a, np.float32)
    lo, hi = np.percentile(a, [2, 98])
    if hi <= lo:
        return np.zeros(a.shape, int)
    return np.floor((np.clip(a.astype(float), lo, hi) - lo) / (hi - lo) * 255).astype(int)


def every_start(dim, tile, stride):
    """Multiples of the stride that leave room for a window, and the last offset."""
    last = max(0, dim - tile)
    return sorted({last} | {i for i in range(last) if i % stride == 0})


def every_mask(a, tile, stride, threshold):
    """A pixel is on where the greatest score of all windows that contain it reaches the threshold."""
    g, (h, w) = np_gray(a), np.asarray(a).shape
    at = lambda y, x: g[min(y, h - 1), min(x, w - 1)]
    windows = {}
    for y, x in product(every_start(h, tile, stride), every_start(w, tile, stride)):
        image = np.array([[at(y + i, x + j) for j in range(tile)] for i in range(tile)])
        windows[y, x] = list(scoring.ClosedFormScorer().score(image, y, x))
    inside = lambda i, j: [(k, i - k[0], j - k[1]) for k in windows if 0 <= i - k[0] < tile and 0 <= j - k[1] < tile]
    best = [[[max(windows[k][n][y, x] for k, y, x in inside(i, j)) for j in range(w)] for i in range(h)] for n in range(5)]
    return np.array(best, np.float32) >= np.float32(threshold)


def test_tile_starts_cover_the_axis(spark):
    for tile, stride in ((8, 4), (8, 3), (5, 5), (1, 1)):
        rows = spark.range(1, 33).select("id", C.tile_starts(F.col("id"), tile, stride).alias("s")).collect()
        for r in rows:
            assert list(r.s) == every_start(r.id, tile, stride)
            assert {p for s in r.s for p in range(s, s + tile)} >= set(range(r.id))
    known = {1000: [0], 1024: [0], 1025: [0, 1], 1500: [0, 476], 2048: [0, 512, 1024], 3000: [0, 512, 1024, 1536, 1976]}
    got = spark.createDataFrame([(d,) for d in known], "d int").select("d", C.tile_starts(F.col("d"), 1024, 512).alias("s")).collect()
    assert {r.d: list(r.s) for r in got} == known
    with pytest.raises(ValueError):
        C.tile_starts(F.col("d"), 4, 0)


def test_bounds_and_gray(spark):
    a = [[1, 2, 3, 4, 10]]
    t = traces(spark, a=a, flat=np.full((3, 4), 7.0), one=[[5.0]])
    for find in (normalize.clip_bounds, normalize.clip_bounds_two_pass):
        found = {r.section_id: (r.lo, r.hi) for r in find(normalize.samples_long(t)).collect()}
        assert found["a"] == pytest.approx((1.08, 9.52)) and found["flat"] == (7, 7) and found["one"] == (5, 5)
        gray = {r.section_id: r.gray for r in normalize.gray_traces(t.where("trace_idx = 0"), find(normalize.samples_long(t))).collect()}
        assert gray["a"] == [0, 27, 58, 88, 255] and gray["flat"] == [0] * 4 and gray["one"] == [0]


def test_two_pass_bounds_equal_numpy_with_ties(spark):
    a, b = RNG.normal(size=5000).astype(np.float32), RNG.integers(0, 5, 3000).astype(np.float32)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("b", float("nan")), ("b", None)]
    found = normalize.clip_bounds_two_pass(spark.createDataFrame(rows, "section_id string, amplitude float")).collect()
    for r in found:
        assert (r.lo, r.hi) == pytest.approx(tuple(np.percentile({"a": a, "b": b}[r.section_id].astype(float), [2, 98])), rel=1e-12)


def test_nan_and_empty(spark):
    t = traces(spark, n=[[1.0, float("nan"), 3.0, 4.0]])
    bounds = normalize.clip_bounds(normalize.samples_long(t))
    assert normalize.gray_traces(t, bounds).first().gray[1] == 0
    none = spark.createDataFrame([], schemas.TRACES)
    done = segment.segment_sections(none, tile=4, stride=2)
    assert done.masks.count() == 0 and done.coverage.count() == 0


@pytest.mark.parametrize("shape,tile,stride", [((20, 13), 8, 4), ((5, 30), 8, 8), ((8, 8), 8, 4), ((9, 8), 8, 3), ((1, 3), 4, 2)])
def test_chain_equals_numpy(spark, shape, tile, stride):
    a, b = RNG.normal(size=shape), RNG.normal(size=shape)
    done = segment.segment_sections(traces(spark, a=a, b=b), tile=tile, stride=stride, exact_in_one_pass=True, threshold=0.6)
    want = {"a": every_mask(a, tile, stride, 0.6), "b": every_mask(b, tile, stride, 0.6)}
    rows = done.masks.collect()
    assert len(rows) == 2 * 5 * shape[0]
    for r in rows:
        assert r.mask == want[r.section_id][r.label_id - 1, r.trace_idx].tolist()
    for r in done.coverage.collect():
        assert r.pct == pytest.approx(100 * want[r.section_id][r.label_id - 1].mean())
    volume = {(r.section_id, r.trace_idx): r.label_ids for r in masks.label_volume_packed(done.masks).collect()}
    ids = np.arange(1, 6)[:, None, None]
    for s, m in want.items():
        assert [volume[s, i] for i in range(shape[0])] == (m * ids).max(0).tolist()


def test_packed_and_long_stitch_agree(spark):
    a = RNG.normal(size=(21, 17))
    t = traces(spark, a=a)
    gray = normalize.gray_traces(t, normalize.clip_bounds(normalize.samples_long(t)))
    strips = scoring.score_tiles(tiling.tile_cut(tiling.edge_pad(gray, 8), 8, 5), tile=8)
    long = stitch.stitch_long(stitch.strips_long(strips)).collect()
    packed = stitch.packed_long(stitch.stitch_packed(strips, normalize.section_shape(t))).collect()
    key = lambda r: (r.label_id, r.trace_idx, r.sample_idx, r.prob)
    assert sorted(map(key, long)) == sorted(map(key, packed))


def test_fuse_and_crop(spark):
    rows = [("s", 1, 0, 0, 0, [0.1, 0.9]), ("s", 1, 0, 1, 0, [0.5, 0.2]), ("s", 2, 0, 0, 0, [-0.5, float("nan")])]
    strips = spark.createDataFrame(rows, schemas.STRIPS)
    shape = spark.createDataFrame([("s", 1, 4)], "section_id string, n_traces int, n_samples int")
    got = {r.label_id: r.probs for r in stitch.stitch_packed(strips, shape).collect()}
    assert got[1] == pytest.approx([0.1, 0.9, 0.2, 0.0])
    assert got[2][0] == 0 and np.isnan(got[2][1])


def test_threshold_as_float32(spark):
    p = spark.createDataFrame([(0.7,), (0.3,), (float("nan"),), (None,)], "prob float")
    assert [r.mask for r in masks.binarize(p, 0.7).collect()] == [True, False, False, False]
    assert [r.mask for r in masks.binarize(p, 0.3).collect()] == [True, True, False, False]


def test_overlay(spark):
    labels = catalog.label_catalog(spark)
    base = spark.createDataFrame([("s", 0, 0, 100), ("s", 0, 1, 100)], "section_id string, trace_idx int, sample_idx int, gray int")
    on = spark.createDataFrame([("s", 0, 0, 1, True), ("s", 0, 0, 2, True), ("s", 0, 1, 1, False)], "section_id string, trace_idx int, sample_idx int, label_id int, mask boolean")
    mix = lambda c, acc: (c * 114 + acc * 141 + 127) // 255
    for only, order in ((None, (1, 2)), (["channel", "fault"], (2, 1)), ([], ())):
        want = [100, 100, 100]
        for k in order:
            want = [mix(c, v) for c, v in zip(catalog.LABELS[k - 1][2:], want, strict=True)]
        got = {r.sample_idx: [r.r, r.g, r.b] for r in overlay.overlay_blend(base, overlay.layer_filter(on, labels, only), labels).collect()}
        assert got == {0: want, 1: [100, 100, 100]}
        gray = spark.createDataFrame([("s", 0, [100, 100]), ("s", 1, [7])], "section_id string, trace_idx int, gray array<smallint>")
        packed = spark.createDataFrame([("s", 1, 0, [True, False]), ("s", 2, 0, [True, False]), ("s", 3, 0, [False, False])], "section_id string, label_id int, trace_idx int, mask array<boolean>")
        rows = {r.trace_idx: [r.r, r.g, r.b] for r in overlay.overlay_packed(gray, packed, labels, only).collect()}
        assert rows == {0: [[v, 100] for v in want], 1: [[7]] * 3}


def test_failed_tiles_are_rows(spark, tmp_path):
    """A section whose tiles can't be scored is listed; the other's maps are kept, by label."""

    class Fails(scoring.ClosedFormScorer):
        def score(self, tile, y, x):
            if tile.max() == 0:
                raise ValueError("nothing to see")
            return super().score(tile, y, x)

    done = segment.segment_sections(traces(spark, good=RNG.normal(size=(6, 6)), flat=np.ones((6, 6))), tile=4, stride=2, make_scorer=Fails, stage=True)
    assert {(r.section_id, r.error) for r in done.failures.collect()} == {("flat", "ValueError: nothing to see")}
    segment.save_tables(done, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/masks")
    assert {r.section_id for r in kept.select("section_id").distinct().collect()} == {"good"} and kept.count() == 30
    assert len(list((tmp_path / "prob_maps").glob("label_id=*"))) == 5
    read = spark.createDataFrame([("x.sgy", "x.sgy", "missing")], "section_id string, path string, status string")
    listed = segment.run_manifest(read, spark.createDataFrame([], schemas.MANIFEST), done.failures).collect()
    assert {(r.section_id, r.artifact, r.status) for r in listed} == {("x.sgy", "input", "missing"), ("flat", "scores", "failed")}


def test_resize_equals_column_form(spark):
    grid = RNG.normal(size=(3, 5))
    want = scoring.resize(grid, (7, 4))
    df = spark.createDataFrame([(grid.ravel().tolist(), r, c) for r in range(7) for c in range(4)], "g array<double>, r int, c int")
    for x in df.select("r", "c", C.bilinear(F.col("g"), 3, 5, F.col("r"), F.col("c"), 7, 4).alias("v")).collect():
        assert x.v == pytest.approx(want[x.r, x.c])


def test_prompts(spark):
    with pytest.raises(ValueError):
        catalog.label_catalog(spark, ["fault", "dome"])
    done = segment.segment_sections(traces(spark, a=RNG.normal(size=(6, 6))), tile=4, stride=2, prompts=["horizon"])
    assert {r.label for r in done.coverage.collect()} == {"horizon"}


def test_traces_are_not_sent_to_the_driver(spark, tmp_path):
    """the file is small, the traces made of it are not; only rows per section are broadcast."""
    spark.range(40).selectExpr("'a' as section_id", "cast(id as int) as trace_idx", "transform(sequence(0, 19), j -> cast(id + j as float)) as samples").write.parquet(f"{tmp_path}/t")
    done = segment.segment_sections(spark.read.parquet(f"{tmp_path}/t"), tile=8, stride=4)
    for df in (done.prob_maps, segment.overlay_traces(done), files.npz_pieces(done.masks, str(tmp_path), 64, done.shapes)):
        sent = broadcast_scans(df)
        assert sent and all("Aggregate" in " ".join(below[: [("FileScan" in x) for x in below].index(True)]) for below in sent if any("FileScan" in x for x in below))


@pytest.mark.parametrize("tile,stride", [(4, 2), (5, 3), (3, 5), (1, 1), (8, 8)])
def test_covering_starts_without_the_whole_axis(spark, tile, stride):
    """each trace went through all windows of its section."""
    dims = spark.range(1, 30).selectExpr("cast(id as int) as dim", "explode(sequence(0, cast(id as int) - 1)) as p")
    for r in dims.select("dim", "p", C.covering_starts(F.col("dim"), F.col("p"), tile, stride).alias("got")).collect():
        assert sorted(r.got) == [s for s in every_start(r.dim, tile, stride) if s <= r.p < s + tile], r
    far = spark.range(1).select(F.lit(2**31 - 1).alias("dim")).select(C.covering_starts(F.col("dim"), F.lit(10**9), 32, 16).alias("got")).first()
    assert len(far.got) == 2


def test_bounds_keep_no_section_in_a_buffer(spark):
    """of all values of a section, only those near the two ranks are put in order."""
    samples = spark.range(30000).selectExpr("concat('s', id % 2) as section_id", "cast((id * 7919) % 30011 - 9000 as float) / 8 as amplitude")
    found = normalize.clip_bounds(samples)
    assert " percentile(" not in found._jdf.queryExecution().executedPlan().treeString()
    want = {r.section_id: (r.lo, r.hi) for r in normalize.clip_bounds_in_buffer(samples).collect()}
    got = {r.section_id: (r.lo, r.hi) for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_sums_of_tiles(spark):
    """F8: a tile was spelled out in hexadecimals once for each of its pixels."""
    from tracewright import queries

    tiles = {(y, y % 3): RNG.integers(0, 256, 1024, dtype=np.uint8).tobytes() for y in range(5)}
    df = queries._sums(spark.createDataFrame([(y, x, p) for (y, x), p in tiles.items()], "tile_y int, tile_x int, pixels binary"))
    assert "conv(" not in df._jdf.queryExecution().toString()
    assert {(r.tile_y, r.tile_x): (r.n_pixels, r.sum_gray) for r in df.collect()} == {k: (1024, sum(v)) for k, v in tiles.items()}


def every_pixel(strips):
    key = lambda r: (r.section_id, r.label_id or 0, r.trace_idx, r.sample_idx, str(r.prob))
    return sorted(map(key, strips.collect()))


@pytest.mark.parametrize("batch", [10000, 7, 1])
def test_fused_strips_are_the_long_pixels(spark, batch):
    """with gaps, strips of no length, NaN, null, repeats and labels without a number."""
    rng = np.random.default_rng(batch)
    rows = []
    for _ in range(400):
        n = int(rng.integers(0, 9))
        probs = [None if p > 0.95 else float("nan") if p < 0.03 else float(np.float32(p - 0.3)) for p in rng.random(n)]
        rows.append((["a", "b"][rng.integers(2)], [1, 2, None][rng.integers(3)], int(rng.integers(0, 3)) * 4, int(rng.integers(0, 40)), int(rng.integers(0, 6)), probs if rng.random() < 0.95 else None))
    strips = spark.createDataFrame(rows + rows[:50], schemas.STRIPS).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        fused = stitch.fuse_strips(strips)
        want = every_pixel(stitch.stitch_long(stitch.strips_long(strips)))
        assert every_pixel(stitch.stitch_strips(strips)) == want and len(want) > 300
        assert every_pixel(stitch.strips_long(fused)) == every_pixel(stitch.strips_long(stitch.fuse_strips(fused))) == want
        kept = fused.collect()
        ends = {(r.section_id, r.label_id, r.tile_y, r.tile_x + len(r.probs)) for r in kept}
        assert not any((r.section_id, r.label_id, r.tile_y, r.tile_x) in ends for r in kept)  # a stretch is one row
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stitch.stitch_strips(strips.where("false")).count() == 0


def test_pixels_are_not_shuffled(spark, tmp_path):
    """all pixels of all tiles were dealt and counted in one table before they were fused."""
    from tracewright import queries

    spark.range(40).selectExpr("id as vec_id", "transform(sequence(0, 63), j -> cast((id * 5 + j) % 17 as float)) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.stitch_max(spark, str(tmp_path))
    assert found.count() == 5 * 40 * 64
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    explode = plan.index("posexplode(probs")
    assert not any(x in plan[:explode] for x in ("Aggregate", "Repartition")), plan
