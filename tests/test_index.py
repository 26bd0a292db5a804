"""What is read of SEG-Y files for filters, with and without a header index, and tiles cut in the scan."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from tracewright.operators import normalize, tiling
from tracewright.sinks import files
from tracewright.sources import segy

RNG = np.random.default_rng(6)


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    """Two cubes: inlines in order, and each inline in two runs with crosslines of their own."""
    at = tmp_path_factory.mktemp("cube")
    a = RNG.normal(size=(40 * 25, 30)).astype(np.float32)
    (at / "one.sgy").write_bytes(files.segy_bytes(a, segy.IEEE, np.repeat(np.arange(40), 25), np.tile(np.arange(25), 40)))
    (at / "two.sgy").write_bytes(files.segy_bytes(a, segy.IEEE, np.tile(np.repeat(np.arange(20), 25), 2), np.concatenate([np.tile(np.arange(25), 20), np.tile(np.arange(100, 125), 20)])))
    segy.index_segy(spark, f"{at}/index", f"{at}/*.sgy", f"{at}/missing.sgy", traces_per_partition=333)
    return at


def bytes_read(at, filters, monkeypatch, index=True):
    """Rows and bytes that a reader takes for pushed filters."""
    reader = segy.SegyReader({"path": f"{at}/*.sgy", "geometry": "3d", "traces_per_partition": "100"} | ({"index": f"{at}/index"} if index else {}))
    assert len(list(reader.pushFilters(filters))) == len(filters)
    parts, taken, rows = reader.partitions(), 0, []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, *x):
            return self.f.seek(*x)

        def read(self, n):
            nonlocal taken
            taken += n
            return self.f.read(n)

    monkeypatch.setattr(segy, "_open", lambda p: Counted(open(p, "rb")))
    for part in parts:
        for batch in reader.read(part):
            rows += [(r["path"].rsplit("/", 1)[-1], r["inline_no"], r["xline_no"], r["trace_idx"]) for r in batch.to_pylist()]
    monkeypatch.undo()
    return rows, taken // (segy.TRACE_HEADER + 120)


def test_one_inline_opens_its_runs(cube, monkeypatch):
    rows, traces = bytes_read(cube, [EqualTo(("inline_no",), 7)], monkeypatch)
    assert traces == 25 + 50 and {r[1] for r in rows} == {7}
    rows, traces = bytes_read(cube, [In(("inline_no",), (3, 4, 33))], monkeypatch)
    assert traces == 75 + 100 and {r[1] for r in rows} == {3, 4, 33}
    rows, traces = bytes_read(cube, [GreaterThan(("inline_no",), 36), LessThanOrEqual(("inline_no",), 38)], monkeypatch)
    assert traces == 50 and {r[1] for r in rows} == {37, 38}
    rows, traces = bytes_read(cube, [GreaterThanOrEqual(("xline_no",), 110), EqualTo(("inline_no",), 5)], monkeypatch)
    assert traces == 25 and {r[0] for r in rows} == {"two.sgy"}
    assert bytes_read(cube, [EqualTo(("inline_no",), 99)], monkeypatch)[1] == 0
    assert bytes_read(cube, [EqualTo(("inline_no",), 1), EqualTo(("inline_no",), 2)], monkeypatch)[1] == 0
    assert bytes_read(cube, [EqualTo(("inline_no",), 7)], monkeypatch, index=False)[1] == 2000
    assert bytes_read(cube, [LessThan(("trace_idx",), 130), GreaterThanOrEqual(("trace_idx",), 90)], monkeypatch, index=False)[1] == 80
    assert bytes_read(cube, [], monkeypatch)[1] == 2000


def test_same_rows_with_and_without(spark, cube):
    for where in ("inline_no = 7", "inline_no in (1, 19, 39) and xline_no < 5", "xline_no between 103 and 104", "inline_no > 37 or xline_no = 2", "trace_idx between 499 and 501", "inline_no is null", "inline_no = 3 and status = 'ok'"):
        a, b = (segy.read_segy(spark, f"{cube}/*.sgy", geometry="3d", **o).where(where) for o in ({}, {"index": f"{cube}/index"}))
        rows = sorted(map(tuple, a.collect()))
        assert rows == sorted(map(tuple, b.collect())) and (rows or "null" in where)
    with_index = segy.read_segy(spark, f"{cube}/*.sgy", f"{cube}/missing.sgy", geometry="3d", index=f"{cube}/index")
    assert with_index.where("inline_no = 0 or status <> 'ok'").groupBy("status").count().count() == 2


def test_changed_file_is_read_whole(spark, tmp_path, monkeypatch):
    a = RNG.normal(size=(20, 30)).astype(np.float32)
    path = tmp_path / "x.sgy"
    path.write_bytes(files.segy_bytes(a, segy.IEEE, np.repeat(np.arange(4), 5), np.tile(np.arange(5), 4)))
    segy.index_segy(spark, f"{tmp_path}/index", str(path))
    assert bytes_read(tmp_path, [EqualTo(("inline_no",), 3)], monkeypatch)[1] == 5
    path.write_bytes(files.segy_bytes(a, segy.IEEE, np.tile(np.arange(5), 4), np.repeat(np.arange(4), 5)))
    os.utime(path, ns=(5, 5))
    rows, traces = bytes_read(tmp_path, [EqualTo(("inline_no",), 3)], monkeypatch)
    assert traces == 20 and sum(r[1] == 3 for r in rows) == 4


@pytest.mark.parametrize("shape", [(50, 20), (5, 20), (50, 4), (3, 3), (8, 8), (33, 9)])
def test_tiles_cut_in_the_scan(spark, tmp_path, shape, monkeypatch):
    """Equal to tiles by shuffle, for sections above and below a tile; and beyond the bound on sections."""
    (tmp_path / "a.sgy").write_bytes(files.segy_bytes(RNG.normal(size=shape).astype(np.float32)))
    (tmp_path / "b.sgy").write_bytes(files.segy_bytes(np.full((9, 12), 2.0, np.float32)))
    rows = segy.read_segy(spark, f"{tmp_path}/*.sgy")
    bounds = normalize.clip_bounds(normalize.samples_long(rows))
    want = {(r.section_id, r.tile_y, r.tile_x): r.pixels for r in tiling.tile_cut(tiling.edge_pad(normalize.gray_traces(rows, bounds), 8), 8, 4).collect()}
    bands = segy.read_bands(spark, f"{tmp_path}/*.sgy", f"{tmp_path}/none.sgy", tile=8, stride=4, bands_per_partition=3)
    cut = tiling.tile_cut_scanned(bands, spark.createDataFrame(bounds.collect(), bounds.schema), 8, 4)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert {(r.section_id, r.tile_y, r.tile_x): r.pixels for r in cut.collect()} == want
    monkeypatch.setattr(tiling, "MOST_BOUNDS", 1)
    assert {(r.section_id, r.tile_y, r.tile_x): r.pixels for r in tiling.tile_cut_scanned(bands, bounds, 8, 4).collect()} == want
    with pytest.raises(ValueError):
        segy.read_bands(spark, f"{tmp_path}/*.sgy", tile=8, stride=0)


def test_bits_and_curves(spark):
    """Masks of a bit a pixel and threshold curves against plain ones, over rows of several lengths."""
    from tracewright import catalog
    from tracewright.operators import masks as M

    rng = np.random.default_rng(4)
    rows = [("s", k, t, [float(x) for x in np.append(rng.random(n - 1 if n else 0), [0.25] * bool(n)).astype(np.float32)]) for k in (1, 2) for t, n in enumerate((20, 20, 7, 0, 8, 1))]
    rows += [("s", 9, 0, [float("nan"), 0.5, 0.0, 1.0]), ("t", 1, 0, [0.0] * 9), ("t", 4, 0, [float("nan")] * 3)]
    maps = spark.createDataFrame(rows, "section_id string, label_id int, trace_idx int, probs array<float>").repartition(3)
    plain, labels = M.binarize_packed(maps, 0.25), catalog.label_catalog(spark)
    bits = M.binarize_bits(maps, 0.25)
    assert sorted(map(tuple, M.masks_from_bits(bits).collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, M.coverage(M.bit_counts(bits), labels).collect())) == sorted(map(tuple, M.coverage(M.packed_counts(plain), labels).collect()))
    long = plain.select("section_id", "label_id", F.explode("mask").alias("mask"))
    assert sorted(map(tuple, M.bits_any(bits).collect())) == sorted(map(tuple, M.mask_any(long).collect()))
    same = maps.where("section_id = 's' and label_id < 3")
    volume = {r.trace_idx: r.label_ids for r in M.label_volume_bits(M.binarize_bits(same, 0.25)).collect()}
    assert volume == {r.trace_idx: r.label_ids for r in M.label_volume_packed(M.binarize_packed(same, 0.25)).collect()}
    curve = {(r.section_id, r.label_id, r.step): (r.n_on, r.n) for r in M.threshold_curve(maps, 20).collect()}
    for step in range(21):
        counts = M.packed_counts(M.binarize_packed(maps, step / 20)).groupBy("section_id", "label_id").agg(F.sum("n_on").alias("k"), F.sum("n").alias("n"))
        for r in counts.collect():
            assert curve.get((r.section_id, r.label_id, step), (0, r.n)) == (r.k, r.n)
    assert M.threshold_curve(maps.where("false")).count() == 0 == bits.where("false").count()


@pytest.mark.parametrize("shape,bands", [((60, 20), 1), ((60, 20), 3), ((60, 20), 99), ((5, 20), 2), ((21, 4), 2), ((30, 9), 2)])
def test_fused_in_the_scan(spark, tmp_path, shape, bands, monkeypatch):
    """Maps and failures equal to those by shuffle; only what tasks share is a seam."""
    from tracewright.operators import stitch
    from tracewright.plans import segment

    (tmp_path / "a.sgy").write_bytes(files.segy_bytes(RNG.normal(size=shape).astype(np.float32)))
    (tmp_path / "b.sgy").write_bytes(files.segy_bytes(RNG.normal(size=(33, 12)).astype(np.float32)))
    fragile = fragile_class()
    traces = segy.read_segy(spark, f"{tmp_path}/*.sgy").select("section_id", "trace_idx", "samples")
    want = segment.segment_sections(traces, tile=8, stride=4, make_scorer=fragile)
    got = segment.segment_files(spark, f"{tmp_path}/*.sgy", tile=8, stride=4, make_scorer=fragile, bands_per_partition=bands)
    assert sorted(map(tuple, got.prob_maps.collect())) == sorted(map(tuple, want.prob_maps.collect()))
    assert sorted(map(tuple, got.failures.collect())) == sorted(map(tuple, want.failures.collect())) and got.failures.count()
    assert sorted(map(tuple, got.coverage.collect())) == sorted(map(tuple, want.coverage.collect()))
    fused = stitch.fuse_scanned(got.tiles, fragile, 8, 4)
    seams = fused.where("seam").count()
    cuts = sum(-(-len(segy.window_starts(n, 8, 4)) // bands) - 1 for n in (shape[0], 33))
    assert (seams > 0) == (cuts > 0) and seams <= 2 * 2 * 8 * cuts
    monkeypatch.setattr(tiling, "MOST_BOUNDS", 0)
    dealt = segment.segment_files(spark, f"{tmp_path}/*.sgy", tile=8, stride=4, make_scorer=fragile)
    assert sorted(map(tuple, dealt.prob_maps.collect())) == sorted(map(tuple, want.prob_maps.collect()))


def fragile_class():
    """Made in a function, so that it goes to the workers by value."""

    class Fragile:
        labels = (1, 4)

        def score(self, tile, y, x):
            if (y, x) == (4, 0):
                raise RuntimeError("this one")
            return [np.asarray(tile, np.float32) / 255 * (0.5 + (y + x) % 3 / 4), np.full(tile.shape, 0.1 * ((y // 4) % 5), np.float32)]

    return Fragile


def test_batches_of_tiles(spark):
    """A scorer of batches: the same strips, a failing tile alone fails, and the sizes of batches."""
    from tracewright.operators import scoring

    sizes, Fragile = spark.sparkContext.accumulator(0), fragile_class()

    class Batched(Fragile):
        def score_batch(self, tiles, ys, xs):
            sizes.add(len(tiles) if len(tiles) > 1 else 0)
            return [list(self.score(t, y, x)) for t, y, x in zip(tiles, ys, xs, strict=True)]

    rows = [("s", y, x, bytes((y * 7 + x * 3 + k) % 256 for k in range(64))) for y in range(0, 40, 4) for x in range(0, 12, 4)]
    tiles = spark.createDataFrame(rows, "section_id string, tile_y int, tile_x int, pixels binary").repartition(2)
    plain = sorted(map(repr, scoring.score_tiles(tiles, Fragile, 8).collect()))
    assert sorted(map(repr, scoring.score_tiles(tiles, Batched, 8, batch_tiles=4).collect())) == plain and sizes.value >= 24
    assert sum("this one" in r for r in plain) == 1 and len(plain) == 1 + 29 * 2 * 8

    def none():
        raise OSError("no model")

    assert {r.error for r in scoring.score_tiles(tiles, none, 8).collect()} == {"OSError: no model"}


def test_short_runs_share_a_partition(spark, tmp_path, monkeypatch):
    """F16: crosslines before inlines, so that an inline has as many runs as traces."""
    a = RNG.normal(size=(600, 30)).astype(np.float32)
    (tmp_path / "x.sgy").write_bytes(files.segy_bytes(a, segy.IEEE, np.tile(np.arange(6), 100), np.repeat(np.arange(100), 6)))
    segy.index_segy(spark, f"{tmp_path}/index", f"{tmp_path}/x.sgy")
    reader = segy.SegyReader({"path": f"{tmp_path}/x.sgy", "geometry": "3d", "index": f"{tmp_path}/index", "traces_per_partition": "64"})
    list(reader.pushFilters([In(("inline_no",), (2, 5))]))
    parts = reader.partitions()
    assert [p.count for p in parts] == [64, 64, 64, 8]
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = [i for i in range(600) if i % 6 in (2, 5)]
    assert [r["trace_idx"] for r in got] == want and all(r["inline_no"] == i % 6 and r["xline_no"] == i // 6 and r["samples"] == a[i].tolist() for r, i in zip(got, want, strict=True))
    assert bytes_read(tmp_path, [EqualTo(("inline_no",), 5)], monkeypatch)[1] == 100


@pytest.mark.parametrize("tile,stride", [(8, 4), (5, 3), (3, 5), (16, 16)])
def test_starts_between(tile, stride):
    """a task looks only at the bands around its traces."""
    for n in range(1, 40):
        for low in range(-20, 40):
            for high in range(low, 42):
                assert segy.window_starts_between(n, tile, stride, low, high) == [y for y in segy.window_starts(n, tile, stride) if low <= y <= high]
    assert len(segy.window_starts_between(10**12, 32, 16, 10**11, 10**11 + 64)) == 5
