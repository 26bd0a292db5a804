"""Tiles dealt, scored and fused by blocks of bands, and bounds of whole traces."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sections import every_mask, every_start, np_gray, traces
from tracewright import schemas
from tracewright.operators import masks as M
from tracewright.operators import normalize, scoring, tiling
from tracewright.plans import segment

RNG = np.random.default_rng(11)


def test_scores_are_not_shuffled(spark, tmp_path):
    """every row of every tile and label was shuffled, and fused twice for ``coverage``."""
    traces(spark, a=RNG.normal(size=(40, 20))).write.parquet(f"{tmp_path}/t")
    done = segment.segment_sections(spark.read.parquet(f"{tmp_path}/t"), tile=8, stride=4)
    above = executed(done.prob_maps).split("MapInArrow run", 1)[0].replace("BroadcastExchange", "")
    assert "Exchange" not in above
    assert executed(done.coverage).count("tile_xs#") == executed(done.bits).count("tile_xs#")


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stage", [False, True])
@pytest.mark.parametrize("shape,tile,stride", [((150, 13), 8, 4), ((90, 9), 8, 3), ((70, 6), 4, 4), ((67, 5), 8, 7), ((3, 40), 8, 4)])
def test_blocks_equal_numpy(spark, shape, tile, stride, stage):
    a, b = RNG.normal(size=shape), RNG.normal(size=(shape[0] // 2 + 1, shape[1]))
    done = segment.segment_sections(traces(spark, a=a, b=b), tile=tile, stride=stride, threshold=0.6, stage=stage)
    want = {"a": every_mask(a, tile, stride, 0.6), "b": every_mask(b, tile, stride, 0.6)}
    rows = done.masks.collect()
    assert len(rows) == len({(r.section_id, r.label_id, r.trace_idx) for r in rows}) == 5 * (len(a) + len(b))
    for r in rows:
        assert r.mask == want[r.section_id][r.label_id - 1, r.trace_idx].tolist()
    assert len(blocks_of(done, tile, stride)) > 2 or shape[0] < tile


def blocks_of(done, tile, stride) -> set:
    dealt = tiling.deal_blocks(done.gray.select("section_id", "trace_idx", F.lit(b"\0").alias("gray")), done.shapes, tile, stride)
    return {(r.section_id, r.block) for r in dealt.select("section_id", "block").distinct().collect()}


@pytest.mark.parametrize("stage", [False, True])
def test_a_failed_tile_is_told_of_once(spark, stage):
    """Also where the tile lies over the end of a block and two blocks score it."""
    calls = spark.sparkContext.accumulator(0)

    class Fails(scoring.ClosedFormScorer):
        def score(self, tile, y, x):
            calls.add(1)
            if y % 12 == 0 or (x == 4 and y % 8 == 4):
                raise RuntimeError(f"lost {y} {x}")
            return list(super().score(tile, y, x))

    a = RNG.normal(size=(101, 11))
    done = segment.segment_sections(traces(spark, a=a), tile=8, stride=4, make_scorer=Fails, stage=stage)
    tiles = [(y, x) for y in every_start(101, 8, 4) for x in every_start(11, 8, 4)]
    lost = [t for t in tiles if t[0] % 12 == 0 or (t[1] == 4 and t[0] % 8 == 4)]
    assert sorted((r.tile_y, r.tile_x, r.error) for r in done.failures.collect()) == sorted((y, x, f"RuntimeError: lost {y} {x}") for y, x in lost)
    assert calls.value == len(tiles) if stage else len(tiles) < calls.value < 1.3 * len(tiles)
    good = [t for t in tiles if t not in lost]
    assert {r.trace_idx for r in done.masks.collect()} == {i for y, _ in good for i in range(y, y + 8)}


@pytest.mark.parametrize("stage", [False, True])
def test_traces_that_are_missing(spark, stage):
    """They were left out of tiles, so that traces after them were scored in other places."""
    a = RNG.normal(size=(90, 12)).astype(np.float32)
    there = [i for i in range(90) if i not in (0, 7, 16, 83) and not 30 <= i < 55]
    rows = [("a", i, a[i].tolist()) for i in there]
    t = spark.createDataFrame(rows + rows[3:5], schemas.TRACES).withColumn("trace_idx", F.col("trace_idx").cast("long"))
    bounds = spark.createDataFrame([("a", -1.0, 1.0)], "section_id string, lo double, hi double")
    done = segment.segment_sections(t, tile=8, stride=4, stage=stage, bounds=bounds)
    gray = np.zeros((90, 12), np.uint8)
    gray[there] = np.floor((np.clip(a[there].astype(float), -1, 1) + 1) / 2 * 255).astype(np.uint8)
    best = np.zeros((5, 90, 12), np.float32)
    for y in every_start(90, 8, 4):
        for x in every_start(12, 8, 4):
            best[:, y : y + 8, x : x + 8] = np.maximum(best[:, y : y + 8, x : x + 8], list(scoring.ClosedFormScorer().score(gray[y : y + 8, x : x + 8], y, x)))
    got = {(r.label_id, r.trace_idx): r.probs for r in done.prob_maps.collect()}
    assert got.keys() == {(k, i) for k in range(1, 6) for i in there}
    assert all(np.array_equal(np.float32(v), best[k - 1, i]) for (k, i), v in got.items())


def test_bounds_and_bytes_of_whole_traces(spark, monkeypatch):
    wild = (RNG.normal(size=(60, 20)) * 10.0 ** RNG.integers(-30, 30, (60, 20))).astype(np.float32)
    wild[::7, 3], wild[5], wild[6, :2] = np.nan, -0.0, (np.inf, -np.inf)
    cases = {"wild": wild, "ties": RNG.integers(-2, 3, (33, 7)), "flat": np.full((4, 5), 7.5), "one": [[-3.0]], "two": [[1.0, -1.0]], "nan": [[np.nan] * 3], "large": RNG.normal(size=(300, 70))}
    odd = spark.createDataFrame([("odd", 0, [1.0, None, 4.0]), ("odd", 1, []), ("odd", 2, None), ("odd", 3, [2.0])], schemas.TRACES)
    t = traces(spark, **cases).unionByName(odd).repartition(3)
    monkeypatch.setattr(normalize, "SLICE", 1000)
    want = {r.section_id: (r.lo, r.hi) for r in normalize.clip_bounds_in_buffer(normalize.samples_long(t)).collect()}
    assert want.keys() == {*cases, "odd"} - {"nan"}
    for few in (0, 1 << 13):
        monkeypatch.setattr(normalize, "FEW", few)
        for rate in (2.0, 98.0), (0.0, 100.0), (50.0, 51.5):
            some = {r.section_id: (r.lo, r.hi) for r in normalize.clip_bounds_in_buffer(normalize.samples_long(t), *rate).collect()}
            got = {r.section_id: (r.lo, r.hi) for r in normalize.clip_bounds_of_traces(t, *rate).collect()}
            assert got.keys() == some.keys() and all(got[k] == pytest.approx(some[k], rel=1e-12) for k in some)
    bounds = spark.createDataFrame([*((k, *v) for k, v in want.items()), ("nan", None, None)], "section_id string, lo double, hi double")
    plain = sorted((r.section_id, r.trace_idx, list(r.gray)) for r in normalize.gray_traces(t.where("samples is not null"), bounds).collect())
    assert plain == sorted((r.section_id, r.trace_idx, list(r.gray)) for r in normalize.gray_bytes(t, bounds).collect())
    assert np.array_equal([g for s, _, g in plain if s == "large"], np_gray(cases["large"]))


def test_coverage_of_labels_without_masks(spark):
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "label_id int, label string")
    counts = spark.createDataFrame([("s", 1, 3, 4), ("s", 1, 0, 4), ("t", 3, 1, 1), ("u", None, 1, 1), ("v", 2, 0, 0)], "section_id string, label_id int, n_on long, n long")
    got = {(r.section_id, r.label_id): (r.pct, r.pct_text) for r in M.coverage(counts, labels).collect()}
    assert got.pop(("s", 1)) == (37.5, "37.50%") and got == {(s, k): (0.0, "0.00%") for s in "stuv" for k in (1, 2) if (s, k) != ("s", 1)}
