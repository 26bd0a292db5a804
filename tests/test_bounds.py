"""Clip bounds from kept counts: equal to all samples' percentiles, and what is read again."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import broadcast_scans
from tracewright.operators import normalize
from tracewright.sinks import files
from tracewright.sources import bounds, segy

RNG = np.random.default_rng(11)


def written(path, samples, *numbers):
    path.write_bytes(files.segy_bytes(samples.astype(np.float32), segy.IEEE, *numbers))
    return samples.astype(np.float32)


def emptied(path):
    """The file with all samples zero, its header, size and time as they were."""
    at, stamp = segy.layout_of(str(path)), os.stat(path).st_mtime_ns
    raw = bytearray(path.read_bytes())
    raw[at.start :] = bytes(len(raw) - at.start)
    path.write_bytes(bytes(raw))
    os.utime(path, ns=(stamp, stamp))


def by_name(found):
    return {r.section_id.rsplit("/", 1)[-1]: (r.lo, r.hi) for r in found.collect()}


def percentiles(*samples, low=2, high=98):
    v = np.concatenate([s.ravel() for s in samples]).astype(np.float64)
    return tuple(np.percentile(v[~np.isnan(v)], [low, high]))


def test_bits_keep_the_order():
    v = np.array([-np.inf, -3e38, -2.5, -1e-40, -0.0, 0.0, 1e-45, 1.0, np.float32(1) + np.float32(2**-23), 3e38, np.inf], np.float32)
    keys = bounds.ordered_bits(v)
    assert (np.diff(keys.astype(np.int64)) > 0).all() and (bounds.from_ordered_bits(keys).view(np.uint32) == v.view(np.uint32)).all()


@pytest.mark.parametrize("low,high", [(2, 98), (0, 100), (37.5, 37.5)])
def test_equal_to_percentiles_of_all_samples(spark, tmp_path, low, high):
    wild = RNG.normal(size=(60, 20)) * 10.0 ** RNG.integers(-30, 30, (60, 20))
    wild[::7, 3] = np.nan
    wild[5] = -0.0
    cases = {
        "wild.sgy": wild, "ties.sgy": RNG.integers(-2, 3, (33, 7)), "flat.sgy": np.full((4, 5), 7.5), "one.sgy": np.full((1, 1), -3.0),
        "two.sgy": np.array([[1.0, -1.0]]), "plain.sgy": RNG.normal(size=(50, 30)),
    }
    cases = {name: written(tmp_path / name, v) for name, v in cases.items()}
    written(tmp_path / "nan.sgy", np.full((3, 4), np.nan))
    (tmp_path / "broken.sgy").write_bytes(b"x")
    got = by_name(bounds.kept_bounds(spark, f"{tmp_path}/kept", f"{tmp_path}/*.sgy", f"{tmp_path}/none.sgy", low=low, high=high, traces_per_range=9))
    assert got.keys() == cases.keys()
    for name, v in cases.items():
        assert np.allclose(got[name], percentiles(v, low=low, high=high), rtol=1e-12, atol=0), name
    rows = segy.read_segy(spark, f"{tmp_path}/*.sgy").where("status = 'ok'")
    want = by_name(normalize.clip_bounds_two_pass(normalize.samples_long(rows), low, high))
    assert want.keys() == got.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)


def test_added_file_leaves_the_others_unread(spark, tmp_path):
    """The old file's samples are gone when the new one comes; the bounds still know them."""
    old = written(tmp_path / "a.sgy", RNG.normal(size=(90, 40)))
    survey = lambda *names: by_name(bounds.kept_bounds(spark, f"{tmp_path}/kept", *[f"{tmp_path}/{n}" for n in names], by=F.lit("survey"), traces_per_range=16, margin=6))
    before = survey("a.sgy")
    assert np.allclose(before["a.sgy"], percentiles(old), rtol=1e-12)
    emptied(tmp_path / "a.sgy")
    new = written(tmp_path / "b.sgy", RNG.normal(size=(30, 40)) * 1.05)
    after = survey("a.sgy", "b.sgy")
    assert after["a.sgy"] == after["b.sgy"] != before["a.sgy"]
    assert np.allclose(after["a.sgy"], percentiles(old, new), rtol=1e-12)
    counted = spark.read.parquet(f"{tmp_path}/kept/ranges").groupBy("path").agg(F.sum("traces").alias("n")).collect()
    assert sorted(r.n for r in counted) == [30, 90]
    assert np.allclose(survey("b.sgy")["b.sgy"], percentiles(new), rtol=1e-12)  # each alone, from the same counts


def test_changed_file_is_counted_again_and_lost_runs_count_for_nothing(spark, tmp_path):
    path = tmp_path / "a.sgy"
    written(path, RNG.normal(size=(20, 10)))
    bounds.keep_counts(spark, f"{tmp_path}/kept", str(path), traces_per_range=8)
    # what a run left that ended before its ranges were written
    spark.createDataFrame([("lost", str(path), 0, str(path), 65535, 10**6)], bounds.COUNTS).write.mode("append").parquet(f"{tmp_path}/kept/counts")
    v = written(path, RNG.normal(size=(20, 10)) * 50)
    os.utime(path, ns=(9, 9))
    for _ in range(2):
        assert np.allclose(by_name(bounds.kept_bounds(spark, f"{tmp_path}/kept", str(path)))["a.sgy"], percentiles(v), rtol=1e-12)
    assert spark.read.parquet(f"{tmp_path}/kept/ranges").select("run").distinct().count() == 2
    assert bounds.kept_bounds(spark, f"{tmp_path}/kept", f"{tmp_path}/none.sgy").count() == 0


def test_inlines_of_cubes_share_bounds_across_files(spark, tmp_path):
    a, b = (written(tmp_path / f"{n}.sgy", RNG.normal(size=(24, 9)), np.tile(np.arange(4), 6), np.repeat(np.arange(6), 4)) for n in "ab")
    inline = F.regexp_extract("section_id", r"#(\d+)$", 1)
    got = bounds.kept_bounds(spark, f"{tmp_path}/kept", f"{tmp_path}/*.sgy", geometry="3d", by=inline, traces_per_range=5).collect()
    assert len(got) == 8
    for r in got:
        i = int(r.section_id.rsplit("#", 1)[1])
        assert np.allclose((r.lo, r.hi), percentiles(a[i::4], b[i::4]), rtol=1e-12)


def test_counts_are_not_sent_to_the_driver(spark, tmp_path):
    """their files are small, their rows are many."""
    written(tmp_path / "a.sgy", RNG.normal(size=(40, 20)))
    found = bounds.kept_bounds(spark, f"{tmp_path}/kept", f"{tmp_path}/a.sgy", traces_per_range=8)
    sent = [x for below in broadcast_scans(found) for x in below[:1 + [("Aggregate" in y) for y in [*below, "Aggregate"]].index(True)]]
    assert sent and not any("FileScan" in x and "section_id" in x for x in sent)
    assert np.allclose(by_name(found)["a.sgy"], by_name(bounds.kept_bounds(spark, f"{tmp_path}/kept", f"{tmp_path}/a.sgy", traces_per_range=8))["a.sgy"])
