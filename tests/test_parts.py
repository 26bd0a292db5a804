"""Artifacts made in pieces: one whole file per section, or none."""

from __future__ import annotations

import io
import os
import random
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_files import image_of

from tracewright import fixtures, queries
from tracewright.plans import segment
from tracewright.sinks import files, formats, readback
from tracewright.sources import segy

BYTES = st.binary(max_size=4000)


@settings(max_examples=100, deadline=None)
@given(st.lists(BYTES, max_size=6))
def test_joined_streams(parts):
    """Bands one after the other are one stream, and the checksums those of the whole."""
    bands, whole = [formats.band_of(p) for p in parts], b"".join(parts)
    assert zlib.decompress(b"".join(b.data for b in bands) + formats.LAST_BLOCK, -15) == whole
    crc, adler = 0, 1
    for b in bands:
        crc, adler = formats.joined_crc(crc, b.crc, b.size), formats.joined_adler(adler, b.adler, b.size)
    assert crc == zlib.crc32(whole) and adler == zlib.adler32(whole)


def test_checksums_of_long_pieces():
    a, b = random.Random(1).randbytes(70_000), b"\xff" * 3_000_001
    assert formats.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert formats.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_archive_beyond_32_bits():
    """The directory of an archive whose members are said to be larger and further than 4 GiB."""
    members = [formats.Member("a.npy", 5 << 32, 6 << 32, 7 << 32, 9)]
    fake = io.BytesIO(formats.zip_directory(members, 0))
    with zipfile.ZipFile(fake) as z:
        (info,) = z.infolist()
        assert (info.filename, info.compress_size, info.file_size, info.CRC) == ("a.npy", 6 << 32, 7 << 32, 9)


@pytest.fixture(scope="module")
def section(spark):
    a = np.random.default_rng(3).normal(size=(30, 20)).astype(np.float32)
    traces = spark.createDataFrame([("x/line.sgy", i, a[i].tolist(), 7, 100 - i) for i in range(30)], "section_id string, trace_idx int, samples array<float>, inline_no int, xline_no int")
    done = segment.segment_sections(traces.select("section_id", "trace_idx", "samples"), tile=8, stride=4)
    return a, traces.repartition(3), done


@pytest.mark.parametrize("most", [150, 7, 1 << 20])
def test_one_file_of_each_kind(spark, tmp_path, section, most):
    """Pieces of several traces, of less than a trace, and all in one."""
    a, traces, done = section
    manifest = segment.export_all(done, str(tmp_path / "all"), most_pixels=most)
    rows = {r.artifact: r for r in manifest.collect()}
    assert sorted(os.listdir(tmp_path / "all")) == sorted(os.path.basename(r.path) for r in rows.values()) and len(rows) == 3
    assert all(r.status == "written" and r.n_bytes == os.path.getsize(r.path) for r in rows.values())
    masks = {(r.label_id, r.trace_idx): r.mask for r in done.masks.collect()}
    with np.load(rows["masks_npz"].path) as z:
        assert z["fault"].tolist() == [masks[1, i] for i in range(30)] and z["seismic_facies"].dtype == bool and len(z.files) == 5
        volume = np.max([z[n] * k for k, n in enumerate(("fault", "channel", "seismic_facies", "salt_body", "horizon"), 1)], axis=0)
    assert zipfile.ZipFile(rows["masks_npz"].path).testzip() is None
    image = image_of(rows["overlay_png"].path)
    for r in segment.overlay_traces(done).collect():
        assert np.array_equal(image[r.trace_idx], np.stack([r.r, r.g, r.b], 1))
    # and as tables again
    assert {(r.label_id, r.trace_idx): r.mask for r in readback.masks_of(manifest).collect()} == masks
    for r in readback.overlays_of(manifest).collect():
        assert np.array_equal(image[r.trace_idx], np.stack([r.r, r.g, r.b], 1))
    for r in readback.volumes_of(manifest).collect():
        assert r.label_ids == volume[:, r.sample_idx].tolist()

    written = files.export_segy(traces, str(tmp_path / "sgy"), most_pixels=most).collect()
    assert [r.status for r in written] == ["written"] and os.listdir(tmp_path / "sgy") == [os.path.basename(written[0].path)]
    rows = segy.read_segy(spark, f"{tmp_path}/sgy/*.sgy").collect()
    assert sorted(r.trace_idx for r in rows) == list(range(30)) and all(r.samples == a[r.trace_idx].tolist() for r in rows)
    cube = segy.inline_slices(segy.read_segy(spark, f"{tmp_path}/sgy/*.sgy", geometry="3d")).collect()
    assert len(cube) == 30 and all(r.samples == a[29 - r.trace_idx].tolist() for r in cube)


def test_small_reads(tmp_path, section, monkeypatch):
    monkeypatch.setattr(readback, "STEP", 50)
    _, _, done = section
    manifest = segment.export_all(done, str(tmp_path), most_pixels=90)
    assert readback.masks_of(manifest).count() == 150 and readback.overlays_of(manifest).count() == 30 and readback.volumes_of(manifest).count() == 20


def test_second_action_writes_nothing(tmp_path, section):
    _, _, done = section
    manifest = files.export_npz(done.masks, str(tmp_path), 150)
    (path,) = [r.path for r in manifest.collect()]
    was = os.stat(path)
    os.utime(path, ns=(1, 1))
    assert manifest.count() == 1 and os.stat(path).st_mtime_ns == 1 and os.stat(path).st_ino == was.st_ino
    again = files.export_npz(done.masks, str(tmp_path), 150).collect()
    assert again[0].path == path and os.stat(path).st_ino != was.st_ino and os.listdir(tmp_path) == [os.path.basename(path)]


def test_failed_job_leaves_no_file(spark, tmp_path, section):
    """The job is stopped by a task after others have made their files."""
    _, _, done = section
    pieces = files.npz_pieces(done.masks, str(tmp_path / "out"), 150)
    with pytest.raises(Exception, match="no such piece"):
        stop = pieces.limit(1).withColumn("path", F.concat("path", F.lit("x"))).withColumn("size", F.expr("if(seq >= 0, raise_error('no such piece'), size)"))
        files.write_pieces(spark, pieces.unionByName(stop), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_one_section_fails_alone(spark, tmp_path):
    """A section without one of its traces, one with a trace twice, and whole ones."""
    rows = [(s, i, [bool((i + j) % 2) for j in range(6)]) for s in ("a", "b", "c", "d") for i in range(9)]
    rows = [r for r in rows if r[:2] != ("b", 4)] + [("c", 3, [True] * 6)]
    masks = spark.createDataFrame([(s, 1, i, m) for s, i, m in rows], "section_id string, label_id int, trace_idx int, mask array<boolean>")
    found = {r.section_id: r for r in files.export_npz(masks, str(tmp_path), 12).collect()}
    assert {k: r.status for k, r in found.items()} == {"a": "written", "b": "failed", "c": "failed", "d": "written"}
    assert "trace" in found["b"].error and sorted(os.listdir(tmp_path)) == sorted(os.path.basename(found[k].path) for k in "ad")
    gone = files.export_npz(masks.where("section_id = 'a' and trace_idx not between 2 and 5"), str(tmp_path), 12, spark.createDataFrame([("a", 9, 6)], "section_id string, n_traces int, n_samples int"))
    assert "missing" in gone.first().error
    assert files.export_npz(masks.where("false"), str(tmp_path)).count() == 0


def test_failures_are_scored_once(spark, section):
    """A model that fails on some tiles: failures come with the maps, and each tile is scored once."""
    _, traces, _ = section
    calls = spark.sparkContext.accumulator(0)

    class Model:
        labels = (1, 3)

        def score(self, tile, y, x):
            calls.add(1)
            if y == 8:
                raise RuntimeError(f"lost {x}")
            return [np.full(tile.shape, 0.9, np.float32)] * 2

    done = segment.segment_sections(traces.select("section_id", "trace_idx", "samples"), tile=8, stride=4, make_scorer=Model, stage=True)
    failed = {(r.tile_y, r.tile_x, r.error) for r in done.failures.collect()}
    assert failed == {(8, x, f"RuntimeError: lost {x}") for x in (0, 4, 8, 12)}
    assert {r.label_id: r.pct for r in done.coverage.collect()} == {1: 100.0, 2: 0.0, 3: 100.0, 4: 0.0, 5: 0.0}
    assert done.masks.count() == 60 and calls.value == 7 * 4


def test_nothing_lost_in_silence(spark, monkeypatch):
    line = spark.createDataFrame([(i, [float(i)] * 8, i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(fixtures, "read", lambda *_: line)
    assert queries.segy_scan(spark, "").count() == 160 and queries.segy_volume(spark, "").count() == 20
    monkeypatch.setattr(fixtures, "read", lambda *_: line.where("vec_id <> 7"))
    with pytest.raises(RuntimeError, match="not written"):
        queries.segy_scan(spark, "")


def test_volume_in_runs_of_blocks(spark, tmp_path, monkeypatch):
    """a row was made for each trace and piece of samples, and the rows of a task were sorted."""
    ids = np.random.default_rng(8).integers(0, 6, (30, 20)).astype(np.int32)
    volume = spark.createDataFrame([("a", i, ids[i].tolist()) for i in range(30)], "section_id string, trace_idx int, label_ids array<int>").repartition(3)
    seen, pieces = [], files._pieces
    monkeypatch.setattr(files, "_pieces", lambda rows, *rest: seen.append(rows.count()) or pieces(rows, *rest))
    for most, blocks, chunks in ((64, 10, 10), (25, 30, 20), (200, 3, 4), (1 << 20, 1, 1)):
        (made,) = files.export_vti(volume, str(tmp_path / str(most)), most_pixels=most).collect()
        assert made.status == "written" and seen.pop() == blocks * chunks
        raw = open(made.path, "rb").read()
        at = raw.index(b"_", raw.index(b"<AppendedData")) + 9
        assert np.array_equal(np.frombuffer(raw[at : at + 4 * ids.size], "<i4").reshape(ids.shape, order="F"), ids)


def test_volume_with_traces_missing_or_twice(spark, tmp_path):
    rows = [(s, i, [i % 6] * 6) for s in "abcde" for i in range(12)]
    rows = [r for r in rows if r[:2] != ("b", 5) and (r[0] != "d" or r[1] not in (2, 3))] + [("c", 7, [1] * 6)]
    shapes = spark.createDataFrame([(s, 12 if s != "e" else 11, 6) for s in "abcde"], "section_id string, n_traces int, n_samples int")
    volume = spark.createDataFrame(rows, "section_id string, trace_idx int, label_ids array<int>")
    for most in (12, 5, 1 << 20):
        found = {r.section_id: r for r in files.export_vti(volume, str(tmp_path / str(most)), most_pixels=most, shapes=shapes).collect()}
        assert {k: r.status for k, r in found.items()} == {"a": "written", "b": "failed", "c": "failed", "d": "failed", "e": "failed"}
        assert all("trace" in found[k].error for k in "bcde") and len(os.listdir(tmp_path / str(most))) == 1
