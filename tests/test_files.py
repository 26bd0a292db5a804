"""The SEG-Y source and the file sinks, on files that the tests write."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tracewright import catalog
from tracewright.plans import segment
from tracewright.sinks import files
from tracewright.sources import segy

RNG = np.random.default_rng(5)


def image_of(path):
    """An RGB image of 8 bits without filters, by the format's own rules."""
    data, at, parts, shape = open(path, "rb").read(), 8, [], None
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        if kind == b"IHDR":
            shape = int.from_bytes(body[4:8], "big"), int.from_bytes(body[:4], "big")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], 1 + 3 * shape[1])
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(*shape, 3)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sgy")
    a = RNG.normal(size=(30, 20)).astype(np.float32)
    (at / "line_ieee.sgy").write_bytes(files.segy_bytes(a))
    (at / "line_ibm.sgy").write_bytes(files.segy_bytes(a, segy.IBM))
    cube = RNG.normal(size=(6 * 5, 8)).astype(np.float32)
    (at / "cube.segy").write_bytes(files.segy_bytes(cube, segy.IEEE, np.repeat(np.arange(6) + 100, 5), np.tile(np.arange(5)[::-1] + 7, 6)))
    (at / "flat.sgy").write_bytes(files.segy_bytes(np.full((4, 4), 2.0, np.float32)))
    (at / "empty.sgy").write_bytes(files.segy_bytes(np.zeros((0, 4), np.float32)))
    (at / "cut.sgy").write_bytes(files.segy_bytes(a)[:-3])
    (at / "int16.sgy").write_bytes(files.segy_bytes(a, 3))
    return at, a, cube


@pytest.mark.parametrize("per", [1000, 7])
def test_scan(spark, folder, per):
    at, a, _ = folder
    rows = segy.read_segy(spark, f"{at}/*.sgy", f"{at}/line_*.sgy", f"{at}/missing.sgy", traces_per_partition=per).collect()
    status = {r.path.rsplit("/", 1)[-1]: r.status for r in rows}
    assert status == {"line_ieee.sgy": "ok", "line_ibm.sgy": "ok", "flat.sgy": "ok", "empty.sgy": "empty", "cut.sgy": "truncated", "int16.sgy": "unsupported", "missing.sgy": "missing"}
    for name, exact in (("line_ieee", True), ("line_ibm", False)):
        own = sorted((r.trace_idx, r.samples) for r in rows if name in r.path)
        assert [i for i, _ in own] == list(range(30))
        got = np.array([s for _, s in own], np.float32)
        assert np.array_equal(got, a) if exact else np.allclose(got, a, rtol=1e-6)


def test_pushed_path(spark, folder):
    at, _, _ = folder
    rows = segy.read_segy(spark, f"{at}/*.sgy").where(f"path = '{at}/flat.sgy'").collect()
    assert {r.path for r in rows} == {f"{at}/flat.sgy"} and len(rows) == 4


def test_cube(spark, folder):
    at, _, cube = folder
    rows = segy.inline_slices(segy.read_segy(spark, f"{at}/cube.segy", geometry="3d")).collect()
    for r in rows:
        assert np.array_equal(np.array(r.samples, np.float32), cube[(r.inline_no - 100) * 5 + 4 - r.trace_idx])
    assert len({r.section_id for r in rows}) == 6


def test_ibm_round_trip():
    v = np.array([0.0, 1.0, -1.0, 118.625, -0.15625, 1e-20, 3e30], np.float32)
    assert np.allclose(segy.decode_ibm(segy.encode_ibm(v)), v, rtol=1e-6)
    assert segy.encode_ibm(np.array([-118.625]))[0] == 0xC276A000
    with pytest.raises(ValueError):
        segy.encode_ibm(np.array([np.nan]))


def test_exports_and_manifest(spark, folder, tmp_path):
    at, a, _ = folder
    rows = segy.read_segy(spark, f"{at}/line_ieee.sgy", f"{at}/cut.sgy")
    done = segment.segment_sections(rows.where("status = 'ok'").select("section_id", "trace_idx", "samples"), tile=8, stride=4)
    written = segment.export_all(done, str(tmp_path))
    found = {r.artifact: r for r in segment.run_manifest(rows, written).collect()}
    assert {k: r.status for k, r in found.items()} == {"input": "truncated", "overlay_png": "written", "masks_npz": "written", "labels_vti": "written"}
    masks = {(r.label_id, r.trace_idx): r.mask for r in done.masks.collect()}
    with np.load(found["masks_npz"].path) as z:
        assert sorted(z.files) == sorted(x[1].replace(" ", "_") for x in catalog.LABELS)
        for k, name, *_ in catalog.LABELS:
            assert z[name.replace(" ", "_")].tolist() == [masks[k, i] for i in range(30)]
        volume = np.max([z[n.replace(" ", "_")] * k for k, n, *_ in catalog.LABELS], axis=0)
    vti = open(found["labels_vti"].path, "rb").read()
    raw = vti[vti.index(b"_", vti.index(b"<AppendedData")) + 1 :]
    assert int.from_bytes(raw[:8], "little") == volume.size * 4
    assert np.array_equal(np.frombuffer(raw[8 : 8 + 4 * volume.size], "<i4").reshape(volume.shape, order="F"), volume)
    assert b'WholeExtent="0 30 0 20 0 1"' in vti and b'Spacing="25.0 4.0 1.0"' in vti
    pixels = image_of(found["overlay_png"].path)
    want = {(t.trace_idx, j): [t.r[j], t.g[j], t.b[j]] for t in segment.overlay_traces(done).collect() for j in range(len(t.r))}
    assert all(pixels[k].tolist() == v for k, v in want.items()) and len(want) == 600


def test_places_that_cannot_be_written(spark, folder):
    at, _, _ = folder
    rows = segy.read_segy(spark, f"{at}/line_ieee.sgy").select("section_id", "trace_idx", "samples")
    done = segment.segment_sections(rows, tile=8, stride=4)
    lost = files.export_npz(done.masks, "/proc/nowhere").collect()
    assert [(r.status, r.artifact) for r in lost] == [("failed", "masks_npz")] and lost[0].error
    with pytest.raises(ValueError):
        files.export_npz(done.masks, "s3://bucket/x")


def test_catalog(spark, folder):
    at, _, _ = folder
    rows = catalog.file_catalog(spark, [f"{at}/*.sgy", f"{at}/flat.sgy", f"{at}/none*.sgy"]).collect()
    assert sum(r.status == "found" for r in rows) == 6 and [r.path for r in rows if r.status == "missing"] == [f"{at}/none*.sgy"]
    assert catalog.list_sections(spark, f"{at}/absent").count() == 0
    names = catalog.artifact_names(spark.createDataFrame([("x/a.b.sgy",), ("y/a.b.sgy",), ("z/.hidden",)], "path string")).collect()
    assert [r.stem for r in names] == ["a.b", "a.b", ".hidden"] and len({r.unique_stem for r in names}) == 3
