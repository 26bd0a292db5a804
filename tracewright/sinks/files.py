"""One file of each kind per section: overlay images, mask archives, label volumes, SEG-Y.

A file is made of pieces of at most ``most_pixels`` pixels (at least one trace, or one
row of samples), which tasks make and compress apart, and which one task puts one after
the other as they come, holding no more than a few of them.  So a section of any size has
one file of each kind.

Files are written in a transaction (``ArtifactWriter``): tasks write under the job's own
folder, and only when all have ended are files moved to their places and listed in the
job's manifest.  A job that fails leaves no file.  A section that fails is a row with its
error and doesn't stop the others.  The manifest is a table of files; looking at it
again writes nothing.  The folder must be mounted on every machine.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .. import schemas
from ..catalog import LABELS
from ..operators.normalize import section_shape
from ..sources.segy import BINARY_HEADER, EXTENDED_AT, FORMAT_AT, IBM, IEEE, INLINE_AT, SAMPLES_AT, TEXT_HEADER, TRACE_HEADER, XLINE_AT, encode_ibm
from ..storage import mounted, shared_dir
from . import formats

MOST_PIXELS = 1 << 20
PIECES = (
    "section_id string, path string, artifact string, part_no int, part string, seq long, n_traces int, n_samples int, "
    "data binary, size long, crc long, adler long, error string"
)


# --- putting pieces together


class _Png:
    def __init__(self, out, row: dict, _: dict):
        self.out, self.adler = out, 1
        out.write(formats.png_head(row["n_traces"], row["n_samples"]))

    def add(self, row: dict) -> None:
        self.out.write(formats.png_band(formats.Band(row["data"], row["size"], row["crc"], row["adler"])))
        self.adler = formats.joined_adler(self.adler, row["adler"], row["size"])

    def end(self) -> None:
        self.out.write(formats.png_tail(self.adler))


class _Npz:
    def __init__(self, out, row: dict, _: dict):
        self.out, self.members, self.part = out, [], None

    def add(self, row: dict) -> None:
        if row["part"] != self.part:
            self._close()
            self.part, self.at, self.crc, self.size = row["part"], self.out.tell(), 0, 0
            self.out.write(formats.zip_member_head(f"{self.part}.npy"))
            self.begun = self.out.tell()
            self._take(formats.band_of(formats.npy_head(np.dtype(bool), (row["n_traces"], row["n_samples"]))))
        self._take(formats.Band(row["data"], row["size"], row["crc"], row["adler"]))

    def _take(self, band: formats.Band) -> None:
        self.out.write(band.data)
        self.crc, self.size = formats.joined_crc(self.crc, band.crc, band.size), self.size + band.size

    def _close(self) -> None:
        if self.part is not None:
            stored = self.out.tell() - self.begun + len(formats.LAST_BLOCK)
            self.out.write(formats.zip_member_tail(self.crc, stored, self.size))
            self.members.append(formats.Member(f"{self.part}.npy", self.at, stored, self.size, self.crc))

    def end(self) -> None:
        self._close()
        self.out.write(formats.zip_directory(self.members, self.out.tell()))


class _Vti:
    def __init__(self, out, row: dict, options: dict):
        self.out = out
        spacing = float(options.get("trace_spacing", 25.0)), float(options.get("sample_interval", 4.0))
        out.write(formats.vti_head((row["n_traces"], row["n_samples"]), spacing, 4 * row["n_traces"] * row["n_samples"]))

    def add(self, row: dict) -> None:
        self.out.write(row["data"])

    def end(self) -> None:
        self.out.write(formats.VTI_TAIL)


class _Segy:
    def __init__(self, out, row: dict, options: dict):
        self.out = out
        out.write(segy_head(row["n_samples"], int(options.get("segy_format", IEEE))))

    def add(self, row: dict) -> None:
        self.out.write(row["data"])

    def end(self) -> None: ...


ASSEMBLIES = {"overlay_png": _Png, "masks_npz": _Npz, "labels_vti": _Vti, "segy": _Segy}


class _File:
    """One artifact in the making, under a name of the job."""

    def __init__(self, folder: str, row: dict, options: dict):
        self.made = {"section_id": row["section_id"], "path": row["path"], "artifact": row["artifact"], "status": "written", "error": None, "n_bytes": None, "temp": f"{folder}/{uuid.uuid4().hex}"}
        self.last, self.out = (None, 0), None
        try:
            os.makedirs(folder, exist_ok=True)
            self.out = open(self.made["temp"], "wb")
            self.kind = ASSEMBLIES[row["artifact"]](self.out, row, options)
        except Exception as error:  # noqa: BLE001  one artifact's failure is a row
            self._fail(f"{type(error).__name__}: {error}")

    def _fail(self, error: str) -> None:
        if self.made["status"] == "written":
            self.made |= {"status": "failed", "error": error}

    def add(self, row: dict) -> None:
        if row["error"] is not None:
            self._fail(row["error"])
        if self.made["status"] != "written":
            return
        try:
            if row["seq"] != (self.last[1] + 1 if self.last[0] == row["part_no"] else 0):
                raise ValueError(f"traces are missing before piece {row['seq']}")
            self.last = row["part_no"], row["seq"]
            self.kind.add(row)
        except Exception as error:  # noqa: BLE001
            self._fail(f"{type(error).__name__}: {error}")

    def close(self) -> dict:
        try:
            if self.made["status"] == "written":
                self.kind.end()
                self.made["n_bytes"] = self.out.tell()
        except Exception as error:  # noqa: BLE001
            self._fail(f"{type(error).__name__}: {error}")
        if self.out:
            self.out.close()
            if self.made["status"] != "written":
                os.remove(self.made["temp"])
        return self.made


# --- the transaction


@dataclass
class Written(WriterCommitMessage):
    """Where a task listed the files it made."""

    listing: str = field(default="")


class ArtifactWriter(DataSourceArrowWriter):
    """Pieces of files, sorted by path within each task, become files.

    A task's files and its list of them lie in the job's folder until the job commits, so a
    task that is run twice, or a job that is stopped, leaves nothing in the place of files.
    The driver sees the name of one list for each task."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.folder, self.job = options["folder"], options["job"]

    @property
    def temp(self) -> str:
        return f"{self.folder}/.job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        made: list[dict] = []
        current = None
        for batch in iterator:
            for i in range(len(batch)):  # one piece at a time is taken out of the batch
                row = batch.slice(i, 1).to_pylist()[0]
                if current is None or row["path"] != current.made["path"]:
                    if current:
                        made.append(current.close())
                    current = _File(self.temp, row, self.options)
                current.add(row)
        if current:
            made.append(current.close())
        if not made:
            return Written()
        if all(m["status"] == "failed" for m in made) and not os.path.isdir(self.temp):
            return Written("".join(json.dumps(m) + "\n" for m in made))  # nowhere to write at all
        listing = f"{self.temp}/{uuid.uuid4().hex}.list"
        with open(listing, "w") as f:
            f.writelines(json.dumps(m) + "\n" for m in made)
        return Written(f"@{listing}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        manifest = self.options["manifest"]
        os.makedirs(manifest, exist_ok=True)
        for n, message in enumerate(m for m in messages if m and m.listing):
            with open(f"{manifest}/part-{n:06d}.json", "w") as out:
                for line in open(message.listing[1:]) if message.listing.startswith("@") else message.listing.splitlines():
                    made = json.loads(line)
                    if made["status"] == "written":
                        os.replace(made["temp"], made["path"])
                    del made["temp"]
                    out.write(json.dumps(made) + "\n")
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.temp, ignore_errors=True)


class ArtifactSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracewright_artifacts"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options)


def write_pieces(spark: SparkSession, pieces: DataFrame, folder: str, **options) -> DataFrame:
    """Write the files that ``pieces`` are of, and give the manifest: ``section_id, path, artifact,
    status, error, n_bytes``."""
    folder, job = mounted(folder), uuid.uuid4().hex
    manifest = f"{mounted(shared_dir(spark)).rstrip('/')}/manifest-{job}"
    spark.dataSource.register(ArtifactSink)
    dealt = pieces.repartition("path").sortWithinPartitions("path", "part_no", "seq")
    dealt.write.format(ArtifactSink.name()).mode("append").options(folder=folder, job=job, manifest=manifest, **options).save()
    return spark.read.schema(schemas.MANIFEST).json(manifest)


# --- making pieces


def _pieces(rows: DataFrame, place: dict[str, Column], artifact: str, folder: str, ending: str, make: Callable[[pd.DataFrame, dict], bytes], compress: bool) -> DataFrame:
    """Rows grouped into pieces; ``place`` says which one, and the shape of the section."""
    keys = ["section_id", "part_no", "part", "seq", "n_traces", "n_samples"]

    def piece(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at = dict(zip(keys, key, strict=True))
        band, error = formats.Band(b"", 0, 0, 1), None
        try:
            raw = make(frame, at)
            band = formats.band_of(raw) if compress else formats.Band(raw, len(raw), 0, 1)
        except Exception as failure:  # noqa: BLE001  one section's failure is a row
            error = f"{type(failure).__name__}: {failure}"
        path = f"{folder}/{_stem(at['section_id'])}{ending}"
        row = (at["section_id"], path, artifact, at["part_no"], at["part"], at["seq"], at["n_traces"], at["n_samples"], band.data, band.size, band.crc, band.adler, error)
        return pd.DataFrame([row], columns=[c.split()[0] for c in PIECES.split(", ")])

    return rows.withColumns(place).groupBy(*keys).applyInPandas(piece, PIECES)


def _shaped(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    shapes = shapes.select(F.col("section_id").alias("_of"), "n_traces", "n_samples")
    return rows.join(F.broadcast(shapes), F.col("section_id") == F.col("_of")).drop("_of")


def _by_traces(most: int, part_no: Column | None = None, part: Column | None = None) -> dict[str, Column]:
    per = F.greatest(F.floor(F.lit(most) / F.greatest("n_samples", F.lit(1))), F.lit(1))
    return {
        "part_no": F.lit(0) if part_no is None else part_no, "part": F.lit("") if part is None else part,
        "per": per.cast("int"), "seq": F.floor(F.col("trace_idx") / per).cast("long"),
    }


def _filled(frame: pd.DataFrame, at: dict, columns: list[str], kind: type) -> np.ndarray:
    """Traces of a piece as one array, by their place; every trace must be there, none twice."""
    per = int(frame["per"].iloc[0])
    first = at["seq"] * per
    n = min(per, at["n_traces"] - first)
    order = frame["trace_idx"].to_numpy() - first
    if sorted(order.tolist()) != list(range(n)):
        raise ValueError(f"not every trace from {first} to {first + n - 1} is there once")
    out = np.zeros((n, at["n_samples"], len(columns)), kind)
    for k, c in enumerate(columns):
        for i, values in zip(order.tolist(), frame[c], strict=True):
            out[i, : len(values), k] = values
    return out if len(columns) > 1 else out[:, :, 0]


def _stem(section_id: str) -> str:
    name = section_id.rstrip("/").rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return f"{stem}-{zlib.crc32(section_id.encode()):08x}"


def npz_pieces(masks: DataFrame, folder: str, most_pixels: int = MOST_PIXELS, shapes: DataFrame | None = None) -> DataFrame:
    """A boolean array per label; a label outside the catalog has its number as name."""
    names = {i: n.replace(" ", "_") for i, n, *_ in LABELS}
    part = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in names.items() for x in item]), F.col("label_id")), F.concat(F.lit("label_"), F.col("label_id").cast("string")))
    rows = _shaped(masks, section_shape(masks, "mask") if shapes is None else shapes)
    return _pieces(rows, _by_traces(most_pixels, F.col("label_id"), part), "masks_npz", mounted(folder), "_masks.npz", lambda frame, at: _filled(frame, at, ["mask"], bool).tobytes(), True)


def png_pieces(overlay: DataFrame, folder: str, most_pixels: int = MOST_PIXELS, shapes: DataFrame | None = None) -> DataFrame:
    """An image from ``section_id, trace_idx, r, g, b``, arrays per trace."""
    rows = _shaped(overlay, section_shape(overlay, "r") if shapes is None else shapes)
    return _pieces(rows, _by_traces(most_pixels), "overlay_png", mounted(folder), "_overlay.png", lambda frame, at: formats.png_rows(_filled(frame, at, ["r", "g", "b"], np.uint8)), True)


RUNS = "section_id string, n_traces int, n_samples int, tall int, wide int, k int, first int, n int, ids binary, error string"


def _runs(rows: DataFrame) -> DataFrame:
    """Label volumes turned about, block by block of ``per`` traces: for each ``wide`` samples of a
    block a row with their labels, the traces running fastest.

    A block with a trace missing, or there twice, is one row with the error."""
    keys = ["section_id", "n_traces", "n_samples", "per", "tall", "wide", "block"]
    names = [c.split()[0] for c in RUNS.split(", ")]

    def turn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        section, n_traces, n_samples, per, tall, wide, block = key
        head = (section, n_traces, n_samples, tall, wide)
        try:
            at = {"seq": int(block), "n_traces": n_traces, "n_samples": n_samples}
            ids = np.ascontiguousarray(_filled(frame, at, ["label_ids"], "<i4").T)
            chunks = [ids[x : x + wide].tobytes() for x in range(0, n_samples, wide)]
            rows = [(*head, k, int(block) * per, ids.shape[1], chunk, None) for k, chunk in enumerate(chunks)]
        except Exception as failure:  # noqa: BLE001  one section's failure is a row
            rows = [(*head, 0, 0, 0, b"", str(failure))]
        return pd.DataFrame(rows, columns=names)

    return rows.withColumn("block", F.floor(F.col("trace_idx") / F.col("per")).cast("long")).select(*keys, "trace_idx", "label_ids").groupBy(*keys).applyInPandas(turn, RUNS)


def vti_pieces(volume: DataFrame, folder: str, most_pixels: int = MOST_PIXELS, shapes: DataFrame | None = None) -> DataFrame:
    """A label volume from ``section_id, trace_idx, label_ids``.

    Its traces are the axis that runs fastest, so a piece is a range of samples of all
    traces, or of one sample and a range of traces where there are more than a piece holds.
    It is put together from runs of blocks of traces; no row is made for a trace and piece."""
    rows = _shaped(volume, section_shape(volume, "label_ids") if shapes is None else shapes).where("n_samples > 0")
    per = F.greatest(F.floor(F.lit(most_pixels) / F.col("n_samples")), F.lit(1)).cast("int")
    rows = rows.withColumns({"per": per, "wide": F.greatest(F.floor(F.lit(most_pixels) / F.greatest("n_traces", F.lit(1))), F.lit(1)).cast("int")})
    rows = rows.withColumn("tall", F.least("n_traces", F.col("per") * F.floor(F.lit(most_pixels) / F.col("per"))).cast("int"))  # whole blocks
    seq = F.col("k") * F.ceil(F.col("n_traces") / F.col("tall")) + F.floor(F.col("first") / F.col("tall"))
    place = {"part_no": F.lit(0), "part": F.lit(""), "seq": seq.cast("long")}

    def make(frame: pd.DataFrame, at: dict) -> bytes:
        k, tall, wide = (int(frame[c].iloc[0]) for c in ("k", "tall", "wide"))
        if (lost := frame["error"].dropna()).size:
            raise ValueError(lost.iloc[0])
        first = at["seq"] % -(-at["n_traces"] // tall) * tall
        n, done = min(tall, at["n_traces"] - first), 0
        out = np.zeros((min(wide, at["n_samples"] - k * wide), n), "<i4")
        for begin, size, ids in sorted(zip(frame["first"].tolist(), frame["n"].tolist(), frame["ids"], strict=True)):
            if begin != first + done:
                break
            out[:, done : done + size] = np.frombuffer(ids, "<i4").reshape(len(out), size)
            done += size
        if done != n:
            raise ValueError(f"not every trace from {first} to {first + n - 1} is there once")
        return out.tobytes()

    return _pieces(_runs(rows), place, "labels_vti", mounted(folder), "_masks.vti", make, False)


def segy_pieces(traces: DataFrame, folder: str, kind: int = IEEE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """SEG-Y traces; ``inline_no`` and ``xline_no`` go to the headers if there."""

    def make(frame: pd.DataFrame, at: dict) -> bytes:
        if at["n_samples"] > 0xFFFF:
            raise ValueError("a trace of this format has at most 65535 samples")
        samples = _filled(frame, at, ["samples"], np.float32)
        order = np.argsort(frame["trace_idx"].to_numpy())
        return segy_traces(samples, kind, *(frame[c].to_numpy()[order] if c in frame else None for c in ("inline_no", "xline_no")))

    return _pieces(_shaped(traces, section_shape(traces)), _by_traces(most_pixels), "segy", mounted(folder), ".sgy", make, False)


# --- exports


def export_npz(masks: DataFrame, folder: str, most_pixels: int = MOST_PIXELS, shapes: DataFrame | None = None) -> DataFrame:
    """A compressed archive per section with a boolean array per label; its manifest."""
    return write_pieces(masks.sparkSession, npz_pieces(masks, folder, most_pixels, shapes), folder)


def export_png(overlay: DataFrame, folder: str, most_pixels: int = MOST_PIXELS, shapes: DataFrame | None = None) -> DataFrame:
    """An image per section; its manifest."""
    return write_pieces(overlay.sparkSession, png_pieces(overlay, folder, most_pixels, shapes), folder)


def export_vti(volume: DataFrame, folder: str, trace_spacing: float = 25.0, sample_interval: float = 4.0, most_pixels: int = MOST_PIXELS, shapes: DataFrame | None = None) -> DataFrame:
    """A label volume per section; its manifest."""
    return write_pieces(volume.sparkSession, vti_pieces(volume, folder, most_pixels, shapes), folder, trace_spacing=trace_spacing, sample_interval=sample_interval)


def export_segy(traces: DataFrame, folder: str, kind: int = IEEE, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A SEG-Y file per section; its manifest."""
    return write_pieces(traces.sparkSession, segy_pieces(traces, folder, kind, most_pixels), folder, segy_format=kind)


def export_together(spark: SparkSession, pieces: list[DataFrame], folder: str, **options) -> DataFrame:
    """Files of several kinds in one transaction; their manifest."""
    return write_pieces(spark, reduce(DataFrame.unionByName, pieces), folder, **options)


def segy_head(width: int, kind: int = IEEE) -> bytes:
    head = np.zeros(TEXT_HEADER + BINARY_HEADER, np.uint8)
    for at, value in ((SAMPLES_AT, width), (FORMAT_AT, kind), (EXTENDED_AT, 0)):
        head[at : at + 2] = np.frombuffer(struct.pack(">H", value), np.uint8)
    return head.tobytes()


def segy_traces(samples: np.ndarray, kind: int = IEEE, inlines: np.ndarray | None = None, xlines: np.ndarray | None = None) -> bytes:
    n, width = samples.shape
    words = encode_ibm(samples) if kind == IBM else np.asarray(samples, np.float32).view(np.uint32)
    body = np.zeros((n, TRACE_HEADER + 4 * width), np.uint8)
    body[:, TRACE_HEADER:] = words.astype(">u4").view(np.uint8).reshape(n, 4 * width)
    for at, values in ((INLINE_AT, inlines), (XLINE_AT, xlines)):
        if values is not None:
            body[:, at : at + 4] = np.asarray(values).astype(">i4").view(np.uint8).reshape(n, 4)
    return body.tobytes()


def segy_bytes(samples: np.ndarray, kind: int = IEEE, inlines: np.ndarray | None = None, xlines: np.ndarray | None = None) -> bytes:
    """A SEG-Y file of traces with one length."""
    return segy_head(samples.shape[1], kind) + segy_traces(samples, kind, inlines, xlines)
