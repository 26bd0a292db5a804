"""SEG-Y files as a Spark data source: ``spark.read.format("segy").load(pattern)``.

Traces have a fixed length, so a file is cut into ranges of traces from its headers
alone, and a task seeks to its range and decodes it whole.  Options: ``path`` (patterns
separated by commas) or ``paths`` (a JSON list, for paths with commas), ``geometry`` (``2d``: traces in file order; ``3d``: inline and
crossline numbers from the trace headers), ``traces_per_partition``, ``index`` (a folder that
``index_segy`` wrote) and ``tile``, ``stride`` and ``bands_per_partition`` (see ``read_bands``).

Filters on ``trace_idx`` choose the traces that are read.  With an index so do those on
``inline_no`` and ``xline_no``: it holds the runs of traces of each inline, and only runs that
meet the filters are opened.

A file that can't be read gives one row with its ``status`` and no trace: ``missing``,
``truncated``, ``unsupported`` or ``empty``; other files are read.
"""

from __future__ import annotations

import glob as globs
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import schemas

# Fixed values of the format (revision 1): sizes and byte offsets, big-endian.
TEXT_HEADER, BINARY_HEADER, TRACE_HEADER = 3200, 400, 240
SAMPLES_AT, FORMAT_AT, EXTENDED_AT = 3220, 3224, 3504
INLINE_AT, XLINE_AT = 188, 192
IBM, IEEE = 1, 5


def decode_ibm(words: np.ndarray) -> np.ndarray:
    """IBM single floats (sign, base-16 exponent, 24-bit fraction) as 32-bit floats."""
    fraction = (words & 0x00FFFFFF).astype(np.float64) / (1 << 24)
    exponent = ((words >> 24) & 0x7F).astype(np.int32) - 64
    sign = np.where(words >> 31, -1.0, 1.0)
    with np.errstate(over="ignore"):
        return (sign * np.ldexp(fraction, 4 * exponent)).astype(np.float32)


def encode_ibm(values: np.ndarray) -> np.ndarray:
    """The nearest IBM single floats below in magnitude; NaN and infinities can't be written."""
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        raise ValueError("IBM floats have no NaN or infinity")
    _, two = np.frexp(np.abs(v))
    exponent = -(-two // 4)
    fraction = (np.ldexp(np.abs(v), -4 * exponent) * (1 << 24)).astype(np.uint32)
    words = np.where(v < 0, np.uint32(1 << 31), np.uint32(0)) | ((exponent + 64).astype(np.uint32) << 24) | fraction
    return np.where(v == 0, 0, words).astype(np.uint32)


def _open(path: str):
    """A file object over a mounted path, or over any store that Arrow reaches."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return store.open_input_file(inner)


@dataclass
class Layout:
    n_samples: int
    format: int
    start: int
    n_traces: int
    status: str


def layout_of(path: str) -> Layout:
    try:
        with _open(path) as f:
            head = f.read(TEXT_HEADER + BINARY_HEADER)
            f.seek(0, 2)
            size = f.tell()
    except OSError:
        return Layout(0, 0, 0, 0, "missing")
    if len(head) < TEXT_HEADER + BINARY_HEADER:
        return Layout(0, 0, 0, 0, "truncated")
    number = lambda at: int(np.frombuffer(head, ">i2", 1, at)[0])
    n, kind, start = number(SAMPLES_AT) & 0xFFFF, number(FORMAT_AT), TEXT_HEADER * (1 + max(0, number(EXTENDED_AT))) + BINARY_HEADER
    if kind not in (IBM, IEEE):
        return Layout(n, kind, start, 0, "unsupported")
    traces, rest = divmod(size - start, TRACE_HEADER + 4 * n)
    return Layout(n, kind, start, traces, "truncated" if rest or size < start else "ok" if traces else "empty")


@dataclass
class Range(InputPartition):
    """Traces ``first`` to ``first + count - 1`` of a file; ``bands`` are the starts of bands among them,
    ``runs`` the first traces and ends of the runs that are read where not all are."""

    path: str
    first: int
    count: int
    layout: Layout
    bands: tuple[int, ...] = ()
    runs: tuple[tuple[int, int], ...] = ()

    def __init__(self, path: str, first: int, count: int, layout: Layout, bands: tuple[int, ...] = (), runs: tuple[tuple[int, int], ...] = ()):
        self.path, self.first, self.count, self.layout, self.bands, self.runs = path, first, count, layout, bands, runs


class Asked:
    """What the pushed filters leave of a number: the least, the greatest and the listed values."""

    def __init__(self):
        self.low, self.high, self.listed = -(1 << 62), 1 << 62, None

    def take(self, f: Filter) -> None:
        if isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            values = {v for v in values if v is not None}
            self.listed = values if self.listed is None else self.listed & values
            self.low, self.high = max(self.low, min(self.listed, default=1)), min(self.high, max(self.listed, default=0))
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.high = min(self.high, f.value - isinstance(f, LessThan))

    @property
    def anything(self) -> bool:
        return self.listed is None and self.low == -(1 << 62) and self.high == 1 << 62


def _expand(patterns: list[str]) -> list[str]:
    """Paths that the patterns name, in order, each once; a pattern that names none stands for itself.

    On a remote store the last part of a path may be a pattern."""
    found: dict[str, None] = {}
    for pattern in filter(None, (p.strip() for p in patterns)):
        bare = "/" + pattern.removeprefix("file:").lstrip("/") if pattern.startswith("file:") else pattern
        for path in (_listed(bare) if "://" in bare else sorted(globs.glob(bare))) or [bare]:
            found[path] = None
    return list(found)


def _listed(pattern: str) -> list[str]:
    from fnmatch import fnmatchcase

    from pyarrow import fs

    folder, name = pattern.rsplit("/", 1)
    if not globs.has_magic(name):
        return [pattern]
    store, inner = fs.FileSystem.from_uri(folder)
    every = store.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(f"{folder}/{x.base_name}" for x in every if x.is_file and fnmatchcase(x.base_name, name))


class SegyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _expand(json.loads(options["paths"]) if "paths" in options else options.get("path", "").split(","))
        self.three_d = str(options.get("geometry", "2d")).lower() == "3d"
        self.per_partition = int(options.get("traces_per_partition", 4096))
        self.index = options.get("index")
        self.tile, self.stride = int(options.get("tile", 0)), int(options.get("stride", 0))
        self.bands_per_partition = int(options.get("bands_per_partition", 4))
        self.asked = {c: Asked() for c in ("trace_idx", "inline_no", "xline_no")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files are chosen by path before any is opened, and traces by their numbers; Spark
        looks at the numbers of what was read again."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column == "path" or isinstance(f, EqualTo) and column == "section_id" and not self.three_d:
                self.paths = [p for p in self.paths if p == f.value]
                continue
            if column in self.asked and not self.tile:
                self.asked[column].take(f)
            yield f

    def partitions(self) -> list[Range]:
        out, runs = [], self._indexed()
        for path in self.paths:
            at = layout_of(path)
            if at.status != "ok":
                out.append(Range(path, 0, 0, at))
            elif self.tile:
                starts = window_starts(at.n_traces, self.tile, self.stride)
                for k in range(0, len(starts), self.bands_per_partition):
                    some = tuple(starts[k : k + self.bands_per_partition])
                    out.append(Range(path, some[0], min(some[-1] + self.tile, at.n_traces) - some[0], at, some))
            else:
                trace = self.asked["trace_idx"]
                whole = [] if (path, at.n_traces) in self.known else [(0, at.n_traces)]
                pieces = ((max(first, trace.low), min(end, trace.high + 1)) for first, end in runs.get((path, at.n_traces), whole))
                held, n = [], 0
                for first, end in pieces:
                    while first < end:  # short runs share a partition, long ones have several
                        upto = min(end, first + self.per_partition - n)
                        held.append((first, upto))
                        n, first = n + upto - first, upto
                        if n == self.per_partition:
                            out.append(self._range(path, held, at))
                            held, n = [], 0
                if held:
                    out.append(self._range(path, held, at))
        return out or [Range("", 0, 0, Layout(0, 0, 0, 0, "none"))]

    @staticmethod
    def _range(path: str, runs: list[tuple[int, int]], at: Layout) -> Range:
        return Range(path, runs[0][0], sum(end - first for first, end in runs), at, runs=tuple(runs) if len(runs) > 1 else ())

    def _indexed(self) -> dict[tuple[str, int], list[tuple[int, int]]]:
        """The runs of traces that meet the filters, by file and its number of traces, those
        that follow one another as one.  A file that has changed since isn't in the index."""
        self.known: set[tuple[str, int]] = set()
        inline, xline = self.asked["inline_no"], self.asked["xline_no"]
        if not (self.index and self.three_d) or inline.anything and xline.anything:
            return {}
        import pyarrow.dataset as ds

        files = ds.dataset(f"{self.index}/files", format="parquet").to_table()
        stamp = {p: (n, m) for p, n, m in zip(*(files.column(c).to_pylist() for c in ("path", "n_traces", "modified")), strict=True)}
        self.known = {(p, n) for p in self.paths if p in stamp and (n := stamp[p][0]) is not None and stamp[p][1] == _modified(p)}
        # least and greatest numbers of each block of the index are in its footer
        wanted = (ds.field("inline_no") >= inline.low) & (ds.field("inline_no") <= inline.high) & (ds.field("xline_max") >= xline.low) & (ds.field("xline_min") <= xline.high)
        if inline.listed is not None:
            wanted &= ds.field("inline_no").isin(sorted(inline.listed))
        if xline.listed is not None and not xline.listed:
            return {}
        found = ds.dataset(f"{self.index}/runs", format="parquet").to_table(columns=["path", "n_traces", "first", "count"], filter=wanted).to_pydict()
        out: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for path, n, first, count in sorted(zip(*found.values(), strict=True)):
            runs = out.setdefault((path, n), [])
            if runs and runs[-1][1] == first:
                runs[-1] = (runs[-1][0], first + count)
            else:
                runs.append((first, first + count))
        return {k: v for k, v in out.items() if k in self.known}

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        at = partition.layout
        if at.status == "none":
            return
        if at.status != "ok":
            extra = [[None], [None], [None]] if self.tile else []
            yield self._batch([partition.path], [partition.path], [None], [None], [None], [None], [at.status], *extra)
            return
        size = TRACE_HEADER + 4 * at.n_samples
        runs = partition.runs or ((partition.first, partition.first + partition.count),)
        raw = np.empty((partition.count, size), np.uint8)
        with _open(partition.path) as f:
            done = 0
            for first, end in runs:
                f.seek(at.start + first * size)
                raw[done : done + end - first] = np.frombuffer(f.read((end - first) * size), np.uint8).reshape(-1, size)
                done += end - first
        words = np.ascontiguousarray(raw[:, TRACE_HEADER:]).view(">u4").astype(np.uint32)
        samples = decode_ibm(words) if at.format == IBM else words.view(np.float32)
        if self.tile:
            for y in partition.bands:
                band = samples[y - partition.first : y - partition.first + self.tile]
                n, path = len(band), [partition.path] * len(band)
                yield self._batch(path, path, [None] * n, [None] * n, np.arange(y, y + n, dtype=np.int32), list(band), ["ok"] * n, [y] * n, [at.n_traces] * n, [at.n_samples] * n)
            return
        inline = xline = [None] * partition.count
        section = [partition.path] * partition.count
        order = np.concatenate([np.arange(first, end, dtype=np.int32) for first, end in runs])
        if self.three_d:
            inline, xline = (_numbers(raw, a).tolist() for a in (INLINE_AT, XLINE_AT))
            section = [f"{partition.path}#{i}" for i in inline]
        yield self._batch(section, [partition.path] * partition.count, inline, xline, order, list(samples), ["ok"] * partition.count)

    @staticmethod
    def _batch(*columns) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds[: len(columns)], strict=True)], names=schemas.SEGY_BANDS.names[: len(columns)])


class SegySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self):
        return schemas.SEGY_BANDS if "tile" in self.options else schemas.SEGY_TRACES

    def reader(self, schema) -> SegyReader:
        return SegyReader(self.options)


def _numbers(raw: np.ndarray, at: int) -> np.ndarray:
    """A number of the trace headers."""
    return np.ascontiguousarray(raw[:, at : at + 4]).view(">i4")[:, 0].astype(np.int32)


def window_starts(n: int, tile: int, stride: int) -> list[int]:
    """Where windows over ``n`` traces begin: every ``stride``, and one that ends with the last."""
    if n <= tile:
        return [0]
    return sorted({*range(0, n - tile + 1, stride), n - tile})


def window_starts_between(n: int, tile: int, stride: int, low: int, high: int) -> list[int]:
    """Those of ``window_starts`` from ``low`` to ``high``, without listing the others."""
    edge = max(0, n - tile)
    regular = range(max(0, -(-low // stride)) * stride, min(high, edge) + 1, stride)
    return sorted({*regular, *([edge] if low <= edge <= high else [])})


def _modified(path: str) -> int:
    """When a file was changed, in nanoseconds; -1 where its store doesn't tell."""
    try:
        if "://" not in path and not path.startswith("file:"):
            return os.stat(path).st_mtime_ns
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return store.get_file_info(inner).mtime_ns or -1
    except OSError:
        return -1


def _loaded(spark: SparkSession, patterns: tuple[str, ...], options: dict) -> DataFrame:
    """Readers that choose by filters need a setting of the session, which is looked at when a
    plan is made, so it stays on."""
    key = "spark.sql.python.filterPushdown.enabled"
    spark.dataSource.register(SegySource)
    if str(spark.conf.get(key, "false")).lower() != "true":
        spark.conf.set(key, "true")
    return spark.read.format("segy").options(paths=json.dumps(patterns), **options).load()


def read_segy(spark: SparkSession, *patterns: str, **options) -> DataFrame:
    """All rows of the files, those with a status other than ``ok`` among them."""
    return _loaded(spark, patterns, options)


def read_bands(spark: SparkSession, *patterns: str, tile: int, stride: int, bands_per_partition: int = 4) -> DataFrame:
    """The traces of each band of tiles, band after band: rows of ``read_segy`` with ``tile_y``,
    ``n_traces`` and ``n_samples``.

    A partition reads its bands' traces once, those that it shares with the next partition
    among them, so that what needs whole bands needs no shuffle."""
    if tile <= 0 or stride <= 0:
        raise ValueError("tile and stride must be positive")
    return _loaded(spark, patterns, {"tile": tile, "stride": stride, "bands_per_partition": bands_per_partition})


def index_segy(spark: SparkSession, folder: str, *patterns: str, traces_per_partition: int = 1 << 16) -> None:
    """Write the header index of cubes into a shared folder, for the option ``index``.

    ``runs`` has a row for each run of traces of one inline that follow one another in a
    file: where it begins, how many they are, and the least and greatest crossline.
    ``files`` says how each file was found; one that has changed is read whole again."""
    files = [(p, at.n_traces, _modified(p), at) for p in _expand(list(patterns)) if (at := layout_of(p)).status == "ok"]
    ranges = [(p, n, first, min(traces_per_partition, n - first), at.start, at.n_samples) for p, n, _, at in files for first in range(0, n, traces_per_partition)]
    spark.createDataFrame([(p, n, m) for p, n, m, _ in files], "path string, n_traces long, modified long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as f:
                    found = list(_header_numbers(f, r["start"], r["n_samples"], r["begin"], r["traces"]))
                inline, xline = (np.concatenate(x) for x in zip(*found, strict=True))
                starts = np.flatnonzero(np.diff(inline, prepend=inline[0] - 1))
                n = len(starts)
                columns = [
                    pa.array([r["path"]] * n), pa.array([r["n_traces"]] * n, pa.int64()), pa.array(starts + r["begin"]), pa.array(np.diff(np.append(starts, len(inline)))),
                    pa.array(inline[starts]), pa.array(np.minimum.reduceat(xline, starts)), pa.array(np.maximum.reduceat(xline, starts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "n_traces", "first", "count", "inline_no", "xline_min", "xline_max"])

    asked = spark.createDataFrame(ranges, "path string, n_traces long, begin long, traces long, start long, n_samples long")
    runs = asked.repartition(max(1, len(ranges)), "path", "begin").mapInArrow(headers, "path string, n_traces long, first long, count long, inline_no int, xline_min int, xline_max int")
    runs.repartitionByRange("inline_no").sortWithinPartitions("inline_no", "path", "first").write.mode("overwrite").parquet(f"{folder}/runs")


def _header_numbers(f, start: int, n_samples: int, first: int, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inline and crossline numbers of traces; of long traces only the headers are read."""
    size = TRACE_HEADER + 4 * n_samples
    per = max(1, (4 << 20) // size)
    for at in range(first, first + count, per):
        n = min(per, first + count - at)
        if size > 1 << 16:
            parts = []
            for i in range(at, at + n):
                f.seek(start + i * size)
                parts.append(f.read(TRACE_HEADER))
            raw = np.frombuffer(b"".join(parts), np.uint8).reshape(n, TRACE_HEADER)
        else:
            f.seek(start + at * size)
            raw = np.frombuffer(f.read(n * size), np.uint8).reshape(n, size)
        yield _numbers(raw, INLINE_AT), _numbers(raw, XLINE_AT)


def inline_slices(volume: DataFrame, order_col: str = "xline_no") -> DataFrame:
    """Traces of a volume numbered within their inline: ``trace_idx`` counts by crossline.

    An inline is a section of its own, so the window never spans more than one."""
    inside = Window.partitionBy("section_id", "inline_no").orderBy(order_col)
    return volume.withColumn("trace_idx", F.row_number().over(inside) - 1)
