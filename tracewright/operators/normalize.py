"""From amplitudes to grey levels, section by section.

Tables of a row per section (bounds, shapes) are broadcast by name: Spark goes by the
compressed size of files and may send the traces to the driver instead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import gray_level
from ..sources.bounds import from_ordered_bits, ordered_bits

SLICE = 1 << 18  # values that are worked on at a time
FEW = 1 << 13  # values that are sorted sooner than counted


def samples_long(traces: DataFrame) -> DataFrame:
    """One row per sample: ``section_id, trace_idx, sample_idx, amplitude``."""
    typed = traces.select("section_id", "trace_idx", F.col("samples").cast("array<float>").alias("samples"))
    return typed.select("section_id", "trace_idx", F.posexplode("samples").alias("sample_idx", "amplitude"))


def section_shape(traces: DataFrame, samples_col: str = "samples") -> DataFrame:
    """``section_id, n_traces, n_samples``."""
    return traces.groupBy("section_id").agg(
        (F.max("trace_idx") + 1).cast("int").alias("n_traces"), F.max(F.size(samples_col)).cast("int").alias("n_samples")
    )


def _amplitudes(samples: DataFrame) -> DataFrame:
    v = F.col("amplitude").cast("double")
    return samples.where(v.isNotNull() & ~F.isnan(v)).select("section_id", v.alias("v"))


def clip_bounds_in_buffer(samples: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """The bounds of ``clip_bounds`` for small sections: a count per distinct value of a section is
    kept in one buffer of one task."""
    p = F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100)))
    found = _amplitudes(samples).groupBy("section_id").agg(p.alias("p"))
    return found.select("section_id", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def clip_bounds(samples: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """``section_id, lo, hi``: two interpolated percentiles of a section's samples.

    NaN doesn't count.  No task holds the values of a section: see ``clip_bounds_two_pass``."""
    return clip_bounds_two_pass(samples, low, high)


def clip_bounds_two_pass(samples: DataFrame, low: float = 2.0, high: float = 98.0, slack: float = 0.001) -> DataFrame:
    """The same bounds for sections of any size, exactly.

    The first pass brackets each percentile by approximate ones whose rank error is
    a tenth of ``slack``, so the wanted ranks lie between them; sections too small for
    that are bracketed by their least and greatest value.  The second counts the values
    below and keeps those inside, counted per distinct value."""
    v = _amplitudes(samples)
    ranks = [low / 100, high / 100]
    marks = [min(1.0, max(0.0, r + s)) for r in ranks for s in (-slack, slack)]
    accuracy = int(10 / slack)
    rough = v.groupBy("section_id").agg(F.percentile_approx("v", F.array(*map(F.lit, marks)), accuracy).alias("m"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    small = F.col("n") < accuracy
    brackets = [
        F.struct(F.when(small, F.col("least")).otherwise(F.col("m")[2 * i]).alias("a"), F.when(small, F.col("most")).otherwise(F.col("m")[2 * i + 1]).alias("b"), F.lit(r).alias("p"))
        for i, r in enumerate(ranks)
    ]
    rough = rough.select("section_id", "n", F.posexplode(F.array(*brackets)).alias("which", "x"))
    rough = rough.select("section_id", "which", ((F.col("n") - 1) * F.col("x.p")).alias("at"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    inside = (F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))
    met = v.join(F.broadcast(rough), "section_id").where("v <= b")
    # everything below a bracket is one row per map task and section after the partial count
    counted = met.groupBy("section_id", "which", "at", F.when(inside, F.col("v")).alias("value")).agg(F.count("*").alias("k"))
    order = Window.partitionBy("section_id", "which").orderBy(F.col("value").asc_nulls_first())
    placed = counted.withColumn("upto", F.sum("k").over(order))
    first = F.min(F.when(F.col("upto") > F.floor("at"), F.col("value")))
    second = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("value")))
    part = F.col("at") - F.floor("at")
    found = placed.groupBy("section_id", "which", "at").agg(first.alias("x0"), second.alias("x1"))
    found = found.withColumn("q", F.when(part == 0, F.col("x0")).otherwise(F.col("x0") * (1 - part) + F.col("x1") * part))
    return found.groupBy("section_id").agg(F.max(F.when(F.col("which") == 0, F.col("q"))).alias("lo"), F.max(F.when(F.col("which") == 1, F.col("q"))).alias("hi"))


def clip_bounds_of_traces(traces: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """The bounds of ``clip_bounds`` over ``samples_long``, exactly, without a row for each sample.

    The first pass counts samples by the upper half of their bits, which says in which of
    65536 buckets the wanted ranks lie; the second counts the values in those.  Tasks count
    a batch of traces at a time, so at most 65536 rows of a section and batch are shuffled
    in each pass, for each bound."""
    traces = traces.where("section_id is not null and samples is not null").select("section_id", F.col("samples").cast("array<float>").alias("samples"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, slices, _ in _by_section(batches):
            found, n = _tally([(keys >> 16).astype(np.uint16) for keys in slices])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["section_id", "bucket", "n"])

    counts = traces.mapInArrow(count, "section_id string, bucket int, n long").groupBy("section_id", "bucket").agg(F.sum("n").alias("n"))
    inside = Window.partitionBy("section_id")
    placed = counts.withColumns({"upto": F.sum("n").over(inside.orderBy("bucket")), "total": F.sum("n").over(inside)})
    ends = F.array(*[F.struct(F.lit(i).alias("which"), ((F.col("total") - 1) * F.lit(p / 100)).alias("at")) for i, p in enumerate((low, high))])
    marks = placed.select("section_id", "bucket", (F.col("upto") - F.col("n")).alias("below"), "upto", F.inline(ends))
    marks = marks.select("*", F.posexplode(F.array(F.floor("at"), F.ceil("at"))).alias("side", "rank")).where("rank >= below and rank < upto")
    asked = marks.groupBy("section_id").agg(F.collect_list(F.struct("which", "side", "at", "bucket", (F.col("rank") - F.col("below")).alias("rank"))).alias("asked"))

    def open_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, slices, asked in _by_section(batches, "asked"):
            held = {m["bucket"]: [] for m in asked}
            for keys in slices:
                buckets = keys >> 16
                for b, lower in held.items():
                    lower.append((keys[buckets == b] & 0xFFFF).astype(np.uint16))
            for m in asked:
                found, n = _tally(held[m["bucket"]])
                values = from_ordered_bits(found.astype(np.uint32) + np.uint32(m["bucket"] << 16))
                same = [pa.array([x] * len(found), t) for x, t in ((name, pa.string()), (m["which"], pa.int32()), (m["side"], pa.int32()), (m["at"], pa.float64()), (m["rank"], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(values), pa.array(n, pa.int64())], names=["section_id", "which", "side", "at", "rank", "value", "n"])

    keys = ["section_id", "which", "side", "at", "rank"]
    values = traces.join(F.broadcast(asked), "section_id").mapInArrow(open_buckets, "section_id string, which int, side int, at double, rank long, value float, n long")
    values = values.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    values = values.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))).where("rank < upto and rank >= upto - n")
    value = F.col("value").cast("double") + 0.0
    found = values.groupBy("section_id", "which", "at").agg(F.max(F.when(F.col("side") == 0, value)).alias("x0"), F.max(F.when(F.col("side") == 1, value)).alias("x1"))
    part = F.col("at") - F.floor("at")
    found = found.withColumn("q", F.when(part == 0, F.col("x0")).otherwise(F.col("x0") * (1 - part) + F.col("x1") * part))
    return found.groupBy("section_id").agg(F.max(F.when(F.col("which") == 0, F.col("q"))).alias("lo"), F.max(F.when(F.col("which") == 1, F.col("q"))).alias("hi"))


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit numbers that occur, and how often."""
    if sum(map(len, parts)) < FEW:
        return np.unique(np.concatenate([np.zeros(0, np.uint16), *parts]), return_counts=True)
    held = sum(np.bincount(x, minlength=1 << 16) for x in parts)
    found = np.flatnonzero(held)
    return found, held[found]


def _by_section(batches: Iterator[pa.RecordBatch], also: str | None = None) -> Iterator[tuple]:
    """Of each section in each batch the name, its samples but NaN as ordered bits, in slices, and
    what the column ``also`` has in its first row."""

    def slices(samples: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(samples), SLICE):
            some = samples[at : at + SLICE]
            yield ordered_bits(some[~np.isnan(some)])

    for batch in batches:
        codes = batch.column("section_id").dictionary_encode()
        names, of = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        if len(names) > 1:
            order = np.argsort(of, kind="stable")
            batch, of = batch.take(pa.array(order)), of[order]
        ends = np.searchsorted(of, np.arange(len(names) + 1))
        for name, first, until in zip(names, ends[:-1], ends[1:], strict=True):
            samples = batch.column("samples").slice(first, until - first).flatten().to_numpy(zero_copy_only=False)
            yield name, slices(samples), batch.column(also)[first].as_py() if also else None


def gray_samples(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """Long samples with ``gray`` in place of ``amplitude``."""
    level = gray_level(F.col("amplitude"), F.col("lo"), F.col("hi"))
    return samples.join(F.broadcast(bounds), "section_id").withColumn("gray", level).drop("amplitude", "lo", "hi")


def gray_traces(traces: DataFrame, bounds: DataFrame) -> DataFrame:
    """``section_id, trace_idx, gray`` with an array of levels per trace."""
    levels = F.transform("samples", lambda v: gray_level(v, F.col("lo"), F.col("hi")))
    return traces.join(F.broadcast(bounds), "section_id").select("section_id", "trace_idx", levels.alias("gray"))


def gray_bytes(traces: DataFrame, bounds: DataFrame) -> DataFrame:
    """``gray_traces`` with a trace's levels as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("samples")
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.concatenate(([0], np.cumsum(sizes)))
            flat, out = lists.flatten().to_numpy(zero_copy_only=False), np.zeros(ends[-1], np.uint8)
            lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lo", "hi"))
            runs = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True])))
            for first, until in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                if hi[first] > lo[first]:
                    for at in range(ends[first], ends[until], SLICE):
                        stop = min(at + SLICE, ends[until])
                        out[at:stop] = _levels(flat[at:stop], lo[first], hi[first])
            levels = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column("section_id"), batch.column("trace_idx"), levels], names=["section_id", "trace_idx", "gray"])

    rows = traces.where("samples is not null").select("section_id", F.col("trace_idx").cast("int").alias("trace_idx"), "samples").join(F.broadcast(bounds), "section_id")
    return rows.mapInArrow(run, "section_id string, trace_idx int, gray binary")


def _levels(amplitudes: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """``gray_level`` for bounds with a span."""
    v = np.minimum(np.maximum(amplitudes.astype(np.float64), lo), hi)
    with np.errstate(invalid="ignore"):
        v -= lo
        v /= hi - lo
        v *= 255
    return np.nan_to_num(v, copy=False).astype(np.uint8)


def to_rgb(gray: DataFrame) -> DataFrame:
    """Long grey samples with equal red, green and blue."""
    return gray.select("*", F.struct(F.col("gray").alias("r"), F.col("gray").alias("g"), F.col("gray").alias("b")).alias("rgb"))
