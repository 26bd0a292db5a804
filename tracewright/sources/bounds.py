"""Exact clip bounds of SEG-Y files from counts that are kept in a shared folder.

Amplitudes fall into 65536 buckets by the upper half of their bits, in the order of their
values.  For each range of traces of a file and each section in it the folder holds

* ``ranges``: where the range lies, and how its file was found,
* ``counts``: how many samples fall into each bucket,
* ``values``: how often each value occurs, for buckets that were opened.

Counts add up over ranges, so they say in which buckets the wanted ranks lie.  Only ranges
with samples in those are read again, and what was found there is kept too.  A file that is
added later is therefore counted alone; older ones are read once more only where a wanted
rank moves into a bucket that they have samples in and that wasn't opened.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import staged
from . import segy

RANGES = "run string, path string, n_traces long, modified long, geometry string, start long, n_samples int, format int, first long, traces long"
COUNTS = "run string, path string, first long, section_id string, bucket int, n long"
VALUES = "run string, path string, first long, section_id string, bucket int, value float, n long"
_PLACE = ["run", "path", "first", "section_id", "bucket"]


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of 32-bit floats; NaN has no place."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def from_ordered_bits(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> 31, keys ^ np.uint32(1 << 31), ~keys).astype(np.uint32).view(np.float32)


def _sections(r: dict) -> Iterator[tuple[str, np.ndarray]]:
    """The samples of each section in a range, as ordered bits."""
    reader = segy.SegyReader({"geometry": r["geometry"]})
    layout = segy.Layout(r["n_samples"], r["format"], r["start"], r["n_traces"], "ok")
    for batch in reader.read(segy.Range(r["path"], r["first"], r["traces"], layout)):
        samples = batch.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        names, of = np.unique(np.array(batch.column("section_id").to_pylist(), object), return_inverse=True)
        order = np.argsort(of, kind="stable")
        for name, rows in zip(names, np.split(order, np.flatnonzero(np.diff(of[order])) + 1), strict=True):
            v = samples[rows].ravel()
            yield name, ordered_bits(v[~np.isnan(v)])


def _over_ranges(ranges: DataFrame, found: Callable[[dict, str, np.ndarray], list[np.ndarray]], schema: str, per_task: int = 32) -> DataFrame:
    """``found`` for each section of each range; a task holds one range at a time."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {"bucket": pa.int32(), "value": pa.float32(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for section, keys in _sections(r):
                    columns = found(r, section, keys)
                    place = [pa.array([r[k]] * len(columns[0]), pa.int64() if k == "first" else pa.string()) for k in ("run", "path", "first")]
                    place.append(pa.array([section] * len(columns[0]), pa.string()))
                    yield pa.RecordBatch.from_arrays(place + [pa.array(c, kinds[k]) for c, k in zip(columns, names[4:], strict=True)], names=names)

    tasks = max(1, -(-ranges.count() // per_task), min(ranges.count(), ranges.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(tasks, "path", "first").mapInArrow(run, schema).repartition("path", "first")


def _count(r: dict, section: str, keys: np.ndarray) -> list[np.ndarray]:
    return list(np.unique(keys >> 16, return_counts=True))


def _open(r: dict, section: str, keys: np.ndarray) -> list[np.ndarray]:
    asked = np.array([x["bucket"] for x in r["asked"] if x["section_id"] == section], np.uint32)
    values, n = np.unique(keys[np.isin(keys >> 16, asked)], return_counts=True)
    return [values >> 16, from_ordered_bits(values), n]


def _table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def keep_counts(spark: SparkSession, folder: str, *patterns: str, geometry: str = "2d", traces_per_range: int = 4096) -> DataFrame:
    """Count what isn't counted yet; the ranges of all files that the patterns name, as they are now.

    A file counts as another one when its time, its number of traces or the geometry asked
    for has changed; files that can't be read have no ranges.  ``ranges`` is written last,
    so what a failed run left behind belongs to no range."""
    layouts = {p: at for p in segy._expand(list(patterns)) if (at := segy.layout_of(p)).status == "ok"}
    now = [(p, at.n_traces, segy._modified(p), geometry, at.start, at.n_samples, at.format) for p, at in layouts.items()]
    stamp = ["path", "n_traces", "modified", "geometry"]
    files = spark.createDataFrame(now, "path string, n_traces long, modified long, geometry string, start long, n_samples int, format int")
    kept = _table(spark, folder, "ranges", RANGES)
    _table(spark, folder, "counts", COUNTS)
    new = files.join(kept.select(stamp).distinct(), stamp, "left_anti")
    new = new.select(F.lit(uuid.uuid4().hex).alias("run"), "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_traces") - 1, F.lit(traces_per_range).cast("long"))).alias("first"))
    new = staged(new.withColumn("traces", F.least(F.lit(traces_per_range).cast("long"), F.col("n_traces") - F.col("first"))))
    if not new.isEmpty():
        _over_ranges(new, _count, COUNTS).write.mode("append").parquet(f"{folder.rstrip('/')}/counts")
        new.coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/ranges")
    current = _table(spark, folder, "ranges", RANGES).join(files.select(stamp), stamp)
    # of two runs that counted one file at the same time the first by name stands
    first = current.groupBy("path").agg(F.min("run").alias("run"))
    return current.join(first, ["path", "run"]).select(*[c.split()[0] for c in RANGES.split(", ")])


def kept_bounds(
    spark: SparkSession, folder: str, *patterns: str, low: float = 2.0, high: float = 98.0, by: Column | None = None,
    geometry: str = "2d", traces_per_range: int = 4096, margin: int = 1,
) -> DataFrame:
    """``section_id, lo, hi``: the bounds of ``normalize.clip_bounds``, from kept counts.

    ``by``, an expression over ``section_id`` and ``path``, makes all sections of one value
    share bounds (a literal: one pair for a whole survey; null is a value too).  NaN doesn't
    count; a section without any other sample has no row, unless it shares bounds.  Where a range is
    read again, ``margin`` buckets to each side of the wanted ones are opened with them, so
    that bounds may move a little before it is read once more."""
    ranges = keep_counts(spark, folder, *patterns, geometry=geometry, traces_per_range=traces_per_range)
    group = F.to_json(F.struct((F.col("section_id") if by is None else by).alias("g")))
    # a row per file, as the driver listed them; by its compressed size Spark would send ``counts`` instead
    counts = _table(spark, folder, "counts", COUNTS).join(F.broadcast(ranges.select("run", "path").distinct()), ["run", "path"])
    counts = counts.withColumn("group_id", group)
    # at most 65536 rows of a group after the sum
    inside = Window.partitionBy("group_id")
    placed = counts.groupBy("group_id", "bucket").agg(F.sum("n").alias("n")).withColumns(
        {"upto": F.sum("n").over(inside.orderBy("bucket")), "total": F.sum("n").over(inside)}
    )
    ends = F.array(*[F.struct(F.lit(i).alias("which"), ((F.col("total") - 1) * F.lit(p / 100)).alias("at")) for i, p in enumerate((low, high))])
    marks = placed.select("group_id", "bucket", (F.col("upto") - F.col("n")).alias("below"), "upto", F.inline(ends))
    marks = marks.select("*", F.posexplode(F.array(F.floor("at"), F.ceil("at"))).alias("side", "rank"))
    wanted = staged(marks.where("rank >= below and rank < upto").drop("upto"))
    asked = counts.join(wanted.select("group_id", "bucket").distinct(), ["group_id", "bucket"]).select("group_id", *_PLACE)
    # places and values are as many as ranges and sections: they meet in shuffles, whatever their files' sizes
    values = _table(spark, folder, "values", VALUES).hint("merge")
    closed = asked.join(values.select(_PLACE).distinct().hint("merge"), _PLACE, "left_anti").select("run", "path", "first").distinct()
    closed = staged(ranges.join(closed, ["run", "path", "first"]))
    if not closed.isEmpty():
        near = wanted.select("group_id", F.explode(F.sequence(F.col("bucket") - margin, F.col("bucket") + margin)).alias("bucket")).distinct()
        opened = counts.join(near, ["group_id", "bucket"]).select(_PLACE).join(values.select(_PLACE).distinct().hint("merge"), _PLACE, "left_anti")
        # a range's list is as long as its sections times the buckets wanted, at most 4 * (2 * margin + 1)
        opened = opened.groupBy("run", "path", "first").agg(F.collect_list(F.struct("section_id", "bucket")).alias("asked"))
        _over_ranges(staged(closed.join(opened, ["run", "path", "first"])), _open, VALUES).write.mode("append").parquet(f"{folder.rstrip('/')}/values")
        values = _table(spark, folder, "values", VALUES).hint("merge")
    found = values.join(asked, _PLACE).groupBy("group_id", *_PLACE, "value").agg(F.max("n").alias("n"))
    found = found.groupBy("group_id", "bucket", "value").agg(F.sum("n").alias("n"))
    # at most 65536 values of a bucket
    found = found.withColumn("upto", F.sum("n").over(Window.partitionBy("group_id", "bucket").orderBy("value")))
    met = wanted.join(found, ["group_id", "bucket"]).where("rank < below + upto and rank >= below + upto - n")
    value = F.col("value").cast("double") + 0.0
    pairs = met.groupBy("group_id", "which", "at").agg(F.max(F.when(F.col("side") == 0, value)).alias("x0"), F.max(F.when(F.col("side") == 1, value)).alias("x1"))
    part = F.col("at") - F.floor("at")
    pairs = pairs.withColumn("q", F.when(part == 0, F.col("x0")).otherwise(F.col("x0") * (1 - part) + F.col("x1") * part))
    bounds = pairs.groupBy("group_id").agg(F.max(F.when(F.col("which") == 0, F.col("q"))).alias("lo"), F.max(F.when(F.col("which") == 1, F.col("q"))).alias("hi"))
    return counts.select("section_id", "group_id").distinct().join(F.broadcast(bounds), "group_id").select("section_id", "lo", "hi")
