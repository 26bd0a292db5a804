"""Coloured layers over grey sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import DEFAULT_COLOUR

ALPHA = 0.45


def layer_filter(rows: DataFrame, labels: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Rows of the chosen labels with ``label`` and ``draw_order``: the order of the list.

    None draws all labels, in the catalog's order; an empty list draws none."""
    spark = rows.sparkSession
    if only is None:
        order = labels.select("label_id", "label", F.col("label_id").alias("draw_order"))
    else:
        chosen = spark.createDataFrame([(name, i + 1) for i, name in enumerate(only)], "label string, draw_order int")
        order = labels.select("label_id", "label").join(chosen, "label")
    return rows.join(F.broadcast(order), "label_id")


def overlay_blend(base: DataFrame, layers: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``section_id, trace_idx, sample_idx, r, g, b``: layers composited over grey.

    ``base(section_id, trace_idx, sample_idx, gray)``, ``layers`` as from
    ``layer_filter`` with ``mask``.  Only pixels that are on take part, so empty masks
    cost nothing; colours of labels outside the catalog are white.  The layers of a
    pixel are at most the labels, drawn in order, in whole numbers rounded half up."""
    colours = F.broadcast(labels.select(F.col("label_id").alias("of"), "r", "g", "b"))
    drawn = layers.where("mask").join(colours, F.col("label_id") == F.col("of"), "left")
    keys = ["section_id", "trace_idx", "sample_idx"]
    none = F.lit(None).cast("int")
    # grey and layers of a pixel meet in one shuffle
    both = base.select(*keys, F.col("gray").cast("int").alias("gray"), none.alias("draw_order"), *[none.alias(c) for c in "rgb"])
    both = both.unionByName(drawn.select(*keys, none.alias("gray"), F.col("draw_order").cast("int").alias("draw_order"), *_colours()))
    layer = F.when(F.col("draw_order").isNotNull(), F.struct("draw_order", *"rgb"))
    pixels = both.groupBy(*keys).agg(F.max("gray").alias("gray"), F.array_sort(F.collect_list(layer)).alias("stack")).where("gray is not null")
    return pixels.select(*keys, *[_mixed(F.col("stack"), F.col("gray"), c, alpha).alias(c) for c in "rgb"])


def _colours():
    return [F.coalesce(F.col(c), F.lit(d)).cast("int").alias(c) for c, d in zip("rgb", DEFAULT_COLOUR, strict=True)]


def _mixed(stack: Column, gray: Column, channel: str, alpha: float) -> Column:
    a = int(255 * alpha)
    return F.aggregate(stack, gray.cast("int"), lambda acc, x: F.floor((x[channel] * a + acc * (255 - a) + 127) / 255).cast("int"))


def overlay_packed(gray: DataFrame, masks: DataFrame, labels: DataFrame, only: Sequence[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """``section_id, trace_idx, r, g, b`` with an array of levels per trace.

    ``gray(section_id, trace_idx, gray)`` and ``masks(section_id, label_id, trace_idx,
    mask)`` are packed; the layers of a trace are at most the labels, and are folded as
    arrays, so nothing is shuffled by pixel.  The rules are those of ``overlay_blend``."""
    a = int(255 * alpha)
    drawn = layer_filter(masks, labels, only).select("section_id", "trace_idx", "label_id", "draw_order", "mask").where(F.exists("mask", lambda m: m))
    coloured = drawn.join(F.broadcast(labels.select("label_id", *"rgb")), "label_id", "left").select("section_id", "trace_idx", "draw_order", *_colours(), "mask")
    stacks = coloured.groupBy("section_id", "trace_idx").agg(F.array_sort(F.collect_list(F.struct("draw_order", *"rgb", "mask"))).alias("stack"))
    # both are as large as the sections, whatever their files' sizes
    joined = gray.hint("merge").join(stacks, ["section_id", "trace_idx"], "left")

    start = F.transform("gray", lambda v: v.cast("int"))

    def channel(c: str) -> Column:
        level = lambda v, x: F.floor((x[c] * a + v * (255 - a) + 127) / 255).cast("int")
        drawn = F.aggregate("stack", start, lambda acc, x: F.zip_with(acc, x["mask"], lambda v, m: F.when(m, level(v, x)).otherwise(v)))
        return F.coalesce(drawn, start).alias(c)

    return joined.select("section_id", "trace_idx", *map(channel, "rgb"))
