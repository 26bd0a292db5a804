"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_starts(dim: Column, tile: int, stride: int) -> Column:
    """Offsets of windows over an axis: every ``stride``, and one that reaches the edge."""
    if stride <= 0 or tile <= 0:
        raise ValueError("tile and stride must be positive")
    last = dim.cast("int") - tile
    regular = F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(regular)


def covering_starts(dim: Column, position: Column, tile: int, stride: int) -> Column:
    """Those of ``tile_starts`` whose window covers a position, worked out from the position:
    at most ``tile / stride + 2`` numbers, however long the axis is."""
    if stride <= 0 or tile <= 0:
        raise ValueError("tile and stride must be positive")
    last, p = dim.cast("int") - tile, position.cast("int")
    first_k = F.floor((F.greatest(p - tile + 1, F.lit(0)) + (stride - 1)) / F.lit(stride)).cast("int")
    last_k = F.floor(F.least(p, F.greatest(last, F.lit(0))) / F.lit(stride)).cast("int")
    some = F.transform(F.sequence(first_k, F.greatest(first_k, last_k)), lambda k: k * stride)
    regular = F.when((first_k <= last_k) & (p >= 0), some).otherwise(F.array().cast("array<int>"))
    edge = F.greatest(last, F.lit(0))
    return F.when((p >= edge) & (p < edge + tile), F.array_union(regular, F.array(edge))).otherwise(regular)


def gray_level(amplitude: Column, lo: Column, hi: Column) -> Column:
    """Clip to the bounds and scale to 0..255, truncating; 0 without a span, and for NaN and null."""
    v = amplitude.cast("double")
    scaled = F.floor((F.least(F.greatest(v, lo), hi) - lo) / F.when(hi > lo, hi - lo) * 255).cast("smallint")
    return F.when((hi > lo) & v.isNotNull() & ~F.isnan(v), scaled).otherwise(F.lit(0).cast("smallint"))


def sigmoid(logit: Column) -> Column:
    return (1 / (1 + F.exp(-logit.cast("double")))).cast("float")


def is_on(prob: Column, threshold: float) -> Column:
    """Whether a probability reaches the threshold, both as 32-bit floats; NaN never does."""
    return F.coalesce((prob >= F.lit(threshold).cast("float")) & ~F.isnan(prob), F.lit(False))


def resize_source(target: Column, size_in: int, size_out: int) -> Column:
    """Where a half-pixel centre of the output falls on the input axis."""
    return F.greatest(F.lit(0.0), (target.cast("double") + 0.5) * size_in / size_out - 0.5)


def bilinear(grid: Column, height: int, width: int, row: Column, col: Column, out_height: int, out_width: int) -> Column:
    """The value of a row-major grid, resized bilinearly, at one output pixel."""
    y, x = resize_source(row, height, out_height), resize_source(col, width, out_width)
    y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    y1, x1 = F.least(y0 + 1, F.lit(height - 1)), F.least(x0 + 1, F.lit(width - 1))
    dy, dx = y - y0, x - x0
    at = lambda r, c: F.element_at(grid, r * width + c + 1).cast("double")
    return at(y0, x0) * (1 - dy) * (1 - dx) + at(y0, x1) * (1 - dy) * dx + at(y1, x0) * dy * (1 - dx) + at(y1, x1) * dy * dx
