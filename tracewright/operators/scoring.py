"""Scoring tiles with a pluggable model.

A scorer is any object with ``labels`` (their ids) and ``score(tile, y, x)``, which
gives one probability map of the tile's size per label.  It is made on the worker, by
a function, once for all tiles of a task.  One with ``score_batch(tiles, ys, xs)`` gets
several tiles at a time, as one array, and gives the maps of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog, schemas


_SCORED = pa.schema(
    [("section_id", pa.string()), ("label_id", pa.int32()), ("tile_y", pa.int32()), ("tile_x", pa.int32()), ("row_off", pa.int32()), ("probs", pa.list_(pa.float32())), ("error", pa.string())]
)


class Scorer(Protocol):
    labels: tuple[int, ...]

    def score(self, tile: np.ndarray, y: int, x: int) -> Iterable[np.ndarray]: ...


class ClosedFormScorer:
    """Rational in the grey level and different from tile to tile: a model for tests.

    u = g/255 - label/6 + ((31 y + 17 x) mod 7)/10 - 0.3 and p = 0.5 + 0.5 u/(1 + |u|)."""

    def __init__(self, labels: Iterable[int] | None = None):
        self.labels = tuple(labels or (x[0] for x in catalog.LABELS))

    def score(self, tile: np.ndarray, y: int, x: int) -> Iterator[np.ndarray]:
        for k in self.labels:
            u = tile / 255.0 - k / 6.0 + ((31 * y + 17 * x) % 7) / 10.0 - 0.3
            yield (0.5 + 0.5 * u / (1 + np.abs(u))).astype(np.float32)


def prompt_fanout(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Every tile with every label.  The labels are a fixed handful of rows, so they are
    sent to the tiles; inside a scorer the labels stay batched instead."""
    return tiles.crossJoin(F.broadcast(labels))


STRIP_VALUES = 1 << 20
BATCH_TILES = 8


def scored(tiles: Iterable[tuple], make_scorer: Callable[[], Scorer], batch_tiles: int = BATCH_TILES) -> Iterator[tuple]:
    """``key, maps, error`` for each of ``tiles`` (key, y, x, image), in order: the maps by label,
    or what the scorer failed with.

    Tiles go to a scorer with ``score_batch`` some at a time.  If it fails on a batch, each
    tile of it is tried by itself, so one tile's failure stays its own."""
    scorer, held = None, []

    def maps_of(images: list[tuple]) -> Iterator[tuple]:
        nonlocal scorer
        try:
            scorer = scorer or make_scorer()
            if hasattr(scorer, "score_batch"):
                found = scorer.score_batch(np.stack([x[3] for x in images]), [x[1] for x in images], [x[2] for x in images])
                found = [list(zip(scorer.labels, maps, strict=True)) for maps in found]
            else:
                found = [list(zip(scorer.labels, scorer.score(x[3], x[1], x[2]), strict=True)) for x in images]
            for x, maps in zip(images, found, strict=True):
                yield x[0], maps, None
        except Exception as error:  # noqa: BLE001  one tile's failure is a row
            if len(images) == 1:
                yield images[0][0], [], f"{type(error).__name__}: {error}"
            else:
                for x in images:
                    yield from maps_of([x])

    for one in tiles:
        scorer = scorer or _tried(make_scorer)
        held.append(one)
        if len(held) >= (batch_tiles if hasattr(scorer, "score_batch") else 1) or held[0][3].shape != one[3].shape:
            yield from maps_of(held)
            held = []
    if held:
        yield from maps_of(held)


def _tried(make_scorer: Callable[[], Scorer]) -> Scorer | None:
    try:
        return make_scorer()
    except Exception:  # noqa: BLE001  it is made again for each tile, whose row then has the error
        return None


def score_tiles(tiles: DataFrame, make_scorer: Callable[[], Scorer] = ClosedFormScorer, tile: int = 1024, batch_tiles: int = BATCH_TILES, profile: ResourceProfile | None = None) -> DataFrame:
    """Strips of probabilities: one row per tile, label and row of the tile.

    Spark hands over tiles in batches of limited size
    (spark.sql.execution.arrow.maxBytesPerBatch); of their maps at most those of
    ``batch_tiles`` and ``STRIP_VALUES`` values more are held at a time.  A tile that the
    scorer fails on gives one row with ``error`` set and without probabilities, and the
    others are scored.  ``profile`` says what machines the stage needs, such as ones with
    an accelerator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def strips() -> pa.RecordBatch:
            maps = [np.asarray(m, np.float32) for *_, m in held]
            rows = [len(m) for m in maps]
            sections, *numbers = list(zip(*held, strict=True))[:4]
            repeated = [pa.array(sections, pa.string()).take(pa.array(np.repeat(np.arange(len(held)), rows))), *(pa.array(np.repeat(np.array(c, np.int32), rows)) for c in numbers)]
            widths = np.repeat([m.shape[1] for m in maps], rows)
            offsets = np.concatenate(([0], np.cumsum(widths))).astype(np.int32)
            probs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([m.ravel() for m in maps])))
            offs = np.concatenate([np.arange(n, dtype=np.int32) for n in rows])
            return pa.RecordBatch.from_arrays([*repeated, pa.array(offs), probs, pa.nulls(len(offs), pa.string())], schema=_SCORED)

        def images() -> Iterator[tuple]:
            for batch in batches:
                for section, y, x, pixels in zip(*(batch.column(c) for c in ("section_id", "tile_y", "tile_x", "pixels")), strict=True):
                    key = section.as_py(), y.as_py(), x.as_py()
                    yield key, key[1], key[2], np.frombuffer(pixels.as_buffer(), np.uint8).reshape(tile, -1)

        for key, maps, error in scored(images(), make_scorer, batch_tiles):
            if error is not None:
                lost = [[key[0]], [None], [key[1]], [key[2]], [None], [None], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(lost, _SCORED.types, strict=True)], schema=_SCORED)
            for label, probs in maps:
                held.append((key[0], label, *key[1:], probs))
                size += np.size(probs)
                if size >= STRIP_VALUES:
                    yield strips()
                    held, size = [], 0
        if held:
            yield strips()

    return tiles.select("section_id", "tile_y", "tile_x", "pixels").mapInArrow(run, schemas.SCORED, profile=profile)


def resized_scorer(logits: Callable[[np.ndarray, int, int], Iterable[np.ndarray]], labels: tuple[int, ...]) -> Callable[[], Scorer]:
    """A scorer from a model with logits on a grid of its own: they are resized to the
    tile bilinearly, with half-pixel centres, and go through a sigmoid."""

    class Resized:
        def __init__(self):
            self.labels = labels

        def score(self, tile: np.ndarray, y: int, x: int) -> Iterator[np.ndarray]:
            for grid in logits(tile, y, x):
                yield (1 / (1 + np.exp(-resize(np.asarray(grid, np.float64), tile.shape)))).astype(np.float32)

    return Resized


def resize(grid: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resize with half-pixel centres, one axis after the other."""
    for axis, size in enumerate(shape):
        n = grid.shape[axis]
        at = np.maximum(0.0, (np.arange(size) + 0.5) * n / size - 0.5)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        grid = np.take(grid, low, axis) * (1 - part) + np.take(grid, np.minimum(low + 1, n - 1), axis) * part
    return grid
