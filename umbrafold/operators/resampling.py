"""Resampling of images in tiles: along one axis, then along the other, by weights that depend on the place in the grid.

Each pass sends the strips of source tiles to the destination tiles that their weights reach, which multiply them by a small
matrix. Which axis comes first is chosen for each image by the smaller image in between.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.operators.tiles import TILES, _batch, _few, _tiles_of

_PLANNED = TILES + ", to_width long, to_height long, axis long"
_PARTS = _PLANNED + ", at long, n long"
X, Y = 0, 1


def _cubic(a: np.ndarray, b: float, c: float) -> np.ndarray:
    near = ((12 - 9 * b - 6 * c) * a**3 + (-18 + 12 * b + 6 * c) * a**2 + (6 - 2 * b)) / 6
    far = ((-b - 6 * c) * a**3 + (6 * b + 30 * c) * a**2 + (-12 * b - 48 * c) * a + (8 * b + 24 * c)) / 6
    return np.where(a < 1, near, np.where(a < 2, far, 0))


#: (radius, weight by distance). Nearest does not widen when an image is made smaller.
FILTERS = {
    "nearest": (0.5, lambda d: ((d >= -0.5) & (d < 0.5)) * 1.0),
    "triangle": (1.0, lambda d: np.maximum(1 - np.abs(d), 0)),
    "mitchell": (2.0, lambda d: _cubic(np.abs(d), 1 / 3, 1 / 3)),
    "lanczos3": (3.0, lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)),
}


def _support(src: int, dst: int, kind: str) -> tuple[float, float]:
    """(scale of the filter, how far it reaches in source pixels)."""
    scale = src / dst if dst < src and kind != "nearest" else 1.0
    return scale, FILTERS[kind][0] * scale


def _span(src: int, dst: int, kind: str, lo: int, hi: int) -> tuple[int, int]:
    """The source pixels, first and past the last, that destinations lo to hi - 1 read; those beyond an edge read the edge."""
    support = _support(src, dst, kind)[1]
    first = int(np.ceil((lo + 0.5) * src / dst - support - 0.5))
    last = int(np.floor((hi - 0.5) * src / dst + support - 0.5))
    middle = [int(np.floor((i + 0.5) * src / dst)) for i in (lo, hi - 1)]
    return max(0, min(first, middle[0])), min(src - 1, max(last, middle[1])) + 1


def weights(src: int, dst: int, kind: str, lo: int, hi: int) -> np.ndarray:
    """Rows for destinations lo to hi - 1, columns for the pixels of their span; each row sums to 1."""
    scale, support = _support(src, dst, kind)
    start, end = _span(src, dst, kind, lo, hi)
    center = (np.arange(lo, hi) + 0.5) * src / dst
    first, last = np.ceil(center - support - 0.5).astype(np.int64), np.floor(center + support - 0.5).astype(np.int64)
    taps = first[:, None] + np.arange(max(int((last - first).max()) + 1, 1))
    w = np.where(taps <= last[:, None], FILTERS[kind][1]((taps + 0.5 - center[:, None]) / scale), 0)
    total = w.sum(1)
    empty = np.abs(total) < 1e-9  # a nearest pixel just at a boundary
    out = np.zeros((hi - lo, end - start))
    np.add.at(out, (np.arange(hi - lo)[:, None], np.clip(taps, 0, src - 1).clip(start, end - 1) - start), w / np.where(empty, 1, total)[:, None])
    out[empty] = 0
    out[np.flatnonzero(empty), np.floor(center[empty]).astype(np.int64) - start] = 1
    return out


def _send(side: int, kind: str):
    def run(batches):
        for batch in (p for b in batches for p in _few(b, side)):
            rows = []
            plan = zip(*(batch.column(c).to_pylist() for c in ("to_width", "to_height", "axis")), strict=True)
            for (image, tx, ty, width, height, tile), (to_width, to_height, axis) in zip(_tiles_of([batch], side), plan, strict=True):
                src, dst, own = (width, to_width, tx) if axis == X else (height, to_height, ty)
                begin, n = own * side, tile.shape[1 - axis]
                reach = _support(src, dst, kind)[1] + 2
                low, high = max(0, int((begin - reach) * dst / src) // side - 1), min(-(-dst // side) - 1, int((begin + n + reach) * dst / src) // side + 1)
                for u in range(low, high + 1):
                    a, b = _span(src, dst, kind, u * side, min((u + 1) * side, dst))
                    a, b = max(a, begin), min(b, begin + n)
                    if a < b:
                        part = tile[:, a - begin : b - begin] if axis == X else tile[a - begin : b - begin]
                        rows.append((image, *((u, ty) if axis == X else (tx, u)), width, height, part.ravel(), to_width, to_height, axis, a, b - a))
            yield _batch(rows, _PARTS)

    return run


def _receive(side: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        image, tx, ty, width, height, to_width, to_height, axis = (rows[0][c] for c in ("image", "tx", "ty", "width", "height", "to_width", "to_height", "axis"))
        src, dst, own = (width, to_width, tx) if axis == X else (height, to_height, ty)
        lo, hi = own * side, min((own + 1) * side, dst)
        start, end = _span(src, dst, kind, lo, hi)
        parts = [np.reshape(r["pixels"], (-1, r["n"])) if axis == X else np.reshape(r["pixels"], (r["n"], -1)) for r in sorted(rows, key=lambda r: r["at"])]
        canvas = np.concatenate(parts, axis=1 - axis)
        assert canvas.shape[1 - axis] == end - start, "a source tile is missing"
        w = weights(src, dst, kind, lo, hi)
        out = canvas @ w.T if axis == X else w @ canvas
        size = (to_width, height) if axis == X else (width, to_height)
        return pa.Table.from_batches([_batch([(image, tx, ty, *size, np.ascontiguousarray(out).ravel(), to_width, to_height, 1 - axis)], _PLANNED)])

    return run


def resampled(tiles: DataFrame, side: int, width: Column, height: Column, kind: str) -> DataFrame:
    """Tiles of the images at another size, given by expressions over their width and height. kind: nearest, triangle, mitchell or lanczos3.

    An image that no tile is missing from is required; sizes must be 1 or more. Images choose the order of their axes by size.
    """
    planned = tiles.select(*(c.split()[0] for c in TILES.split(", ")), width.cast("long").alias("to_width"), height.cast("long").alias("to_height"))
    planned = planned.withColumn("axis", F.when(F.col("to_width") * F.col("height") <= F.col("width") * F.col("to_height"), X).otherwise(Y).cast("long"))
    for _ in (X, Y):
        planned = planned.mapInArrow(_send(side, kind), _PARTS).groupBy("image", "tx", "ty").applyInArrow(_receive(side, kind), _PLANNED)
    return planned.select(*(c.split()[0] for c in TILES.split(", ")))
