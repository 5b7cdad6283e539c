"""Whole-image kernels that no column expression states: run by image inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _each(images: DataFrame, fn, schema: str, kinds: list, width: int) -> DataFrame:
    """fn over each image as a matrix of the given width; images of one table have one width and any heights."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(i, *r) for i, c in zip(batch.column("vec_id").to_pylist(), batch.column("codes").to_pylist(), strict=True) for r in fn(np.array(c, np.int64).reshape(-1, width))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return images.select("vec_id", "codes").mapInArrow(run, schema)


def components(images: DataFrame, level: int = 128, width: int = 8) -> DataFrame:
    """(vec_id, component, n, x0, y0, x1, y1): 4-connected regions of pixels at or above the level, in order of their first pixel."""

    def label(img):
        mask, seen, k = img >= level, np.zeros(img.shape, bool), 0
        for y0, x0 in zip(*np.nonzero(mask), strict=True):
            if seen[y0, x0]:
                continue
            stack, found = [(y0, x0)], []
            seen[y0, x0] = True
            while stack:
                y, x = stack.pop()
                found.append((y, x))
                for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= v < img.shape[0] and 0 <= u < img.shape[1] and mask[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        stack.append((v, u))
            ys, xs = [p[0] for p in found], [p[1] for p in found]
            yield k, len(found), int(min(xs)), int(min(ys)), int(max(xs)) + 1, int(max(ys)) + 1
            k += 1

    return _each(images, label, "vec_id long, component int, n int, x0 int, y0 int, x1 int, y1 int", [pa.int64()] + [pa.int32()] * 6, width)


def wand(images: DataFrame, x: int, y: int, tolerance: int, width: int = 8) -> DataFrame:
    """(vec_id, pos): the region connected to (x, y) whose codes differ from the code there by the tolerance at most."""

    def flood(img):
        near = np.abs(img - img[y, x]) <= tolerance
        region = np.zeros(img.shape, bool)
        region[y, x] = True
        while True:
            grown = region.copy()
            grown[1:] |= region[:-1]
            grown[:-1] |= region[1:]
            grown[:, 1:] |= region[:, :-1]
            grown[:, :-1] |= region[:, 1:]
            grown &= near
            if (grown == region).all():
                return [(int(p),) for p in np.flatnonzero(region)]
            region = grown

    return _each(images, flood, "vec_id long, pos int", [pa.int64(), pa.int32()], width)


def spectrum(images: DataFrame, width: int = 8) -> DataFrame:
    """(vec_id, u, v, power): squared magnitudes of the two-dimensional Fourier transform."""

    def fft(img):
        power = np.abs(np.fft.fft2(img)) ** 2
        return [(u, v, round(float(power[v, u]), 3)) for v in range(power.shape[0]) for u in range(power.shape[1])]

    return _each(images, fft, "vec_id long, u int, v int, power double", [pa.int64(), pa.int32(), pa.int32(), pa.float64()], width)


def error_diffused(images: DataFrame, width: int = 8) -> DataFrame:
    """(vec_id, pos, out): black and white with each pixel's error handed to its neighbours (7, 3, 5, 1 sixteenths)."""

    def diffuse(img):
        work, out = img.astype(float), np.zeros(img.shape, np.int64)
        h, w = img.shape
        for y in range(h):
            for x in range(w):
                out[y, x] = 255 if work[y, x] >= 128 else 0
                e = work[y, x] - out[y, x]
                for dx, dy, k in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        work[y + dy, x + dx] += e * k / 16
        return [(p, int(v)) for p, v in enumerate(out.ravel())]

    return _each(images, diffuse, "vec_id long, pos int, out int", [pa.int64(), pa.int32(), pa.int32()], width)
