"""Palettes: median cut over a histogram of bounded size, and pixels mapped to the nearest entry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 5


def color_histogram(pixels: DataFrame, bits: int = BITS) -> DataFrame:
    """pixels(r, g, b in 0..255) to (cell, n, r, g, b): counts and sums by the leading bits, 2 ** (3 * bits) rows at most."""
    shift = 1 << (8 - bits)
    cell = F.lit(0)
    for c in ("r", "g", "b"):
        cell = cell * (1 << bits) + F.floor(F.col(c) / shift).cast("int")
    return pixels.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(c) for c in ("r", "g", "b")])


def median_cut(histogram: DataFrame, colors: int) -> list[tuple[int, int, int]]:
    """Sorted distinct palette of `colors` entries at most: the box with most pixels that can be cut is cut at the weighted median of its longest side."""
    rows = histogram.orderBy("cell").collect()  # bounded by the histogram's bits
    if not rows:
        return []
    n = np.array([r["n"] for r in rows], float)
    mean = np.array([[r["r"], r["g"], r["b"]] for r in rows], float) / n[:, None]
    boxes = [np.arange(len(rows))]
    while len(boxes) < colors:
        cuttable = [k for k, b in enumerate(boxes) if len(b) > 1]
        if not cuttable:
            break
        box = boxes.pop(max(cuttable, key=lambda k: (n[boxes[k]].sum(), -k)))
        side = int(np.argmax(np.ptp(mean[box], axis=0)))
        box = box[np.argsort(mean[box][:, side], kind="stable")]
        run = np.cumsum(n[box])
        cut = min(max(1, int(np.searchsorted(run, run[-1] / 2)) + 1), len(box) - 1)
        boxes += [box[:cut], box[cut:]]
    entries = [np.floor((mean[b] * n[b][:, None]).sum(0) / n[b].sum() + 0.5).astype(int).tolist() for b in boxes]
    return sorted({tuple(e) for e in entries})


def web_palette() -> list[tuple[int, int, int]]:
    return [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]


def nearest_entry(rgb: tuple[Column, Column, Column], palette: list[tuple[int, int, int]]) -> Column:
    """Index of the nearest palette entry by squared distance, the lowest at a tie."""
    table = F.array(*[F.array(*map(F.lit, p)) for p in palette])
    far = lambda p: sum(((rgb[k] - F.get(p, F.lit(k))) * (rgb[k] - F.get(p, F.lit(k))) for k in range(3)), F.lit(0))
    return F.array_min(F.transform(table, lambda p, i: F.struct(far(p).alias("d"), i.alias("i"))))["i"]
