"""Neighbourhood filters on images of any size: tiles, the margins that they exchange, and kernels on a tile with its margin.

A tile is a row (image, tx, ty, width, height, pixels): width and height are the whole image's, pixels are its own, row by
row, and the last tiles of a row or column may be smaller than `side`. To filter, each tile sends every tile whose margin
reaches into it the strip that is missing there; the strips meet by tile, so a task holds a tile and its margin and no image
is ever in one row. Positions that kernels see are absolute: the result does not depend on how an image is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.functions.noise import SECOND_DIFFUSE, SECOND_TILES, clouds_grid, hash_unit, hash_unit_grid

TILES = "image long, tx long, ty long, width long, height long, pixels array<double>"
_STRIPS = TILES + ", x0 long, y0 long, w long, h long"
PART = 1 << 20  # pixels
#: A kernel takes the canvas (a tile with its margin on all sides), the margin and the tile's place, and gives the tile.
Kernel = Callable[[np.ndarray, int, int, int], np.ndarray]


def _kinds(schema: str) -> pa.Schema:
    return pa.schema([(n, pa.list_(pa.float64()) if k == "array<double>" else pa.int64()) for n, k in (c.split() for c in schema.split(", "))])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = _kinds(schema)
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)


def _few(batch: pa.RecordBatch, side: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about a million pixels at most, so that what a task holds besides its batch does not grow with the batch."""
    rows = max(1, PART // (side * side))
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def _tiles_of(batches, side: int) -> Iterator[tuple]:
    """(image, tx, ty, width, height, pixels as a matrix) of each row."""
    for batch in batches:
        numbers = zip(*(batch.column(c).to_pylist() for c in ("image", "tx", "ty", "width", "height")), strict=True)
        for k, (image, tx, ty, width, height) in enumerate(numbers):
            flat = batch.column("pixels")[k].values.to_numpy(zero_copy_only=False)
            yield image, tx, ty, width, height, flat.reshape(min(side, height - ty * side), min(side, width - tx * side))


def _fill(side: int):
    def run(batches):
        for part in (p for b in batches for p in _few(b, side)):
            places, values = part.column("at"), part.column("v").flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(part.column("n").to_numpy())])
            flat = np.zeros(first[-1])
            flat[np.repeat(first[:-1], np.diff(places.offsets)) + places.flatten().to_numpy()] = values
            pixels = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat))
            yield pa.record_batch([*(part.column(c) for c in ("image", "tx", "ty", "width", "height")), pixels], schema=_kinds(TILES))

    return run


def cut(pixels: DataFrame, side: int) -> DataFrame:
    """pixels(image, x, y, v, width, height) to all tiles of their images. Pixels that no row gives are 0; those outside the image are left out. Of repeated ones the largest counts."""
    long = lambda c: F.col(c).cast("long").alias(c)
    inside = pixels.where("x >= 0 AND y >= 0 AND x < width AND y < height")
    tx, ty = (F.floor(F.col(c) / side).alias(f"t{c}") for c in "xy")
    found = inside.groupBy(long("image"), tx, ty).agg(F.array_sort(F.collect_list(F.struct(long("y"), long("x"), F.col("v").cast("double").alias("v")))).alias("found"))
    sizes = pixels.groupBy(long("image")).agg(F.max(long("width")).alias("width"), F.max(long("height")).alias("height"))
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / side) - 1)
    grid = sizes.select("*", F.explode(count("width")).alias("tx")).select("*", F.explode(count("height")).alias("ty"))
    grouped = grid.join(found, ["image", "tx", "ty"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<y:bigint,x:bigint,v:double>>")))
    w, h = F.least(F.lit(side), F.col("width") - F.col("tx") * side), F.least(F.lit(side), F.col("height") - F.col("ty") * side)
    at = F.transform("found", lambda p: ((p["y"] - F.col("ty") * side) * w + p["x"] - F.col("tx") * side).cast("int"))
    placed = grouped.select("image", "tx", "ty", "width", "height", (w * h).alias("n"), at.alias("at"), F.col("found.v").alias("v"))
    return placed.mapInArrow(_fill(side), TILES)


def spread(tiles: DataFrame, side: int) -> DataFrame:
    """Tiles back to pixels(image, x, y, v)."""
    w = F.least(F.lit(side), F.col("width") - F.col("tx") * side)
    each = tiles.select("image", "tx", "ty", w.alias("w"), F.posexplode("pixels").alias("p", "v"))
    return each.select("image", (F.col("tx") * side + F.col("p") % F.col("w")).alias("x"), (F.col("ty") * side + F.floor(F.col("p") / F.col("w"))).alias("y"), "v")


def _reached(at: int, n: int, side: int, whole: int, margin: int, wrap: bool) -> list[tuple[int, int, int]]:
    """Along one axis: (tile, first position in that tile's frame, first source position, length) of what n pixels from `at` on give to each tile and its margin."""
    out, last = [], -(-whole // side) - 1
    turns = range(-(-(-margin // whole)) - 1, -(-margin // whole) + 2) if wrap else (0,)
    for shift in (t * whole for t in turns):
        lo, hi = at + shift, at + shift + n
        for t in range(max(0, (lo - margin) // side), min(last, (hi - 1 + margin) // side) + 1):
            a, b = max(lo, t * side - margin), min(hi, min((t + 1) * side, whole) + margin)
            if a < b:
                out.append((t, a, a - shift, b - a))
    return out


def _send(side: int, margin: int, wrap: bool):
    def run(batches):
        rows, size = [], 0
        for image, tx, ty, width, height, tile in _tiles_of(batches, side):
            for uy, y, from_y, h in _reached(ty * side, tile.shape[0], side, height, margin, wrap):
                for ux, x, from_x, w in _reached(tx * side, tile.shape[1], side, width, margin, wrap):
                    part = tile[from_y - ty * side : from_y - ty * side + h, from_x - tx * side : from_x - tx * side + w]
                    rows.append((image, ux, uy, width, height, part.ravel(), x, y, w, h))
                    size += part.size
            if size > PART:
                yield _batch(rows, _STRIPS)
                rows, size = [], 0
        yield _batch(rows, _STRIPS)

    return run


def _source(at: np.ndarray, n: int, edge: str) -> np.ndarray:
    if edge == "clamp":
        return np.clip(at, 0, n - 1)
    if edge == "mirror":  # the edge pixel repeated, of period 2n
        m = at % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m)
    return at  # wrapped strips came from the other side; beyond "zero" edges nothing came


def _receive(side: int, margin: int, edge: str, kernel: Kernel):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        image, tx, ty, width, height = (rows[0][c] for c in ("image", "tx", "ty", "width", "height"))
        x0, y0, w, h = tx * side, ty * side, min(side, width - tx * side), min(side, height - ty * side)
        canvas = np.zeros((h + 2 * margin, w + 2 * margin))
        for r in rows:
            top, left = r["y0"] - y0 + margin, r["x0"] - x0 + margin
            canvas[top : top + r["h"], left : left + r["w"]] = np.reshape(r["pixels"], (r["h"], r["w"]))
        if edge in ("clamp", "mirror"):
            ys = _source(np.arange(y0 - margin, y0 + h + margin), height, edge) - y0 + margin
            xs = _source(np.arange(x0 - margin, x0 + w + margin), width, edge) - x0 + margin
            canvas = canvas[np.ix_(ys, xs)]
        out = kernel(canvas, margin, x0, y0)
        return pa.Table.from_batches([_batch([(image, tx, ty, width, height, np.ascontiguousarray(out, np.float64).ravel())], TILES)])

    return run


def filtered(tiles: DataFrame, side: int, margin: int, kernel: Kernel, edge: str = "clamp") -> DataFrame:
    """Tiles after a kernel that looks `margin` pixels around each. edge: clamp, mirror, wrap or zero.

    A margin may be wider than a tile; a mirrored one may not be wider than the image. Each tile is shuffled once, with strips of its border.
    """
    sent = tiles.select("image", "tx", "ty", "width", "height", "pixels").mapInArrow(_send(side, margin, edge == "wrap"), _STRIPS)
    return sent.groupBy("image", "tx", "ty").applyInArrow(_receive(side, margin, edge, kernel), TILES)


def _windows(canvas: np.ndarray, margin: int, radius: int) -> np.ndarray:
    """(height, width, 2 radius + 1, 2 radius + 1): each pixel's square."""
    inner = canvas[margin - radius : canvas.shape[0] - margin + radius, margin - radius : canvas.shape[1] - margin + radius]
    return sliding_window_view(inner, (2 * radius + 1, 2 * radius + 1))


def _own(canvas: np.ndarray, margin: int) -> np.ndarray:
    return canvas[margin : canvas.shape[0] - margin, margin : canvas.shape[1] - margin]


def box_total(radius: int) -> Kernel:
    """Sums of the square, from a table of sums."""

    def run(canvas, margin, x0, y0):
        s = np.pad(canvas, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        lo, n = margin - radius, 2 * radius + 1
        rows, cols = canvas.shape[0] - 2 * margin, canvas.shape[1] - 2 * margin
        block = lambda dy, dx: s[lo + dy : lo + dy + rows, lo + dx : lo + dx + cols]
        return block(n, n) - block(0, n) - block(n, 0) + block(0, 0)

    return run


def median(radius: int) -> Kernel:
    """The middle value of the square. Radius 1 removes specks."""

    def run(canvas, margin, x0, y0):
        w = _windows(canvas, margin, radius)
        return np.median(w.reshape(*w.shape[:2], -1), axis=2)

    return run


def gaussian(sigma: float) -> Kernel:
    """Separable weights of radius ceil(3 sigma); what they lack to 1 goes to the centre."""

    def run(canvas, margin, x0, y0):
        r = int(np.ceil(3 * sigma))
        k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
        k /= k.sum()
        k[r] += 1 - k.sum()
        inner = canvas[margin - r : canvas.shape[0] - margin + r, margin - r : canvas.shape[1] - margin + r]
        return sliding_window_view(sliding_window_view(inner, 2 * r + 1, axis=0) @ k, 2 * r + 1, axis=1) @ k

    return run


def sobel(canvas, margin, x0, y0):
    """Squared gradient."""
    w = _windows(canvas, margin, 1)
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    return (w * k).sum((2, 3)) ** 2 + (w * k.T).sum((2, 3)) ** 2


def medoid(canvas, margin, x0, y0):
    """Of the 3 x 3 square the member nearest to all others; ties go to the centre, then in reading order."""
    w = _windows(canvas, margin, 1)
    w = w.reshape(*w.shape[:2], 9)[..., [4, 0, 1, 2, 3, 5, 6, 7, 8]]
    cost = np.abs(w[..., :, None] - w[..., None, :]).sum(-1)
    return np.take_along_axis(w, cost.argmin(-1)[..., None], -1)[..., 0]


def diffused(radius: int, seed: int, mode: str = "normal") -> Kernel:
    """Each pixel takes a neighbour that the seed and its place draw; mode: normal, or only a darker or a lighter one."""

    def run(canvas, margin, x0, y0):
        own = _own(canvas, margin)
        y, x = np.mgrid[0 : own.shape[0], 0 : own.shape[1]]
        span = np.float32(2 * radius + 1)
        ox, oy = ((hash_unit_grid(s, x + x0, y + y0) * span).astype(np.int64) - radius for s in (seed, seed ^ SECOND_DIFFUSE))
        # the product may round up to the span itself, one more than the radius; margins allow for it
        found = canvas[y + oy + margin, x + ox + margin]
        return found if mode == "normal" else np.where(found < own if mode == "darken" else found > own, found, own)

    return run


def disc_smooth(radius: int) -> Kernel:
    """A selection (0..255) with its corners rounded: the mean under a disc, pushed through a curve that leaves straight edges where they are."""

    def run(canvas, margin, x0, y0):
        half = [int(np.floor(np.sqrt(radius * radius - d * d))) for d in range(-radius, radius + 1)]
        rows, cols = canvas.shape[0] - 2 * margin, canvas.shape[1] - 2 * margin
        sums, total = np.pad(canvas, ((0, 0), (1, 0))).cumsum(1), 0.0
        for d, dx in zip(range(-radius, radius + 1), half, strict=True):
            line = sums[margin + d : margin + d + rows]
            total = total + line[:, margin + dx + 1 : margin + dx + 1 + cols] - line[:, margin - dx : margin - dx + cols]
        area = sum(2 * d + 1 for d in half)
        s = np.clip((total / (255 * area) - 0.5) * (2.5 * area / (2 * radius + 1)) + 0.5, 0, 1)
        return np.floor(s * s * (3 - 2 * s) * 255 + 0.5)

    return run


def clouds(seed: int, scale: float, octaves: int = 4, persistence: float = 0.5, against: bool = False) -> Kernel:
    """Fractal noise in [0, 1] of the place alone, or, with against, how far the image's codes as parts of 255 are from it; it needs no margin."""

    def run(canvas, margin, x0, y0):
        own = _own(canvas, margin)
        y, x = np.mgrid[0 : own.shape[0], 0 : own.shape[1]]
        field = 0.5 * (clouds_grid(seed, (x + x0 + 0.5) / scale, (y + y0 + 0.5) / scale, octaves, persistence) + 1)
        return np.abs(own / 255 - field) if against else field

    return run


def shifted_cells(pixels: DataFrame, count: int, percent: float, seed: int, gap: Callable[[Column], Column]) -> DataFrame:
    """pixels(image, x, y, v, width, height) to (image, x, y, v): the image in square cells, `count` across its shorter side, each moved by a seeded offset.

    An offset is at most `percent` of a cell's side and at least a pixel. Of cells that overlap the later one in reading
    order shows; gap gives what shows where none does, from the pixel itself. Every pixel goes to its new place once.
    """
    side = F.ceil(F.least("width", "height") / F.lit(count))
    tx, ty = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    single = lambda c: c.cast("float")  # noqa: E731  offsets are of 32-bit floats

    def offset(of: int) -> Column:
        reach = single(F.lit(percent)) / single(F.lit(100.0)) * single(F.col("side"))
        a = (single(hash_unit(of, F.col("tx"), F.col("ty"))) * single(F.lit(2.0)) - single(F.lit(1.0))) * reach
        whole = F.round(a).cast("long")
        return F.when(whole != 0, whole).otherwise(F.when(a < 0, -1).otherwise(1))

    celled = pixels.select("image", "x", "y", "v", "width", "height", side.alias("side"), tx.alias("tx"), ty.alias("ty"))
    moved = celled.select("image", (F.col("x") + offset(seed)).alias("x"), (F.col("y") + offset(seed ^ SECOND_TILES)).alias("y"), "v", "width", "height", F.struct("ty", "tx").alias("cell"))
    under = pixels.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), gap(F.col("v")).alias("v"), "width", "height", F.struct(F.lit(-1).cast("long").alias("ty"), F.lit(-1).cast("long").alias("tx")).alias("cell"))
    shown = moved.where("x >= 0 AND y >= 0 AND x < width AND y < height").union(under)
    return shown.groupBy("image", "x", "y").agg(F.max_by("v", "cell").alias("v"))
