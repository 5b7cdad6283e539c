"""Neighbourhood operators on images held as arrays: each output pixel is an expression over its neighbours, so no pixel is shuffled.

An image is one row; a larger one is cut into tiles that carry a margin of their neighbours' pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbrafold.functions.binding import bound

Edge = Callable[[Column, int], Column]


def clamp(k: Column, n: int) -> Column:
    return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1))


def wrap(k: Column, n: int) -> Column:
    return F.pmod(k, F.lit(n))


def mirror(k: Column, n: int) -> Column:
    """Reflected with the edge pixel repeated, of period 2n."""
    m = F.pmod(k, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def at(image: Column, x: Column, y: Column, width: int, height: int, edge: Edge = clamp) -> Column:
    return F.get(image, (edge(y, height) * width + edge(x, width)).cast("int"))


def each_pixel(width: int, height: int, body: Callable[[Column, Column], Column]) -> Column:
    """Array of body(x, y) over the image."""
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda p: body(p % width, F.floor(p / width).cast("int")))


def gathered(image: Column, offsets: list[tuple[int, int]], width: int, height: int, body: Callable[[Column], Column], edge: Edge = clamp) -> Column:
    """body over the array of each pixel's neighbours at the offsets."""
    return bound(image, lambda img: each_pixel(width, height, lambda x, y: body(F.array(*[at(img, x + dx, y + dy, width, height, edge) for dx, dy in offsets]))))


def square(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def line(radius: int, vertical: bool = False) -> list[tuple[int, int]]:
    return [(0, k) if vertical else (k, 0) for k in range(-radius, radius + 1)]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda t, v: t + v)


def box_sum(image: Column, radius: int, width: int, height: int, edge: Edge = clamp) -> Column:
    """Sums of the square, by two passes over lines."""
    rows = gathered(image, line(radius), width, height, total, edge)
    return gathered(rows, line(radius, True), width, height, total, edge)


def minimum(image: Column, radius: int, width: int, height: int) -> Column:
    return gathered(gathered(image, line(radius), width, height, F.array_min), line(radius, True), width, height, F.array_min)


def maximum(image: Column, radius: int, width: int, height: int) -> Column:
    return gathered(gathered(image, line(radius), width, height, F.array_max), line(radius, True), width, height, F.array_max)


def median(image: Column, radius: int, width: int, height: int) -> Column:
    middle = (2 * radius + 1) ** 2 // 2
    return gathered(image, square(radius), width, height, lambda v: F.get(F.sort_array(v), F.lit(middle)))


def weighted(image: Column, kernel: dict[tuple[int, int], float], width: int, height: int, edge: Edge = clamp) -> Column:
    """Sums of neighbours times the kernel's weights, of its kind (whole or floating numbers)."""
    return bound(image, lambda img: each_pixel(width, height, lambda x, y: sum((w * at(img, x + dx, y + dy, width, height, edge) for (dx, dy), w in kernel.items()), F.lit(0))))


def gaussian_kernel(sigma: float) -> dict[tuple[int, int], float]:
    """Separable weights of radius ceil(3 sigma); what they lack to 1 goes to the centre."""
    import math

    r = math.ceil(3 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    w = [v / sum(raw) for v in raw]
    w[r] += 1 - sum(w)
    return {(dx, dy): w[dx + r] * w[dy + r] for dy in range(-r, r + 1) for dx in range(-r, r + 1)}


def remapped(image: Column, width: int, height: int, source: Callable[[Column, Column], tuple[Column, Column]], edge: Edge = clamp) -> Column:
    """Each pixel takes the one at source(x, y): flips, shifts, shears, tilings."""
    return bound(image, lambda img: each_pixel(width, height, lambda x, y: at(img, *source(x, y), width, height, edge)))


# 3 x 3 kernels.
SOBEL_X = {(-1, -1): -1, (1, -1): 1, (-1, 0): -2, (1, 0): 2, (-1, 1): -1, (1, 1): 1}
SOBEL_Y = {(-1, -1): -1, (0, -1): -2, (1, -1): -1, (-1, 1): 1, (0, 1): 2, (1, 1): 1}
BINOMIAL = {(dx, dy): (2 - abs(dx)) * (2 - abs(dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
SHARPEN = {(0, 0): 5, (-1, 0): -1, (1, 0): -1, (0, -1): -1, (0, 1): -1}
EMBOSS = {(-1, -1): 1, (1, 1): -1}
LAPLACE = {(0, 0): -4, (-1, 0): 1, (1, 0): 1, (0, -1): 1, (0, 1): 1}
