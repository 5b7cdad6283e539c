"""Layer effects that trace a layer's outline, as kernels on tiles with a margin: stroke, outer and inner glow.

The outline is a signed distance, negative inside, from a pixel's centre to the nearest one of the other side, by steps to
eight neighbours of length 1 and the square root of 2, less the half pixel between a centre and the edge; where the
layer's coverage is fractional on the edge itself, the coverage places it. Distances count up to the margin, which `margin`
makes wide enough for an effect's size. Coverage is 0..255; outside the image nothing is covered, so edges are "zero".
"""

from __future__ import annotations

import math

import numpy as np

from umbrafold.operators.tiles import Kernel

FAR = 1e9


def margin(size: float, spread: float = 0.0) -> int:
    return math.ceil(size * (1 + spread)) + 2


def _steps(target: np.ndarray, reach: int) -> np.ndarray:
    """Length of the shortest way to a target pixel, exact up to `reach`; each round goes one pixel further."""
    d = np.where(target, 0.0, FAR)
    for _ in range(reach):
        p = np.pad(d, 1, constant_values=FAR)
        rows, cols = d.shape
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    d = np.minimum(d, p[1 + dy : 1 + dy + rows, 1 + dx : 1 + dx + cols] + math.hypot(dx, dy))
    return d


def signed_distance(coverage: np.ndarray, reach: int) -> np.ndarray:
    inside = coverage >= 0.5
    d = np.where(inside, 0.5 - _steps(~inside, reach), _steps(inside, reach) - 0.5)
    return np.where((np.abs(d) <= 0.5) & (coverage > 0) & (coverage < 1), 0.5 - coverage, d)


def _own(canvas: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(coverage, signed distance) of the tile itself."""
    coverage = canvas / 255
    cut = lambda a: a[m : a.shape[0] - m, m : a.shape[1] - m]
    return cut(coverage), cut(signed_distance(coverage, m))


def grown(distance: np.ndarray, by: float) -> np.ndarray:
    """Coverage of the outline moved outwards by so many pixels."""
    return np.clip(0.5 + by - distance, 0, 1)


def stroke(width: float, position: str = "outside", opacity: float = 1.0) -> Kernel:
    """A band along the outline; position: outside, inside or center."""
    inner, outer = {"outside": (0.0, width), "inside": (-width, 0.0), "center": (-width / 2, width / 2)}[position]

    def run(canvas, m, x0, y0):
        _, d = _own(canvas, m)
        return np.clip(grown(d, outer) - grown(d, inner), 0, 1) * opacity

    return run


def glow(size: float, spread: float = 0.0, part: float = 1.0, opacity: float = 1.0, inner: bool = False) -> Kernel:
    """A falloff by distance from the outline, outwards or, inside the layer's coverage, inwards; part is the share of the falloff that is used."""
    spread, reach, low = min(spread, 0.95), max(size, 1.0), 1 - max(part, 0.01)

    def run(canvas, m, x0, y0):
        coverage, d = _own(canvas, m)
        f = np.clip(1 - ((-d if inner else d) - size * spread) / reach, 0, 1)
        if low > 0:
            f = np.clip((f - low) / (1 - low), 0, 1)
        return f * opacity * (coverage if inner else 1)

    return run
