"""Tonal adjustments as Column functions on encoded values; masks mix them with the original."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbrafold.functions.color import Rgb, hsl_to_rgb, luma601, luminance, rgb_to_hsl, unit


def signed_pow(x: Column, p: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(p))


def brightness_contrast(v: Column, b: float, c: float) -> Column:
    slope = 1 / (1 - 0.99 * c) if c >= 0 else 1 + c
    return (v - 0.5) * slope + 0.5 + b


def levels(v: Column, in_black: float, in_white: float, gamma: float, out_black: float = 0.0, out_white: float = 1.0) -> Column:
    return out_black + signed_pow((v - in_black) / (in_white - in_black), 1 / gamma) * (out_white - out_black)


def exposure(linear: Column, stops: float, offset: float, gamma: float) -> Column:
    return signed_pow(linear * 2.0**stops + offset, 1 / gamma)


def invert(v: Column) -> Column:
    return 1 - v


def posterize(v: Column, n: int) -> Column:
    return F.floor(unit(v) * (n - 1) + 0.5) / (n - 1)


def threshold(rgb: Rgb, level: float) -> Column:
    return F.when(luma601(rgb) >= level, 1.0).otherwise(0.0)


def solarize(v: Column) -> Column:
    return F.when(v < 0.5, v).otherwise(1 - v)


def monotone_curve(v: Column, points: list[tuple[float, float]]) -> Column:
    """Monotone cubic through the points (Fritsch-Carlson); flat outside. Points of one x count by their mean y."""
    by_x: dict[float, list[float]] = {}
    for x, y in points:
        by_x.setdefault(x, []).append(y)
    xs = sorted(by_x)
    ys = [sum(by_x[x]) / len(by_x[x]) for x in xs]
    if len(xs) == 1:
        return F.lit(ys[0])
    slope = [(ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]) for k in range(len(xs) - 1)]
    m = [slope[0], *[0.0 if slope[k - 1] * slope[k] <= 0 else (slope[k - 1] + slope[k]) / 2 for k in range(1, len(slope))], slope[-1]]
    for k, d in enumerate(slope):
        if d == 0:
            m[k] = m[k + 1] = 0.0
        elif (size := ((m[k] / d) ** 2 + (m[k + 1] / d) ** 2) ** 0.5) > 3:
            m[k], m[k + 1] = 3 * m[k] / size, 3 * m[k + 1] / size
    out = F.when(v <= xs[0], ys[0])
    for k in range(len(slope)):
        h = xs[k + 1] - xs[k]
        t = (v - xs[k]) / h
        piece = ys[k] * (1 + 2 * t) * (1 - t) * (1 - t) + h * m[k] * t * (1 - t) * (1 - t) + ys[k + 1] * t * t * (3 - 2 * t) + h * m[k + 1] * t * t * (t - 1)
        out = out.when(v <= xs[k + 1], piece)
    return out.otherwise(ys[-1])


def vibrance(rgb: Rgb, amount: float, saturation: float) -> Rgb:
    h, s, light = rgb_to_hsl(rgb)
    return hsl_to_rgb((h, unit(s + saturation + amount * (1 - s)), light))


def hue_saturation(rgb: Rgb, turn: float, saturation: float, lightness: float) -> Rgb:
    h, s, light = rgb_to_hsl(rgb)
    h = h + turn
    return hsl_to_rgb((h - F.floor(h), unit(s * (1 + saturation)), unit(light + lightness)))


def channel_mixer(rgb: Rgb, rows: list[tuple[float, float, float, float]]) -> Rgb:
    return tuple(a * rgb[0] + b * rgb[1] + c * rgb[2] + d for a, b, c, d in rows)


def photo_filter(linear: Rgb, color: tuple[float, float, float], density: float) -> Rgb:
    return tuple(c * (1 + density * (k - 1)) for c, k in zip(linear, color, strict=True))


def desaturate(linear: Rgb) -> Rgb:
    y = luminance(linear)
    return y, y, y


def gradient_map(t: Column, stops: list[tuple[float, float]]) -> Column:
    """A channel of the colour at t between stops (place, value), flat outside."""
    out = F.when(t <= stops[0][0], stops[0][1])
    for (x0, y0), (x1, y1) in zip(stops, stops[1:], strict=False):
        out = out.when(t <= x1, y0 + (y1 - y0) * (t - x0) / (x1 - x0))
    return out.otherwise(stops[-1][1])


def masked(before: Column, after: Column, mask: Column) -> Column:
    return before + (after - before) * mask
