"""Blend modes as Column functions of backdrop b and source s, from the published compositing formulas. Inputs and results lie in 0..1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbrafold.functions.binding import stepwise
from umbrafold.functions.color import Rgb, unit


def _burn(b: Column, s: Column) -> Column:
    return F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - b) / F.when(s <= 0, 1.0).otherwise(s)))


def _dodge(b: Column, s: Column) -> Column:
    return F.when(b <= 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), b / F.when(s >= 1, 1.0).otherwise(1 - s)))


def _screen(b: Column, s: Column) -> Column:
    return b + s - b * s


def _hard_light(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, 2 * b * s).otherwise(_screen(b, 2 * s - 1))


def _soft_light(b: Column, s: Column) -> Column:
    d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    return F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (d - b))


SEPARABLE: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda b, s: s,
    "darken": F.least,
    "multiply": lambda b, s: b * s,
    "color_burn": _burn,
    "linear_burn": lambda b, s: b + s - 1,
    "lighten": F.greatest,
    "screen": _screen,
    "color_dodge": _dodge,
    "linear_dodge": lambda b, s: b + s,
    "overlay": lambda b, s: _hard_light(s, b),
    "soft_light": _soft_light,
    "hard_light": _hard_light,
    "vivid_light": lambda b, s: F.when(s <= 0.5, _burn(b, 2 * s)).otherwise(_dodge(b, 2 * s - 1)),
    "linear_light": lambda b, s: b + 2 * s - 1,
    "pin_light": lambda b, s: F.when(s <= 0.5, F.least(b, 2 * s)).otherwise(F.greatest(b, 2 * s - 1)),
    "hard_mix": lambda b, s: F.when(b + s >= 1, 1.0).otherwise(0.0),
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - 2 * b * s,
    "subtract": lambda b, s: b - s,
    "divide": lambda b, s: F.when(s <= 0, 1.0).otherwise(b / F.when(s <= 0, 1.0).otherwise(s)),
}


def blend_channel(mode: str, b: Column, s: Column) -> Column:
    return unit(SEPARABLE[mode](b, s))


def lum(c: Rgb) -> Column:
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def sat(c: Rgb) -> Column:
    return F.greatest(*c) - F.least(*c)


def _clip(c: Rgb) -> Rgb:
    y, low, top = lum(c), F.least(*c), F.greatest(*c)
    up = [F.when(low < 0, y + (v - y) * y / F.when(low < 0, y - low).otherwise(1.0)).otherwise(v) for v in c]
    return tuple(F.when(top > 1, y + (v - y) * (1 - y) / F.when(top > 1, top - y).otherwise(1.0)).otherwise(v) for v in up)


def set_lum(c: Rgb, y: Column) -> Rgb:
    d = y - lum(c)
    return tuple(v + d for v in c)


def set_sat(c: Rgb, s: Column) -> Rgb:
    low, span = F.least(*c), sat(c)
    return tuple(F.when(span > 0, (v - low) * s / F.when(span > 0, span).otherwise(1.0)).otherwise(0.0) for v in c)


#: The steps of a whole-colour mode, from the backdrop's and the source's channels.
WHOLE: dict[str, tuple[Callable[[tuple[Column, ...]], tuple[Column, ...]], ...]] = {
    "darker_color": (lambda v: tuple(F.when(lum(v[3:]) < lum(v[:3]), y).otherwise(x) for x, y in zip(v[:3], v[3:], strict=True)),),
    "lighter_color": (lambda v: tuple(F.when(lum(v[3:]) > lum(v[:3]), y).otherwise(x) for x, y in zip(v[:3], v[3:], strict=True)),),
    "hue": (lambda v: (*set_sat(v[3:], sat(v[:3])), lum(v[:3])), lambda v: set_lum(v[:3], v[3]), _clip),
    "saturation": (lambda v: (*set_sat(v[:3], sat(v[3:])), lum(v[:3])), lambda v: set_lum(v[:3], v[3]), _clip),
    "color": (lambda v: set_lum(v[3:], lum(v[:3])), _clip),
    "luminosity": (lambda v: set_lum(v[:3], lum(v[3:])), _clip),
}


def blend_rgb(mode: str, b: Rgb, s: Rgb) -> Rgb:
    if mode in WHOLE:
        return stepwise((*b, *s), *WHOLE[mode], lambda v: tuple(unit(c) for c in v))
    return tuple(blend_channel(mode, x, y) for x, y in zip(b, s, strict=True))


def over(backdrop: tuple[Rgb, Column], source: tuple[Rgb, Column], mode: str = "normal") -> tuple[Rgb, Column]:
    """Source over backdrop; straight source colour and alpha, premultiplied backdrop and result."""
    (b, ab), (s, a) = backdrop, source
    plain = tuple(F.when(ab > 0, c / F.when(ab > 0, ab).otherwise(1.0)).otherwise(0.0) for c in b)
    mixed = [(1 - ab) * x + ab * y for x, y in zip(s, blend_rgb(mode, plain, s), strict=True)]
    return tuple(a * m + c * (1 - a) for m, c in zip(mixed, b, strict=True)), a + ab * (1 - a)


def atop(backdrop: tuple[Rgb, Column], source: tuple[Rgb, Column], mode: str = "normal") -> tuple[Rgb, Column]:
    """As over(), inside the backdrop's alpha."""
    (b, ab), (s, a) = backdrop, source
    plain = tuple(F.when(ab > 0, c / F.when(ab > 0, ab).otherwise(1.0)).otherwise(0.0) for c in b)
    return tuple(a * ab * y + c * (1 - a) for y, c in zip(blend_rgb(mode, plain, s), b, strict=True)), ab
