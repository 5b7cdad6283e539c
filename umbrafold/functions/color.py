"""Colour arithmetic as Column functions on doubles in 0..1, from published definitions (sRGB, Rec. 601/709, CIE Lab, HSL, HSV)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]


def unit(x: Column) -> Column:
    """Clamped to 0..1; not-a-number and infinities become 0."""
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def srgb_decode(c: Column) -> Column:
    """Encoded to linear; odd about zero, not clamped."""
    curve = F.signum(c) * F.pow((F.abs(c) + 0.055) / 1.055, F.lit(2.4))
    return F.when(F.abs(c) <= 0.04045, c / 12.92).otherwise(curve)


def srgb_encode(v: Column) -> Column:
    curve = F.signum(v) * (1.055 * F.pow(F.abs(v), F.lit(1 / 2.4)) - 0.055)
    return F.when(F.abs(v) <= 0.0031308, v * 12.92).otherwise(curve)


def luminance(rgb: Rgb) -> Column:
    return 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]


def luma601(rgb: Rgb) -> Column:
    return 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]


def premultiply(rgb: Rgb, a: Column) -> Rgb:
    return tuple(c * a for c in rgb)


def unpremultiply(rgb: Rgb, a: Column, least: float = 1e-6) -> Rgb:
    return tuple(F.when(a <= least, 0.0).otherwise(c / F.when(a <= least, 1.0).otherwise(a)) for c in rgb)


def _hue(rgb: Rgb, top: Column, chroma: Column) -> Column:
    r, g, b = rgb
    safe = F.when(chroma == 0, 1.0).otherwise(chroma)
    turn = F.when(top == r, (g - b) / safe).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6
    return F.when(chroma == 0, 0.0).otherwise(turn - F.floor(turn))


def rgb_to_hsl(rgb: Rgb) -> Rgb:
    """Hue as a turn in 0..1 (0 without chroma), saturation, lightness."""
    top, low = F.greatest(*rgb), F.least(*rgb)
    chroma, light = top - low, (top + low) / 2
    room = 1 - F.abs(2 * light - 1)
    return _hue(rgb, top, chroma), F.when((chroma == 0) | (room == 0), 0.0).otherwise(chroma / F.when(room == 0, 1.0).otherwise(room)), light


def hsl_to_rgb(hsl: Rgb) -> Rgb:
    h, s, light = hsl
    chroma = (1 - F.abs(2 * light - 1)) * s

    def channel(shift: float) -> Column:
        x = h * 6 + shift
        k = x - F.floor(x / 6) * 6
        return light + chroma * (F.least(F.greatest(F.abs(k - 3) - 1, F.lit(0.0)), F.lit(1.0)) - 0.5)

    return channel(0.0), channel(4.0), channel(2.0)


def rgb_to_hsv(rgb: Rgb) -> Rgb:
    top, low = F.greatest(*rgb), F.least(*rgb)
    chroma = top - low
    return _hue(rgb, top, chroma), F.when(top == 0, 0.0).otherwise(chroma / F.when(top == 0, 1.0).otherwise(top)), top


# Linear sRGB to CIE XYZ at D65, and the white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def linear_to_xyz(rgb: Rgb) -> Rgb:
    return tuple(m[0] * rgb[0] + m[1] * rgb[1] + m[2] * rgb[2] for m in TO_XYZ)


def rgb_to_lab(encoded: Rgb) -> Rgb:
    def f(t: Column) -> Column:
        return F.when(t > 216 / 24389, F.pow(t, F.lit(1 / 3))).otherwise((24389 / 27 * t + 16) / 116)

    x, y, z = (f(c / w) for c, w in zip(linear_to_xyz(tuple(srgb_decode(c) for c in encoded)), WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def remove_matte(c: Column, a: Column, matte: float) -> Column:
    """Undo a matte that was composed under a partly transparent channel."""
    safe = F.when(a <= 0, 1.0).otherwise(a)
    return F.when(a <= 0, 0.0).otherwise(unit((c - matte * (1 - a)) / safe))


def color_to_alpha(rgb: Rgb, color: tuple[float, float, float]) -> Column:
    """The least alpha with which the pixel can be a colour in range over `color`."""

    def need(c: Column, k: float) -> Column:
        above = (c - k) / (1 - k) if k < 1 else F.lit(0.0)
        below = (k - c) / k if k > 0 else F.lit(0.0)
        return F.when(c > k, above).otherwise(below)

    return unit(F.greatest(*[need(c, k) for c, k in zip(rgb, color, strict=True)]))


def widen(code: Column) -> Column:
    """8 to 16 bits."""
    return code * 257


def narrow(code: Column) -> Column:
    """16 to 8 bits, rounded."""
    return F.floor((code + 128) / 257).cast("int")


def color_ranges(c: Rgb) -> tuple[Column, ...]:
    """Shares of red, yellow, green, cyan, blue, magenta, whites, neutrals and blacks in a colour of 0..1; they sum to 1.

    What one channel has above both others is its primary's, what two have above the third their mixture's.
    """
    r, g, b = c
    above = lambda x, y: F.greatest(x - y, F.lit(0.0))
    top, low = F.greatest(*c), F.least(*c)
    grey = 1 - (top - low)
    whites, blacks = grey * F.greatest(2 * low - 1, F.lit(0.0)), grey * F.greatest(1 - 2 * top, F.lit(0.0))
    return above(r, F.greatest(g, b)), above(F.least(r, g), b), above(g, F.greatest(r, b)), above(F.least(g, b), r), above(b, F.greatest(r, g)), above(F.least(r, b), g), whites, grey - whites - blacks, blacks


def black_and_white(c: Rgb, weights: tuple[float, ...]) -> Column:
    """Grey by the weights of the six hues: what is common to all channels counts whole."""
    return F.least(*c) + sum((share * w for share, w in zip(color_ranges(c), weights, strict=False)), F.lit(0.0))


def selective_color(c: Rgb, inks: list[tuple[float, float, float, float]], relative: bool = True) -> Rgb:
    """The colour's cyan, magenta, yellow and black changed by its ranges' deltas, of what there is or of the whole; what exceeds 1 is kept aside."""
    base = tuple(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in c)
    shares = color_ranges(base)
    delta = [sum((share * row[k] for share, row in zip(shares, inks, strict=True)), F.lit(0.0)) for k in range(4)]
    light = F.greatest(*base)
    parts = [F.when(light > 0, 1 - v / F.when(light > 0, light).otherwise(1.0)).otherwise(0.0) for v in base] + [1 - light]
    moved = [F.least(F.greatest(v + (v * d if relative else d), F.lit(0.0)), F.lit(1.0)) for v, d in zip(parts, delta, strict=True)]
    return tuple((1 - m) * (1 - moved[3]) + (v - u) for m, v, u in zip(moved, c, base, strict=False))
