"""Pointwise queries over the raster views: colour, tone, blend modes and selections, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.functions import blend, color, tone
from umbrafold.sources.rasters import PX_SQL, RGB_SQL, pixels, rgb_pixels

QUERIES: dict = {}


def rounded(x: Column, digits: int = 9) -> Column:
    return F.round(x, digits) + 0.0


def _sql_rounded(x: str, digits: int = 9) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def grey(name: str, body, sql: str) -> None:
    """A query on the code (c) and its value in 0..1 (v); the result is out."""

    def run(spark, sf_dir: str) -> DataFrame:
        px = pixels(spark, sf_dir)
        return px.select("vec_id", "pos", rounded(body(F.col("code") / F.lit(255.0))).alias("out"))

    QUERIES[name] = (run, f"WITH {PX_SQL}, q AS (SELECT vec_id, pos, code, code / 255.0::DOUBLE AS v FROM px) SELECT vec_id, pos, {_sql_rounded(sql)} AS out FROM q")


def coloured(name: str, body, sqls: dict[str, str], before: str = "", digits: int = 9) -> None:
    """A query on r, g, b. before: further steps of the SQL, from rgb to a table t."""

    def run(spark, sf_dir: str) -> DataFrame:
        px = rgb_pixels(spark, sf_dir)
        out = body((F.col("r"), F.col("g"), F.col("b")))
        return px.select("vec_id", "pos", *[rounded(c, digits).alias(k) for k, c in zip(sqls, out, strict=True)])

    columns = ", ".join(f"{_sql_rounded(x, digits)} AS {k}" for k, x in sqls.items())
    QUERIES[name] = (run, f"WITH {RGB_SQL}{before or ', t AS (SELECT * FROM rgb)'} SELECT vec_id, pos, {columns} FROM t")


DECODE = "CASE WHEN abs({0}) <= 0.04045 THEN {0} / 12.92 ELSE sign({0}) * pow((abs({0}) + 0.055) / 1.055, 2.4) END"
ENCODE = "CASE WHEN abs({0}) <= 0.0031308 THEN {0} * 12.92 ELSE sign({0}) * (1.055 * pow(abs({0}), 1 / 2.4) - 0.055) END"
UNIT = "least(greatest({0}, 0.0), 1.0)"

grey("invert", tone.invert, "1 - v")
grey("brightness_contrast", lambda v: tone.brightness_contrast(v, 0.1, 0.25), "(v - 0.5) * (1 / (1 - 0.99 * 0.25)) + 0.5 + 0.1")
grey("brightness_contrast_flat", lambda v: tone.brightness_contrast(v, -0.05, -0.4), "(v - 0.5) * 0.6 + 0.5 - 0.05")
grey("levels", lambda v: tone.levels(v, 0.1, 0.9, 1.4, 0.05, 0.95), "0.05 + sign((v - 0.1) / 0.8) * pow(abs((v - 0.1) / 0.8), 1 / 1.4) * 0.9")
grey("exposure", lambda v: tone.exposure(v, 0.5, -0.02, 1.2), "sign(v * sqrt(2.0) - 0.02) * pow(abs(v * sqrt(2.0) - 0.02), 1 / 1.2)")
grey("posterize", lambda v: tone.posterize(v, 6), "floor(v * 5 + 0.5) / 5")
grey("solarize", tone.solarize, "CASE WHEN v < 0.5 THEN v ELSE 1 - v END")
grey("srgb_to_linear", color.srgb_decode, DECODE.format("v"))
grey("linear_to_srgb", color.srgb_encode, ENCODE.format("v"))
grey("gradient_map", lambda v: tone.gradient_map(v, [(0.2, 0.0), (0.5, 0.8), (0.9, 1.0)]), "CASE WHEN v <= 0.2 THEN 0.0 WHEN v <= 0.5 THEN 0.8 * (v - 0.2) / 0.3 WHEN v <= 0.9 THEN 0.8 + 0.2 * (v - 0.5) / 0.4 ELSE 1.0 END")
grey("widen_narrow", lambda v: color.narrow(color.widen(F.round(v * 255).cast("int"))).cast("double"), "floor((round(v * 255) * 257 + 128) / 257)")
grey("mask_mix", lambda v: tone.masked(v, tone.invert(v), F.lit(0.25)), "v + (1 - 2 * v) * 0.25")
grey("curve", lambda v: tone.monotone_curve(v, [(0.0, 0.0), (0.5, 0.7), (1.0, 1.0)]), "CASE WHEN v <= 0 THEN 0.0 WHEN v <= 0.5 THEN 0.5 * 1.4 * (v * 2) * pow(1 - v * 2, 2) + 0.7 * pow(v * 2, 2) * (3 - 4 * v) + 0.5 * 1.0 * pow(v * 2, 2) * (v * 2 - 1) ELSE 0.7 * (1 + 2 * (v * 2 - 1)) * pow(2 - 2 * v, 2) + 0.5 * 1.0 * (v * 2 - 1) * pow(2 - 2 * v, 2) + 1.0 * pow(v * 2 - 1, 2) * (3 - 2 * (v * 2 - 1)) + 0.5 * 0.6 * pow(v * 2 - 1, 2) * (v * 2 - 2) END")
grey("remove_matte", lambda v: color.remove_matte(v, F.lit(0.8), 1.0), UNIT.format("(v - 0.2) / 0.8"))

coloured("luminance", lambda c: (color.luminance(c),), {"y": "0.2126 * r + 0.7152 * g + 0.0722 * b"})
coloured("luma_threshold", lambda c: (tone.threshold(c, 0.5),), {"out": "CASE WHEN 0.299 * r + 0.587 * g + 0.114 * b >= 0.5 THEN 1 ELSE 0 END"})
coloured("desaturate", tone.desaturate, {k: "0.2126 * r + 0.7152 * g + 0.0722 * b" for k in "rgb"})
coloured("channel_mixer", lambda c: tone.channel_mixer(c, [(0.5, 0.3, 0.2, 0.0), (0.1, 0.8, 0.1, 0.05), (0.0, 0.4, 0.6, -0.05)]), {"r": "0.5 * r + 0.3 * g + 0.2 * b", "g": "0.1 * r + 0.8 * g + 0.1 * b + 0.05", "b": "0.4 * g + 0.6 * b - 0.05"})
coloured("photo_filter", lambda c: tone.photo_filter(c, (0.9, 0.5, 0.1), 0.25), {"r": "r * 0.975", "g": "g * 0.875", "b": "b * 0.775"})
coloured("premultiply", lambda c: color.premultiply(c[:2], c[2]), {"r": "r * b", "g": "g * b"})
coloured("unpremultiply", lambda c: color.unpremultiply(c[:2], c[2]), {"r": "CASE WHEN b <= 1e-6 THEN 0 ELSE r / b END", "g": "CASE WHEN b <= 1e-6 THEN 0 ELSE g / b END"})
coloured("linear_xyz", color.linear_to_xyz, {"x": "0.4124564 * r + 0.3575761 * g + 0.1804375 * b", "y": "0.2126729 * r + 0.7151522 * g + 0.0721750 * b", "z": "0.0193339 * r + 0.1191920 * g + 0.9503041 * b"})

HUE = "CASE WHEN top = low THEN 0.0 ELSE ({0}) - floor({0}) END".format("(CASE WHEN top = r THEN (g - b) / (top - low) WHEN top = g THEN (b - r) / (top - low) + 2 ELSE (r - g) / (top - low) + 4 END) / 6")
TOPLOW = ", t AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM rgb)"
HSL = {"h": HUE, "s": "CASE WHEN top = low OR 1 - abs(top + low - 1) = 0 THEN 0 ELSE (top - low) / (1 - abs(top + low - 1)) END", "l": "(top + low) / 2"}
coloured("rgb_to_hsl", color.rgb_to_hsl, HSL, TOPLOW)
coloured("rgb_to_hsv", color.rgb_to_hsv, {"h": HUE, "s": "CASE WHEN top = 0 THEN 0 ELSE (top - low) / top END", "v": "top"}, TOPLOW)
coloured("hsl_round_trip", lambda c: color.hsl_to_rgb(color.rgb_to_hsl(c)), {"r": "r", "g": "g", "b": "b"})


def _back(h: str, s: str, light: str) -> dict[str, str]:
    k = f"(({h}) * 6 + {{0}} - floor((({h}) * 6 + {{0}}) / 6) * 6)"
    one = f"({light}) + (1 - abs(2 * ({light}) - 1)) * ({s}) * (least(greatest(abs({k} - 3) - 1, 0.0), 1.0) - 0.5)"
    return {"r": one.format(0), "g": one.format(4), "b": one.format(2)}


_HSL_STEP = f"{TOPLOW}, u AS (SELECT *, {HSL['h']} AS h, {HSL['s']} AS s, {HSL['l']} AS l FROM t), t2 AS (SELECT * FROM u)".replace("t2 AS (SELECT * FROM u)", "w AS (SELECT * FROM u)")


def _hsl_query(name: str, body, h: str, s: str, light: str) -> None:
    coloured(name, body, _back(h, s, light), _HSL_STEP)
    run, sql = QUERIES[name]
    QUERIES[name] = (run, sql.removesuffix("FROM t") + "FROM w")


_hsl_query("vibrance", lambda c: tone.vibrance(c, 0.3, 0.1), "h", "least(greatest(s + 0.1 + 0.3 * (1 - s), 0.0), 1.0)", "l")
_hsl_query("hue_saturation", lambda c: tone.hue_saturation(c, 0.25, -0.2, 0.05), "h + 0.25 - floor(h + 0.25)", "least(greatest(s * 0.8, 0.0), 1.0)", "least(greatest(l + 0.05, 0.0), 1.0)")

_LIN = ", ".join(f"{DECODE.format(k)} AS l{k}" for k in "rgb")
_F = "CASE WHEN {0} > 216.0 / 24389 THEN pow({0}, 1.0 / 3) ELSE (24389.0 / 27 * {0} + 16) / 116 END"
_LAB = f""", lin AS (SELECT *, {_LIN} FROM rgb),
 xyz AS (SELECT *, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS xx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS yy, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS zz FROM lin),
 t AS (SELECT *, {_F.format("xx")} AS fx, {_F.format("yy")} AS fy, {_F.format("zz")} AS fz FROM xyz)"""
coloured("rgb_to_lab", color.rgb_to_lab, {"l": "116 * fy - 16", "a": "500 * (fx - fy)", "b": "200 * (fy - fz)"}, _LAB, 6)
coloured("color_to_alpha", lambda c: (color.color_to_alpha(c, (1.0, 1.0, 1.0)),), {"a": "greatest(1 - r, 1 - g, 1 - b)"})

# blend modes: the image as backdrop, the same image turned by half as source
BURN = "CASE WHEN {0} >= 1 THEN 1.0 WHEN {1} <= 0 THEN 0.0 ELSE 1 - least(1.0, (1 - {0}) / ({1})) END"
DODGE = "CASE WHEN {0} <= 0 THEN 0.0 WHEN {1} >= 1 THEN 1.0 ELSE least(1.0, {0} / (1 - ({1}))) END"
HARD = "CASE WHEN {1} <= 0.5 THEN 2 * {0} * {1} ELSE {0} + (2 * {1} - 1) - {0} * (2 * {1} - 1) END"
BLEND_SQL = {
    "normal": "s", "darken": "least(b, s)", "multiply": "b * s", "color_burn": BURN.format("b", "s"), "linear_burn": "b + s - 1", "lighten": "greatest(b, s)", "screen": "b + s - b * s", "color_dodge": DODGE.format("b", "s"),
    "linear_dodge": "b + s", "overlay": HARD.format("s", "b"), "soft_light": "CASE WHEN s <= 0.5 THEN b - (1 - 2 * s) * b * (1 - b) ELSE b + (2 * s - 1) * ((CASE WHEN b <= 0.25 THEN ((16 * b - 12) * b + 4) * b ELSE sqrt(b) END) - b) END",
    "hard_light": HARD.format("b", "s"), "vivid_light": f"CASE WHEN s <= 0.5 THEN {BURN.format('b', '(2 * s)')} ELSE {DODGE.format('b', '(2 * s - 1)')} END", "linear_light": "b + 2 * s - 1",
    "pin_light": "CASE WHEN s <= 0.5 THEN least(b, 2 * s) ELSE greatest(b, 2 * s - 1) END", "hard_mix": "CASE WHEN b + s >= 1 THEN 1 ELSE 0 END", "difference": "abs(b - s)", "exclusion": "b + s - 2 * b * s", "subtract": "b - s", "divide": "CASE WHEN s <= 0 THEN 1 ELSE b / s END",
}


def _blend(mode: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        px = rgb_pixels(spark, sf_dir)
        return px.select("vec_id", "pos", rounded(blend.blend_channel(mode, F.col("r"), F.col("g"))).alias("out"))

    QUERIES[f"blend_{mode}"] = (run, f"WITH {RGB_SQL}, t AS (SELECT vec_id, pos, r AS b, g AS s FROM rgb) SELECT vec_id, pos, {_sql_rounded(UNIT.format(BLEND_SQL[mode]))} AS out FROM t")


for _mode in blend.SEPARABLE:
    _blend(_mode)

# whole-colour modes: (r, g, b) as backdrop, (b, r, g) as source
_LUM = "(0.3 * {0} + 0.59 * {1} + 0.11 * {2})"
_PAIR = ", p AS (SELECT vec_id, pos, r AS br, g AS bg, b AS bb, b AS sr, r AS sg, g AS sb FROM rgb), m AS (SELECT *, 0.3 * br + 0.59 * bg + 0.11 * bb AS bl, 0.3 * sr + 0.59 * sg + 0.11 * sb AS sl, greatest(br, bg, bb) - least(br, bg, bb) AS bs, greatest(sr, sg, sb) - least(sr, sg, sb) AS ss FROM p)"
_SET_LUM = """, n AS (SELECT *, y - (0.3 * cr + 0.59 * cg + 0.11 * cb) AS d FROM k), o AS (SELECT vec_id, pos, cr + d AS r0, cg + d AS g0, cb + d AS b0 FROM n),
 q AS (SELECT *, 0.3 * r0 + 0.59 * g0 + 0.11 * b0 AS l, least(r0, g0, b0) AS lo, greatest(r0, g0, b0) AS hi FROM o),
 u AS (SELECT *, CASE WHEN lo < 0 THEN l + (r0 - l) * l / (l - lo) ELSE r0 END AS r1, CASE WHEN lo < 0 THEN l + (g0 - l) * l / (l - lo) ELSE g0 END AS g1, CASE WHEN lo < 0 THEN l + (b0 - l) * l / (l - lo) ELSE b0 END AS b1 FROM q),
 t AS (SELECT vec_id, pos, CASE WHEN hi > 1 THEN l + (r1 - l) * (1 - l) / (hi - l) ELSE r1 END AS r, CASE WHEN hi > 1 THEN l + (g1 - l) * (1 - l) / (hi - l) ELSE g1 END AS g, CASE WHEN hi > 1 THEN l + (b1 - l) * (1 - l) / (hi - l) ELSE b1 END AS b FROM u)"""


def _set_sat(c: str, span: str, s: str) -> str:
    low = f"least({c}r, {c}g, {c}b)"
    return ", ".join(f"CASE WHEN {span} > 0 THEN ({c}{k} - {low}) * {s} / {span} ELSE 0 END AS c{k}" for k in "rgb")


_WHOLE_SQL = {
    "darker_color": _PAIR + ", t AS (SELECT vec_id, pos, CASE WHEN sl < bl THEN sr ELSE br END AS r, CASE WHEN sl < bl THEN sg ELSE bg END AS g, CASE WHEN sl < bl THEN sb ELSE bb END AS b FROM m)",
    "lighter_color": _PAIR + ", t AS (SELECT vec_id, pos, CASE WHEN sl > bl THEN sr ELSE br END AS r, CASE WHEN sl > bl THEN sg ELSE bg END AS g, CASE WHEN sl > bl THEN sb ELSE bb END AS b FROM m)",
    "hue": _PAIR + f", k AS (SELECT vec_id, pos, bl AS y, {_set_sat('s', 'ss', 'bs')} FROM m)" + _SET_LUM,
    "saturation": _PAIR + f", k AS (SELECT vec_id, pos, bl AS y, {_set_sat('b', 'bs', 'ss')} FROM m)" + _SET_LUM,
    "color": _PAIR + ", k AS (SELECT vec_id, pos, bl AS y, sr AS cr, sg AS cg, sb AS cb FROM m)" + _SET_LUM,
    "luminosity": _PAIR + ", k AS (SELECT vec_id, pos, sl AS y, br AS cr, bg AS cg, bb AS cb FROM m)" + _SET_LUM,
}
for _mode, _steps in _WHOLE_SQL.items():
    coloured(f"blend_{_mode}", lambda c, mode=_mode: blend.blend_rgb(mode, c, (c[2], c[0], c[1])), {k: UNIT.format(k) for k in "rgb"}, _steps)


def _alpha(name: str, fn, sql: dict[str, str]) -> None:
    """Backdrop r (premultiplied by its alpha b), source g of alpha r."""

    def run(spark, sf_dir: str) -> DataFrame:
        px = rgb_pixels(spark, sf_dir)
        one = lambda c: (c, c, c)
        out, a = fn((one(F.col("r") * F.col("b")), F.col("b")), (one(F.col("g")), F.col("r")), "screen")
        return px.select("vec_id", "pos", rounded(out[0]).alias("c"), rounded(a).alias("a"))

    columns = ", ".join(f"{_sql_rounded(x)} AS {k}" for k, x in sql.items())
    QUERIES[name] = (run, f"WITH {RGB_SQL}, t AS (SELECT vec_id, pos, CASE WHEN b > 0 THEN r ELSE 0 END AS k, r * b AS bd, b AS ab, g AS s, r AS sa FROM rgb), m AS (SELECT *, {UNIT.format('k + s - k * s')} AS mix FROM t) SELECT vec_id, pos, {columns} FROM m")


_alpha("porter_duff_over", blend.over, {"c": "sa * ((1 - ab) * s + ab * mix) + bd * (1 - sa)", "a": "sa + ab * (1 - sa)"})
_alpha("porter_duff_atop", blend.atop, {"c": "sa * ab * mix + bd * (1 - sa)", "a": "ab"})


# selections: coverage 0..255 of a tonal range with soft edges, and the set operations on two of them
def coverage(code: Column, low: int, high: int, soft: int) -> Column:
    up, down = (code - (low - soft)) * 255 / soft, ((high + soft) - code) * 255 / soft
    return F.floor(F.least(F.greatest(F.least(up, down), F.lit(0.0)), F.lit(255.0))).cast("int")


_COVER = "CAST(floor(least(greatest(least(({0} - ({1} - {3})) * 255.0 / {3}, (({2} + {3}) - {0}) * 255.0 / {3}), 0.0), 255.0)) AS INT)"
SELECTION = {
    "replace": (lambda a, b: b, "b"), "add": (F.greatest, "greatest(a, b)"), "subtract": (lambda a, b: F.greatest(a - b, F.lit(0)), "greatest(a - b, 0)"),
    "intersect": (F.least, "least(a, b)"), "exclude": (lambda a, b: F.abs(a - b), "abs(a - b)"), "invert": (lambda a, b: 255 - a, "255 - a"),
}


def _selection(op: str) -> None:
    fn, sql = SELECTION[op]

    def run(spark, sf_dir: str) -> DataFrame:
        px = pixels(spark, sf_dir)
        return px.select("vec_id", "pos", fn(coverage(F.col("code"), 60, 140, 16), coverage(F.col("code"), 120, 200, 32)).cast("int").alias("coverage"))

    QUERIES[f"select_boolean_{op}"] = (run, f"WITH {PX_SQL}, t AS (SELECT vec_id, pos, {_COVER.format('code', 60, 140, 16)} AS a, {_COVER.format('code', 120, 200, 32)} AS b FROM px) SELECT vec_id, pos, CAST({sql} AS INT) AS coverage FROM t")


for _op in SELECTION:
    _selection(_op)


def select_ellipse(spark, sf_dir: str) -> DataFrame:
    """Coverage of the inscribed ellipse by 4 x 4 samples a pixel, weighing the code."""
    px = pixels(spark, sf_dir)
    steps = F.array(*[F.lit((k + 0.5) / 4) for k in range(4)])
    inside = lambda sx, sy: F.when(F.pow((F.col("x") + sx - 4) / 4, 2) + F.pow((F.col("y") + sy - 4) / 3, 2) <= 1, 1).otherwise(0)
    n = F.aggregate(F.flatten(F.transform(steps, lambda sy: F.transform(steps, lambda sx: inside(sx, sy)))), F.lit(0), lambda t, v: t + v)
    return px.select("vec_id", n.alias("n"), "code").groupBy("vec_id").agg(F.sum(F.col("n") * F.col("code")).cast("long").alias("weighted"), F.sum("n").cast("long").alias("samples"))


QUERIES["select_ellipse"] = (
    select_ellipse,
    f"WITH {PX_SQL}, s AS (SELECT (i + 0.5) / 4 AS sx, (j + 0.5) / 4 AS sy FROM range(4) a(i), range(4) b(j)), t AS (SELECT vec_id, code, CASE WHEN pow((x + sx - 4) / 4, 2) + pow((y + sy - 4) / 3, 2) <= 1 THEN 1 ELSE 0 END AS n FROM px, s) SELECT vec_id, CAST(sum(n * code) AS BIGINT) AS weighted, CAST(sum(n) AS BIGINT) AS samples FROM t GROUP BY 1",
)
