"""Further adjustments, selections, geometry and layer queries over the raster views, each with its DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.functions import blend, color, tone
from umbrafold.functions.binding import bound
from umbrafold.operators import neighborhood as nb
from umbrafold.operators import trees
from umbrafold.plans import neighbors, pointwise
from umbrafold.plans.pointwise import BLEND_SQL, DECODE, UNIT, rounded
from umbrafold.sources.rasters import PX_SQL, RGB_SQL, images, pixels, rgb_pixels

QUERIES: dict = {}
W = H = 8


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


# pointwise: these are kept with their like
pointwise.coloured("flatten_background", lambda c: tuple(v * c[2] + k * (1 - c[2]) for v, k in zip(c[:2], (1.0, 0.5), strict=True)), {"r": "r * b + 1 - b", "g": "g * b + 0.5 * (1 - b)"})
pointwise.coloured("calculations", lambda c: (blend.blend_channel("multiply", c[0], c[1]) * 0.6 + c[0] * 0.4,), {"out": f"{UNIT.format('r * g')} * 0.6 + r * 0.4"})
pointwise.coloured("apply_image", lambda c: tuple(v + (blend.blend_channel("screen", v, c[2]) - v) * 0.5 for v in c), {k: f"{k} + ({UNIT.format(f'{k} + b - {k} * b')} - {k}) * 0.5" for k in "rgb"})
pointwise.coloured("levels_channels", lambda c: tuple(tone.levels(tone.levels(v, lo, 0.9, g), 0.05, 0.95, 1.0) for v, lo, g in zip(c, (0.1, 0.05, 0.0), (1.2, 1.0, 0.8), strict=True)), {k: f"((sign((({k}) - {lo}) / (0.9 - {lo})) * pow(abs((({k}) - {lo}) / (0.9 - {lo})), 1 / {g})) - 0.05) / 0.9" for k, lo, g in (("r", 0.1, 1.2), ("g", 0.05, 1.0), ("b", 0.0, 0.8))})
pointwise.coloured("curves_channels", lambda c: (tone.monotone_curve(c[0], [(0.0, 0.0), (1.0, 0.5)]), tone.monotone_curve(c[1], [(0.0, 1.0), (1.0, 0.0)]), c[2]), {"r": "r * 0.5", "g": "1 - g", "b": "b"})
_LUT = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in range(256)]
pointwise.grey("decode_table", lambda v: F.get(F.array(*map(F.lit, _LUT)), F.round(v * 255).cast("int")), DECODE.format("v"))
pointwise.coloured("weighted_luma_mask", lambda c: (tone.masked(color.luma601(c), color.luminance(c), c[0]),), {"out": "0.299 * r + 0.587 * g + 0.114 * b + (0.2126 * r + 0.7152 * g + 0.0722 * b - 0.299 * r - 0.587 * g - 0.114 * b) * r"})

# colour ranges: the SQL names the hue of each order of the channels
_HUES = "CASE WHEN r >= g AND g >= b THEN [{0}, {1}] WHEN g >= r AND r >= b THEN [{2}, {1}] WHEN g >= b AND b >= r THEN [{2}, {3}] WHEN b >= g AND g >= r THEN [{4}, {3}] WHEN b >= r AND r >= g THEN [{4}, {5}] ELSE [{0}, {5}] END"
_SPLIT = ", o AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low, r + g + b - greatest(r, g, b) - least(r, g, b) AS mid FROM rgb), t AS (SELECT *, {} FROM o)"
_BW = (0.4, 0.6, 0.4, 0.6, 0.2, 0.8)
_MIX = f"{_HUES.format(*_BW)} AS w"
pointwise.coloured("black_and_white", lambda c: (color.black_and_white(c, _BW),), {"out": "low + (mid - low) * w[2] + (top - mid) * w[1]"}, _SPLIT.format(_MIX))
#: (cyan, magenta, yellow, black) of the nine ranges.
_INKS = [(-0.5, 0.2, 0.3, 0.0), (0.1, 0.0, -0.6, 0.1), (0.4, -0.3, 0.2, 0.0), (-0.2, 0.1, 0.0, -0.1), (0.0, -0.4, 0.3, 0.2), (0.3, 0.3, -0.3, 0.0), (0.1, 0.0, 0.2, -0.2), (0.0, 0.15, -0.1, 0.05), (0.2, -0.2, 0.0, 0.3)]
_GREY = "(1 - (top - low))"
_WHITES, _BLACKS = f"{_GREY} * greatest(2 * low - 1, 0)", f"{_GREY} * greatest(1 - 2 * top, 0)"
_DELTAS = ", ".join(
    f"(mid - low) * ({_HUES.format(*(f'{row[k]!r}' for row in _INKS[:6]))})[2] + (top - mid) * ({_HUES.format(*(f'{row[k]!r}' for row in _INKS[:6]))})[1] + {_WHITES} * {_INKS[6][k]} + ({_GREY} - {_WHITES} - {_BLACKS}) * {_INKS[7][k]} + {_BLACKS} * {_INKS[8][k]} AS d{k}" for k in range(4)
)
for _name, _relative in (("selective_color", True), ("selective_color_absolute", False)):
    _INKED = lambda x, k, rel=_relative: UNIT.format(f"{x} + {f'({x}) * d{k}' if rel else f'd{k}'}")
    _PART = lambda v: f"(CASE WHEN top > 0 THEN (top - {v}) / top ELSE 0 END)"
    pointwise.coloured(_name, lambda c, rel=_relative: color.selective_color(c, _INKS, rel), {v: f"(1 - {_INKED(_PART(v), k)}) * (1 - {_INKED('(1 - top)', 3)})" for k, v in enumerate("rgb")}, _SPLIT.format(_DELTAS))

# neighbourhoods and maps of places
PLACES = {
    "diffuse": (lambda x, y: (x + (x * 7 + y * 3) % 3 - 1, y + (x * 5 + y * 11) % 3 - 1), "x + (x * 7 + y * 3) % 3 - 1", "y + (x * 5 + y * 11) % 3 - 1"),
    "tiles_shifted": (lambda x, y: (x + (F.floor(y / 4) * 2 - 1).cast("int"), y), "x + (y // 4) * 2 - 1", "y"),
    "facet_cells": (lambda x, y: ((F.floor(x / 2) * 2).cast("int"), (F.floor(y / 2) * 2).cast("int")), "x // 2 * 2", "y // 2 * 2"),
}
for _name, (_source, _sx, _sy) in PLACES.items():
    neighbors._query(
        _name, lambda c, s=_source: nb.remapped(c, W, H, s),
        f"WITH {PX_SQL} SELECT p.vec_id, p.pos, CAST(q.code AS BIGINT) AS out FROM (SELECT *, least(greatest({_sx}, 0), 7) AS sx, least(greatest({_sy}, 0), 7) AS sy FROM px) p JOIN px q ON q.vec_id = p.vec_id AND q.x = p.sx AND q.y = p.sy",
    )
_GROW = "max(CASE WHEN abs(dx) + abs(dy) <= 3 AND code >= 128 THEN 255 ELSE 0 END)"
_SHRINK = "min(CASE WHEN abs(dx) + abs(dy) <= 3 THEN CASE WHEN code >= 128 THEN 255 ELSE 0 END ELSE 255 END)"
_CRISP = lambda c: F.transform(c, lambda v: F.when(v >= 128, 255).otherwise(0))
_DISC = [(dx, dy) for dx, dy in nb.square(2) if abs(dx) + abs(dy) <= 3]
neighbors._query("select_border", lambda c: F.zip_with(nb.gathered(_CRISP(c), _DISC, W, H, F.array_max), nb.gathered(_CRISP(c), _DISC, W, H, F.array_min), lambda a, b: a - b), neighbors._neighbours_sql(2, 2, aggregate=f"{_GROW} - {_SHRINK}"))
neighbors._query("select_smooth", lambda c: nb.median(_CRISP(c), 1, W, H), neighbors._neighbours_sql(1, 1, aggregate="quantile_disc(CASE WHEN code >= 128 THEN 255 ELSE 0 END, 0.5)"))
neighbors._query("select_feather_sum", lambda c: nb.weighted(_CRISP(c), nb.BINOMIAL, W, H), neighbors._neighbours_sql(1, 1, aggregate="sum(CASE WHEN code >= 128 THEN 255 ELSE 0 END * w)", weight=neighbors._weights_sql(nb.BINOMIAL)))
neighbors._query("despeckle", lambda c: nb.each_pixel(W, H, lambda x, y: bound(F.array(*[nb.at(c, x + dx, y + dy, W, H) for dx, dy in nb.square(1)]), lambda v: F.when(F.array_max(v) - F.array_min(v) < 60, F.get(F.sort_array(v), F.lit(4))).otherwise(F.get(v, F.lit(4))))), neighbors._neighbours_sql(1, 1, aggregate="CASE WHEN max(code) - min(code) < 60 THEN quantile_disc(code, 0.5) ELSE max(own) END"))
neighbors._query("select_grow", lambda c: nb.each_pixel(W, H, lambda x, y: F.when((nb.at(c, x, y, W, H) >= 128) | ((nb.at(c, x, y, W, H) >= 110) & (F.array_max(F.array(*[nb.at(c, x + dx, y + dy, W, H) for dx, dy in nb.square(1)])) >= 128)), 255).otherwise(0)), neighbors._neighbours_sql(1, 1, aggregate="CASE WHEN max(own) >= 128 OR (max(own) >= 110 AND max(code) >= 128) THEN 255 ELSE 0 END"))


@query(f"WITH {PX_SQL}, s AS (SELECT vec_id, pos, code, least(greatest(least(x + 1, 6.25) - greatest(x, 1.5), 0), 1) * least(greatest(least(y + 1, 5.5) - greatest(y, 2.25), 0), 1) AS w FROM px) SELECT vec_id, round(sum(w * code)::DOUBLE, 6) AS weighted, round(sum(w)::DOUBLE, 6) AS area FROM s GROUP BY vec_id")
def select_rectangle(spark, sf_dir: str) -> DataFrame:
    """The coverage of a box with broken edges by the area that it shares with each pixel, weighing the code."""
    part = lambda k, lo, hi: F.least(F.greatest(F.least(F.col(k) + 1, F.lit(hi)) - F.greatest(F.col(k), F.lit(lo)), F.lit(0.0)), F.lit(1.0))
    w = part("x", 1.5, 6.25) * part("y", 2.25, 5.5)
    return pixels(spark, sf_dir).select("vec_id", "code", w.alias("w")).groupBy("vec_id").agg(F.round(F.sum(F.col("w") * F.col("code")), 6).alias("weighted"), F.round(F.sum("w"), 6).alias("area"))


@query(f"WITH {PX_SQL} SELECT vec_id, CAST(sum(CASE WHEN y = 3 THEN code ELSE 0 END) AS BIGINT) AS in_row, CAST(sum(CASE WHEN x = 5 THEN code ELSE 0 END) AS BIGINT) AS in_column FROM px GROUP BY vec_id")
def select_single_lines(spark, sf_dir: str) -> DataFrame:
    inside = lambda c: F.sum(F.when(c, F.col("code")).otherwise(0)).cast("long")
    return pixels(spark, sf_dir).groupBy("vec_id").agg(inside(F.col("y") == 3).alias("in_row"), inside(F.col("x") == 5).alias("in_column"))


POLYGON = ((1.0, 0.5), (7.0, 2.0), (5.0, 7.5), (3.5, 3.0), (0.5, 6.0))


def _crossings(px: str, py: str, sql: bool):
    """How many of the polygon's edges a ray to the right of a point crosses."""
    parts = []
    for (x0, y0), (x1, y1) in zip(POLYGON, (*POLYGON[1:], POLYGON[0]), strict=True):
        if sql:
            parts.append(f"CASE WHEN ({y0} > {py}) <> ({y1} > {py}) AND {px} < ({x1 - x0}) * ({py} - {y0}) / ({y1 - y0}) + {x0} THEN 1 ELSE 0 END")
        else:
            x, y = F.col(px), F.col(py)
            parts.append(F.when(((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), 1).otherwise(0))
    return " + ".join(parts) if sql else sum(parts, F.lit(0))


@query(f"WITH {PX_SQL}, s AS (SELECT vec_id, pos, code, x + (i + 0.5) / 4 AS sx, y + (j + 0.5) / 4 AS sy FROM px, range(4) a(i), range(4) b(j)) SELECT vec_id, pos, CAST(sum(CASE WHEN ({_crossings('sx', 'sy', True)}) % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS samples FROM s GROUP BY ALL")
def select_polygon(spark, sf_dir: str) -> DataFrame:
    """Even-odd coverage of a polygon by 4 x 4 samples a pixel; its edges are literals."""
    at = spark.range(64 * 16).select((F.col("id") / 16).cast("int").alias("pos"), (F.col("id") % 16).cast("int").alias("k"))
    at = at.select("pos", (F.col("pos") % 8 + (F.col("k") % 4 + 0.5) / 4).alias("sx"), (F.floor(F.col("pos") / 8) + (F.floor(F.col("k") / 4) + 0.5) / 4).alias("sy"))
    cover = at.groupBy("pos").agg(F.sum(F.when(_crossings("sx", "sy", False) % 2 == 1, 1).otherwise(0)).cast("long").alias("samples"))
    return pixels(spark, sf_dir).select("vec_id", "pos").join(F.broadcast(cover), "pos").select("vec_id", "pos", "samples")  # 64 rows


_KEEP = "((x * 73 + y * 151 + vec_id % 97) * 37) % 101"


@query(f"WITH {RGB_SQL} SELECT vec_id, pos, round(CASE WHEN {_KEEP} < 60 THEN g ELSE r END, 9) AS out FROM rgb")
def blend_dissolve(spark, sf_dir: str) -> DataFrame:
    """The source at 60 % opacity shows whole at the places that a hash of position and layer picks."""
    keep = ((F.col("x") * 73 + F.col("y") * 151 + F.col("vec_id") % 97) * 37) % 101 < 60
    return rgb_pixels(spark, sf_dir).select("vec_id", "pos", rounded(F.when(keep, F.col("g")).otherwise(F.col("r"))).alias("out"))


@query(f"WITH {PX_SQL} SELECT p.vec_id, p.pos, CAST(q.code AS BIGINT) AS out FROM px p JOIN px m ON m.vec_id = p.vec_id AND m.pos = 63 - p.pos JOIN px q ON q.vec_id = p.vec_id AND q.x = least(greatest(p.x + m.code // 32 - 4, 0), 7) AND q.y = p.y")
def displace(spark, sf_dir: str) -> DataFrame:
    """Each pixel taken from beside it, as far as a map (the image turned by half) says."""
    moved = lambda c: nb.each_pixel(W, H, lambda x, y: nb.at(c, x + F.floor(F.get(c, 63 - (y * W + x)) / 32).cast("int") - 4, y, W, H))
    out = images(spark, sf_dir).select("vec_id", F.posexplode(bound(F.col("codes"), moved)).alias("pos", "out"))
    return out.select("vec_id", "pos", F.col("out").cast("long").alias("out"))


@query(f"WITH {PX_SQL} SELECT vec_id, pos, code::DOUBLE AS out FROM px")
def inverse_fft(spark, sf_dir: str) -> DataFrame:
    """The image from its spectrum; the SQL is the image itself."""

    def back(batches):
        for batch in batches:
            v = np.array(batch.column("codes").to_pylist(), float).reshape(-1, H, W)
            out = np.fft.ifft2(np.fft.fft2(v)).real.round(6).reshape(-1, W * H) + 0.0
            yield pa.record_batch([batch.column("vec_id"), pa.array(list(out), pa.list_(pa.float64()))], ["vec_id", "out"])

    return images(spark, sf_dir).select("vec_id", "codes").mapInArrow(back, "vec_id long, out array<double>").select("vec_id", F.posexplode("out").alias("pos", "out"))


@query(f"WITH {RGB_SQL}, t AS (SELECT CAST(floor((0.299 * r + 0.587 * g + 0.114 * b) * 255 + 0.5) AS INT) AS bin, r AS w FROM rgb) SELECT bin, CAST(count(*) AS BIGINT) AS n, round(sum(w), 4) AS weight FROM t GROUP BY bin")
def luma_histogram(spark, sf_dir: str) -> DataFrame:
    luma = F.floor(color.luma601((F.col("r"), F.col("g"), F.col("b"))) * 255 + 0.5).cast("int")
    return rgb_pixels(spark, sf_dir).groupBy(luma.alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("weight"))


@query(f"WITH {RGB_SQL}, s AS (SELECT vec_id, sum(g) AS w, sum(g * r) AS m, sum(g * r * r) AS q FROM rgb GROUP BY vec_id) SELECT vec_id, round(CASE WHEN w > 0 THEN m / w ELSE 0 END, 6) AS mean, round(CASE WHEN w > 0 THEN sqrt(greatest(q / w - (m / w) * (m / w), 0)) ELSE 0 END, 5) AS std FROM s")
def weighted_moments(spark, sf_dir: str) -> DataFrame:
    """Mean and spread of a channel, weighed by a selection."""
    s = rgb_pixels(spark, sf_dir).groupBy("vec_id").agg(F.sum("g").alias("w"), F.sum(F.col("g") * F.col("r")).alias("m"), F.sum(F.col("g") * F.col("r") * F.col("r")).alias("q"))
    w = F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    mean = F.when(F.col("w") > 0, F.col("m") / w).otherwise(0.0)
    spread = F.when(F.col("w") > 0, F.sqrt(F.greatest(F.col("q") / w - (F.col("m") / w) * (F.col("m") / w), F.lit(0.0)))).otherwise(0.0)
    return s.select("vec_id", F.round(mean, 6).alias("mean"), F.round(spread, 5).alias("std"))


@query(f"WITH {PX_SQL} SELECT vec_id, CAST((y // 2) * 4 + x // 2 AS INT) AS pos, avg(code::DOUBLE) AS out FROM px GROUP BY ALL")
def resize_area(spark, sf_dir: str) -> DataFrame:
    """Half the size by the mean of the area, inside the image's own row."""
    half = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: sum((F.get(c, ((F.floor(p / 4) * 2 + dy) * W + (p % 4) * 2 + dx).cast("int")) for dy in (0, 1) for dx in (0, 1)), F.lit(0)) / 4.0)
    return images(spark, sf_dir).select("vec_id", F.posexplode(bound(F.col("codes"), half)).alias("pos", "out"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS INT) AS z FROM lineitem")
def layers_reversed(spark, sf_dir: str) -> DataFrame:
    z = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber")))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", z.alias("z"))


@query("SELECT 's' || s_suppkey AS id, 'r' || n_regionkey AS above FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def descendants(spark, sf_dir: str) -> DataFrame:
    """Each node with every node above it."""
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    nodes = table("region").select(tag("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.union(table("nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey"))).union(table("supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey")))
    return trees.levels(nodes).select("id", F.explode(F.slice("path", 1, F.col("depth"))).alias("above"))


MODES = ("normal", "multiply", "screen", "darken", "lighten", "difference")
_MODE_SQL = "CASE c.m " + " ".join(f"WHEN {k} THEN {UNIT.format(BLEND_SQL[m].replace('greatest', '@').replace('least', '#').replace('abs', '~').replace('b', 'b.v').replace('s', 'c.v').replace('@', 'greatest').replace('#', 'least').replace('~', 'abs'))}" for k, m in enumerate(MODES)) + " END"


@query(f"""WITH {PX_SQL}, l AS (SELECT label, pos, vec_id, {{'v': code / 255.0::DOUBLE, 'm': CAST(vec_id % {len(MODES)} AS INT), 'o': (vec_id % 4 + 1) / 4.0::DOUBLE * CASE WHEN vec_id % 5 = 4 THEN 0.0::DOUBLE WHEN x + y < 10 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END}} AS s FROM px),
 g AS (SELECT label, pos, list(s ORDER BY vec_id) AS s FROM l GROUP BY ALL)
SELECT label, pos, round(list_reduce(list_prepend({{'v': 1.0::DOUBLE, 'm': 0::INT, 'o': 1.0::DOUBLE}}, s), lambda b, c: {{'v': b.v + ({_MODE_SQL} - b.v) * c.o, 'm': c.m, 'o': c.o}}).v, 6) AS out FROM g""")
def composite_layers(spark, sf_dir: str) -> DataFrame:
    """A table of layers with mode, opacity, mask and visibility each, folded from the bottom up over a white ground; a hidden layer has no opacity. A stack is one row, as large as its document has layers."""
    mask = F.when(F.col("vec_id") % 5 == 4, 0.0).when(F.col("x") + F.col("y") < 10, 1.0).otherwise(0.5)
    layer = F.struct("vec_id", (F.col("code") / F.lit(255.0)).alias("v"), (F.col("vec_id") % len(MODES)).alias("m"), ((F.col("vec_id") % 4 + 1) / F.lit(4.0) * mask).alias("o"))
    shown = pixels(spark, sf_dir).groupBy("label", "pos").agg(F.array_sort(F.collect_list(layer)).alias("l"))

    def laid(b: Column, s: Column) -> Column:
        out = b
        for k, mode in enumerate(MODES):
            out = F.when(s["m"] == k, blend.blend_channel(mode, b, s["v"])).otherwise(out)
        return b + (out - b) * s["o"]

    return shown.select("label", "pos", F.round(F.aggregate("l", F.lit(1.0), laid), 6).alias("out"))
