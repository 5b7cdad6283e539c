"""Distortions by inverse maps, sampled filters, dithers, dialog adjustments and timeline queries, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.functions.color import hsl_to_rgb, luminance, rgb_to_hsl, unit
from umbrafold.operators import neighborhood as nb
from umbrafold.operators import palettes
from umbrafold.plans.pointwise import RGB_SQL, rounded
from umbrafold.sources.rasters import PX_SQL, images, pixels, rgb_pixels

QUERIES: dict = {}
W = H = 8


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


def bilinear(image: Column, sx: Column, sy: Column, edge=nb.clamp) -> Column:
    x0, y0 = F.floor(sx).cast("int"), F.floor(sy).cast("int")
    fx, fy = sx - x0, sy - y0
    tap = lambda dx, dy: nb.at(image, x0 + dx, y0 + dy, W, H, edge)
    return (tap(0, 0) * (1 - fx) + tap(1, 0) * fx) * (1 - fy) + (tap(0, 1) * (1 - fx) + tap(1, 1) * fx) * fy


def _distortion(name: str, source, sx: str, sy: str) -> None:
    """source(x, y, dx, dy, r): where a pixel comes from; dx, dy, r are its offsets and distance from the centre. The SQL says the same of its columns."""

    def run(spark, sf_dir: str) -> DataFrame:
        def body(image: Column, x: Column, y: Column) -> Column:
            dx, dy = x - 3.5, y - 3.5
            place = F.struct(*(c.cast("double").alias(k) for k, c in zip("uv", source(x, y, dx, dy, F.sqrt(dx * dx + dy * dy)), strict=True)))
            return nb.bound(place, lambda p: bilinear(image, p["u"], p["v"]))

        mapped = nb.bound(F.col("codes"), lambda image: nb.each_pixel(W, H, lambda x, y: body(image, x, y)))
        out = images(spark, sf_dir).select("vec_id", F.posexplode(mapped).alias("pos", "out"))
        return out.select("vec_id", "pos", F.round("out", 7).alias("out"))

    QUERIES[name] = (
        run,
        f"""WITH {PX_SQL}, d AS (SELECT *, x - 3.5::DOUBLE AS dx, y - 3.5::DOUBLE AS dy, sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE)) AS r FROM px),
 s AS (SELECT vec_id, pos, ({sx})::DOUBLE AS sx, ({sy})::DOUBLE AS sy FROM d), t AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s)
SELECT t.vec_id, t.pos, round(sum(q.code * (CASE WHEN ox = 0 THEN 1 - fx ELSE fx END) * (CASE WHEN oy = 0 THEN 1 - fy ELSE fy END)), 7) AS out
FROM t CROSS JOIN range(2) a(ox) CROSS JOIN range(2) b(oy) JOIN px q ON q.vec_id = t.vec_id AND q.x = least(greatest(x0 + ox, 0), 7) AND q.y = least(greatest(y0 + oy, 0), 7) GROUP BY t.vec_id, t.pos""",
    )


_distortion("pinch", lambda x, y, dx, dy, r: (3.5 + dx * (1 + 0.3 * (1 - F.least(r / 5, F.lit(1.0)))), 3.5 + dy * (1 + 0.3 * (1 - F.least(r / 5, F.lit(1.0))))), "3.5 + dx * (1 + 0.3::DOUBLE * (1 - least(r / 5, 1.0::DOUBLE)))", "3.5 + dy * (1 + 0.3::DOUBLE * (1 - least(r / 5, 1.0::DOUBLE)))")
_TURN = lambda r: 0.8 * (1 - F.least(r / 5, F.lit(1.0)))
_distortion("twirl", lambda x, y, dx, dy, r: (3.5 + dx * F.cos(_TURN(r)) - dy * F.sin(_TURN(r)), 3.5 + dx * F.sin(_TURN(r)) + dy * F.cos(_TURN(r))), "3.5 + dx * cos(0.8 * (1 - least(r / 5, 1.0))) - dy * sin(0.8 * (1 - least(r / 5, 1.0)))", "3.5 + dx * sin(0.8 * (1 - least(r / 5, 1.0))) + dy * cos(0.8 * (1 - least(r / 5, 1.0)))")
_distortion("wave", lambda x, y, dx, dy, r: (x + 0.8 * F.sin(y * 0.9), y + 0.6 * F.sin(x * 0.7)), "x + 0.8 * sin(y * 0.9)", "y + 0.6 * sin(x * 0.7)")
_distortion("ripple", lambda x, y, dx, dy, r: (x + 0.4 * F.sin(y * 2.5), y.cast("double")), "x + 0.4 * sin(y * 2.5)", "y")
_distortion("zigzag", lambda x, y, dx, dy, r: (3.5 + dx * (1 + 0.2 * F.sin(r * 2)), 3.5 + dy * (1 + 0.2 * F.sin(r * 2))), "3.5 + dx * (1 + 0.2 * sin(r * 2))", "3.5 + dy * (1 + 0.2 * sin(r * 2))")
_distortion("spherize", lambda x, y, dx, dy, r: (3.5 + dx * F.pow(F.least(r / 5, F.lit(1.0)), 0.4), 3.5 + dy * F.pow(F.least(r / 5, F.lit(1.0)), 0.4)), "3.5 + dx * pow(least(r / 5, 1.0), 0.4)", "3.5 + dy * pow(least(r / 5, 1.0), 0.4)")
_distortion("lens_distortion", lambda x, y, dx, dy, r: (3.5 + dx * (1 + r * r / 97), 3.5 + dy * (1 + r * r / 97)), "3.5 + dx * (1 + r * r / 97)", "3.5 + dy * (1 + r * r / 97)")
_distortion("rotate_30", lambda x, y, dx, dy, r: (3.5 + dx * math.cos(math.pi / 6) + dy * math.sin(math.pi / 6), 3.5 - dx * math.sin(math.pi / 6) + dy * math.cos(math.pi / 6)), f"3.5 + dx * {math.cos(math.pi / 6)!r}::DOUBLE + dy * {math.sin(math.pi / 6)!r}::DOUBLE", f"3.5 - dx * {math.sin(math.pi / 6)!r}::DOUBLE + dy * {math.cos(math.pi / 6)!r}::DOUBLE")
_distortion("affine", lambda x, y, dx, dy, r: (0.75 * x + 0.125 * y + 0.5, 0.875 * y - 0.25 * x + 1), "0.75 * x + 0.125 * y + 0.5", "0.875 * y - 0.25 * x + 1")
_distortion("perspective", lambda x, y, dx, dy, r: ((x + 0.5) / (1 + 0.05 * x), (y + 0.25) / (1 + 0.05 * x)), "(x + 0.5) / (1 + 0.05 * x)", "(y + 0.25) / (1 + 0.05 * x)")
_distortion("polar_coordinates", lambda x, y, dx, dy, r: ((F.atan2(dy, dx) / (2 * math.pi) + 0.5) * 7, r / 5 * 7), f"(atan2(dy, dx) / {2 * math.pi!r}::DOUBLE + 0.5) * 7", "r / 5 * 7")
_distortion("kaleidoscope", lambda x, y, dx, dy, r: (3.5 + r * F.cos(F.abs(F.atan2(dy, dx))), 3.5 + r * F.sin(F.abs(F.atan2(dy, dx)))), "3.5 + r * cos(abs(atan2(dy, dx)))", "3.5 + r * sin(abs(atan2(dy, dx)))")
_distortion("shear_smooth", lambda x, y, dx, dy, r: (x + 0.375 * dy, y.cast("double")), "x + 0.375 * dy", "y")
_distortion("enlarge", lambda x, y, dx, dy, r: (x / 2 - 0.25, y / 2 - 0.25), "x / 2.0 - 0.25", "y / 2.0 - 0.25")


def _sampled(name: str, offsets: list[tuple[int, int]], body, aggregate: str) -> None:
    """body over the neighbours at the offsets, in whole numbers."""

    def run(spark, sf_dir: str) -> DataFrame:
        out = images(spark, sf_dir).select("vec_id", F.posexplode(nb.gathered(F.col("codes"), offsets, W, H, body)).alias("pos", "out"))
        return out.select("vec_id", "pos", F.col("out").cast("long").alias("out"))

    values = ", ".join(f"({dx}, {dy}, {k})" for k, (dx, dy) in enumerate(offsets))
    QUERIES[name] = (run, f"WITH {PX_SQL}, o(dx, dy, k) AS (VALUES {values}) SELECT p.vec_id, p.pos, CAST({aggregate} AS BIGINT) AS out FROM px p CROSS JOIN o JOIN px q ON q.vec_id = p.vec_id AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7) GROUP BY p.vec_id, p.pos")


_sampled("motion_blur", [(k, k // 2) for k in range(-3, 4)], nb.total, "sum(q.code)")
_sampled("lens_blur", [(dx, dy) for dx, dy in nb.square(2) if dx * dx + dy * dy <= 5], nb.total, "sum(q.code)")
_sampled("wind", [(-k, 0) for k in range(4)], lambda v: F.aggregate(F.transform(v, lambda c, k: c * (4 - k)), F.lit(0), lambda t, c: t + c), "sum(q.code * (4 - k))")
_sampled("radius_range", nb.square(1), lambda v: F.array_max(v) - F.array_min(v), "max(q.code) - min(q.code)")


def _modal(v: Column) -> Column:
    """The mean (cut to a whole number) of the values in the fullest of eight bins, the lower bin at a tie."""
    tally = lambda own: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.struct(F.size(F.filter(own, lambda c: F.floor(c / 32) == b)).alias("n"), (-b).alias("b")))
    mine = lambda own: nb.bound(-F.array_max(tally(own))["b"], lambda best: F.filter(own, lambda c: F.floor(c / 32) == best))
    return nb.bound(v, lambda own: nb.bound(mine(own), lambda m: F.floor(nb.total(m) / F.size(m))))


def oil_paint(spark, sf_dir: str) -> DataFrame:
    out = images(spark, sf_dir).select("vec_id", F.posexplode(nb.gathered(F.col("codes"), nb.square(1), W, H, _modal)).alias("pos", "out"))
    return out.select("vec_id", "pos", F.col("out").cast("long").alias("out"))


QUERIES["oil_paint"] = (oil_paint, f"WITH {PX_SQL}, n AS (SELECT p.vec_id, p.pos, q.code // 32 AS b, count(*) AS n, sum(q.code) AS s FROM px p CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) c(dy) JOIN px q ON q.vec_id = p.vec_id AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, pos ORDER BY n DESC, b) AS k FROM n) SELECT vec_id, pos, CAST(s // n AS BIGINT) AS out FROM r WHERE k = 1")


@query(f"WITH {PX_SQL}, g AS (SELECT p.vec_id, p.pos, sum(CASE WHEN dx <> 0 AND dy = 0 THEN q.code * dx ELSE 0 END) AS gx, sum(CASE WHEN dy <> 0 AND dx = 0 THEN q.code * dy ELSE 0 END) AS gy FROM px p CROSS JOIN range(-1, 2) a(dx) CROSS JOIN range(-1, 2) c(dy) JOIN px q ON q.vec_id = p.vec_id AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7) GROUP BY ALL) SELECT vec_id, pos, round(-gx / sqrt(gx * gx + gy * gy + 16384.0::DOUBLE), 6) + 0.0 AS nx, round(-gy / sqrt(gx * gx + gy * gy + 16384.0::DOUBLE), 6) + 0.0 AS ny, round(128 / sqrt(gx * gx + gy * gy + 16384.0::DOUBLE), 6) AS nz FROM g")
def normal_map(spark, sf_dir: str) -> DataFrame:
    c = F.col("codes")
    slopes = F.arrays_zip(nb.weighted(c, {(-1, 0): -1, (1, 0): 1}, W, H).alias("gx"), nb.weighted(c, {(0, -1): -1, (0, 1): 1}, W, H).alias("gy"))
    g = images(spark, sf_dir).select("vec_id", F.posexplode(slopes).alias("pos", "g")).select("vec_id", "pos", "g.gx", "g.gy")
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 16384.0)
    return g.select("vec_id", "pos", (F.round(-F.col("gx") / size, 6) + 0.0).alias("nx"), (F.round(-F.col("gy") / size, 6) + 0.0).alias("ny"), F.round(128 / size, 6).alias("nz"))


# The 4 x 4 ordered dither matrix.
BAYER = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)


@query(f"WITH {PX_SQL} SELECT vec_id, pos, CAST(CASE WHEN code * 16 >= ({list(BAYER)}[(y % 4) * 4 + x % 4 + 1] * 255 + 128) THEN 255 ELSE 0 END AS INT) AS out FROM px")
def dither_ordered(spark, sf_dir: str) -> DataFrame:
    level = F.get(F.array(*map(F.lit, BAYER)), (F.col("y") % 4 * 4 + F.col("x") % 4).cast("int")) * 255 + 128
    return pixels(spark, sf_dir).select("vec_id", "pos", F.when(F.col("code") * 16 >= level, 255).otherwise(0).alias("out"))


@query(f"WITH {PX_SQL}, s AS (SELECT cx, cy, cx * 4 + (cx * 7 + cy * 3) % 4 AS sx, cy * 4 + (cx * 5 + cy * 11) % 4 AS sy FROM range(2) a(cx), range(2) b(cy)), d AS (SELECT vec_id, pos, code, cx * 2 + cy AS cell, row_number() OVER (PARTITION BY vec_id, pos ORDER BY (x - sx) * (x - sx) + (y - sy) * (y - sy), cx * 2 + cy) AS k FROM px, s) SELECT vec_id, CAST(cell AS INT) AS cell, CAST(sum(code) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM d WHERE k = 1 GROUP BY 1, 2")
def crystallize(spark, sf_dir: str) -> DataFrame:
    """Sums over the cells of the nearest seeded sites; the sites are literals."""
    sites = [(cx * 4 + (cx * 7 + cy * 3) % 4, cy * 4 + (cx * 5 + cy * 11) % 4) for cx in range(2) for cy in range(2)]
    apart = F.array(*[F.struct(((F.col("x") - sx) * (F.col("x") - sx) + (F.col("y") - sy) * (F.col("y") - sy)).alias("d"), F.lit(k).alias("cell")) for k, (sx, sy) in enumerate(sites)])
    return pixels(spark, sf_dir).groupBy("vec_id", F.array_min(apart)["cell"].alias("cell")).agg(F.sum("code").cast("long").alias("total"), F.count("*").alias("n"))


@query(f"WITH {PX_SQL} SELECT DISTINCT pos, round(least(greatest((x + y) / 14.0::DOUBLE, 0), 1), 6) AS linear, round(least(sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) / 5.0::DOUBLE, 1), 6) AS radial FROM px")
def gradient_fill(spark, sf_dir: str) -> DataFrame:
    at = spark.range(64).select(F.col("id").cast("int").alias("pos"))
    x, y = F.col("pos") % 8, F.floor(F.col("pos") / 8)
    radial = F.sqrt((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) / 5.0
    return at.select("pos", F.round((x + y) / 14.0, 6).alias("linear"), F.round(F.least(radial, F.lit(1.0)), 6).alias("radial"))


def _rgb_query(name: str, body, sqls: dict[str, str], steps: str = "") -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        out = body((F.col("r"), F.col("g"), F.col("b")))
        return rgb_pixels(spark, sf_dir).select("vec_id", "pos", *[rounded(c, 6).alias(k) for k, c in zip(sqls, out, strict=True)])

    columns = ", ".join(f"round(({v})::DOUBLE, 6) + 0.0 AS {k}" for k, v in sqls.items())
    QUERIES[name] = (run, f"WITH {RGB_SQL}{steps} SELECT vec_id, pos, {columns} FROM {'t' if steps else 'rgb'}")


_Y = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


def color_balance(c):
    """Shadows, midtones and highlights weighted by luminance, the weights adding up to one."""
    y = luminance(c)
    low, high = unit(1 - 2 * y), unit(2 * y - 1)
    return tuple(unit(v + low * s + (1 - low - high) * m + high * h) for v, s, m, h in zip(c, (0.1, -0.05, 0.0), (0.05, 0.0, -0.1), (-0.1, 0.0, 0.1), strict=True))


_L, _HI = f"least(greatest(1 - 2 * {_Y}, 0.0), 1.0)", f"least(greatest(2 * {_Y} - 1, 0.0), 1.0)"
_rgb_query("color_balance", color_balance, {k: f"least(greatest({k} + {_L} * ({s}) + (1 - {_L} - {_HI}) * ({m}) + {_HI} * ({h}), 0.0), 1.0)" for k, s, m, h in (("r", 0.1, 0.05, -0.1), ("g", -0.05, 0.0, 0.0), ("b", 0.0, -0.1, 0.1))})
_rgb_query("shadows_highlights", lambda c: tuple(unit(v + 0.3 * unit(0.5 - luminance(c)) - 0.2 * unit(luminance(c) - 0.5)) for v in c), {k: f"least(greatest({k} + 0.3 * greatest(0.5 - {_Y}, 0.0) - 0.2 * greatest({_Y} - 0.5, 0.0), 0.0), 1.0)" for k in "rgb"})
_rgb_query("replace_color_mask", lambda c: (unit(1 - F.sqrt(sum(((v - k) * (v - k) for v, k in zip(c, (0.6, 0.4, 0.5), strict=True)), F.lit(0.0))) / 0.5),), {"mask": "least(greatest(1 - sqrt((r - 0.6) * (r - 0.6) + (g - 0.4) * (g - 0.4) + (b - 0.5) * (b - 0.5)) / 0.5, 0.0), 1.0)"})
_rgb_query("blend_if", lambda c: (unit((luminance(c) - 0.2) / 0.2) * unit((0.9 - luminance(c)) / 0.3),), {"weight": f"least(greatest(({_Y} - 0.2) / 0.2, 0.0), 1.0) * least(greatest((0.9 - {_Y}) / 0.3, 0.0), 1.0)"})
_rgb_query("duotone", lambda c: (unit(F.pow(luminance(c), F.lit(0.8))), unit(F.pow(luminance(c), F.lit(1.5)))), {"ink1": f"least(greatest(pow({_Y}, 0.8), 0.0), 1.0)", "ink2": f"least(greatest(pow({_Y}, 1.5), 0.0), 1.0)"})
_rgb_query("colorize", lambda c: hsl_to_rgb((F.lit(0.6), F.lit(0.4), rgb_to_hsl(c)[2])), {"r": "l + (1 - abs(2 * l - 1)) * 0.4 * (0.6 - 0.5 - 0.6)", "g": "l + (1 - abs(2 * l - 1)) * 0.4 * (least(greatest(abs(1.6 - 3) - 1, 0.0), 1.0) - 0.5)", "b": "l + (1 - abs(2 * l - 1)) * 0.4 * 0.5"}, ", t AS (SELECT *, (greatest(r, g, b) + least(r, g, b)) / 2 AS l FROM rgb)")
QUERIES["colorize"] = (QUERIES["colorize"][0], QUERIES["colorize"][1].replace("(0.6 - 0.5 - 0.6)", "(least(greatest(abs(3.6 - 3) - 1, 0.0), 1.0) - 0.5)"))


def lookup_3d(spark, sf_dir: str) -> DataFrame:
    """Trilinear sample of a 3 x 3 x 3 table whose entry is (i + 2j + 4k) squared, held as a literal array."""
    table = F.array(*[F.lit(float((i + 2 * j + 4 * k) ** 2)) for k in range(3) for j in range(3) for i in range(3)])
    c = [F.col(k) * 2 for k in ("r", "g", "b")]
    base = [F.least(F.floor(v), F.lit(1)).cast("int") for v in c]
    part = [v - k for v, k in zip(c, base, strict=True)]
    out = F.lit(0.0)
    for dk in (0, 1):
        for dj in (0, 1):
            for di in (0, 1):
                weight = (part[0] if di else 1 - part[0]) * (part[1] if dj else 1 - part[1]) * (part[2] if dk else 1 - part[2])
                out = out + weight * F.get(table, base[0] + di + 3 * (base[1] + dj) + 9 * (base[2] + dk))
    return rgb_pixels(spark, sf_dir).select("vec_id", "pos", F.round(out, 6).alias("out"))


QUERIES["lookup_3d"] = (
    lookup_3d,
    f"WITH {RGB_SQL}, t AS (SELECT vec_id, pos, r * 2 AS x, g * 2 AS y, b * 2 AS z, least(floor(r * 2), 1) AS i, least(floor(g * 2), 1) AS j, least(floor(b * 2), 1) AS k FROM rgb) SELECT vec_id, pos, round(sum((CASE WHEN di = 0 THEN 1 - (x - i) ELSE x - i END) * (CASE WHEN dj = 0 THEN 1 - (y - j) ELSE y - j END) * (CASE WHEN dk = 0 THEN 1 - (z - k) ELSE z - k END) * pow(i + di + 2 * (j + dj) + 4 * (k + dk), 2)), 6) AS out FROM t, range(2) a(di), range(2) b(dj), range(2) c(dk) GROUP BY vec_id, pos",
)


@query("WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'logout' THEN -1 ELSE 1 END AS d FROM events), c AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM s) SELECT user_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(arg_max(depth, event_id) AS BIGINT) AS depth FROM c GROUP BY 1")
def undo_depth(spark, sf_dir: str) -> DataFrame:
    """Depth of each history, where one kind of event takes a step back."""
    step = F.when(F.col("event_type") == "logout", -1).otherwise(1)
    depth = F.sum(step).over(Window.partitionBy("user_id").orderBy("event_id"))
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", depth.alias("depth"))
    return d.groupBy("user_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "event_id").alias("depth"))


@query("WITH p AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS far, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity AS near FROM lineitem) SELECT l_orderkey, CAST(sum(floor(far / 7) - floor(near / 7)) AS BIGINT) AS dabs, CAST(max(CAST(far AS INT) % 7) AS INT) AS carried FROM p GROUP BY 1")
def dab_spacing(spark, sf_dir: str) -> DataFrame:
    """Dabs set every 7 units along a stroke's segments; what is left of a segment is carried into the next."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.sum("l_quantity").over(w).alias("far"), "l_quantity")
    dabs = F.floor(F.col("far") / 7) - F.floor((F.col("far") - F.col("l_quantity")) / 7)
    return p.groupBy("l_orderkey").agg(F.sum(dabs).cast("long").alias("dabs"), F.max(F.col("far").cast("int") % 7).alias("carried"))


@query("WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders) SELECT o_orderkey, round(CASE WHEN n < 3 THEN NULL ELSE lo + (hi - lo) * (k - 1) / (n - 1) END, 7) AS place FROM s")
def distribute_layers(spark, sf_dir: str) -> DataFrame:
    """Equal spacing between the outermost of each group of three or more."""
    w = Window.partitionBy("o_custkey")
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).alias("k"), F.count("*").over(w).alias("n"), F.min("o_totalprice").over(w).alias("lo"), F.max("o_totalprice").over(w).alias("hi"))
    place = F.when(F.col("n") >= 3, F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") - 1) / F.when(F.col("n") > 1, F.col("n") - 1).otherwise(1))
    return s.select("o_orderkey", F.round(place, 7).alias("place"))


@query("WITH c AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ends, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity AS starts FROM lineitem) SELECT o_orderkey, l_linenumber FROM orders JOIN c ON o_orderkey = l_orderkey WHERE o_orderkey % 60 >= starts AND o_orderkey % 60 < ends")
def shown_at(spark, sf_dir: str) -> DataFrame:
    """The clip shown at a time: starts <= t < ends on one track, an equi-join on the track with the interval as a filter."""
    ends = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    c = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", ends.alias("ends"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 60).alias("t"))
    hit = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("t") >= F.col("ends") - F.col("l_quantity")) & (F.col("t") < F.col("ends"))
    return o.join(c, hit).select("o_orderkey", "l_linenumber")


def _rgb_codes(spark, sf_dir: str) -> DataFrame:
    return rgb_pixels(spark, sf_dir).select("vec_id", "pos", *[F.round(F.col(k) * 255).cast("int").alias(k) for k in ("r", "g", "b")])


@query(None)
def median_cut_palette(spark, sf_dir: str) -> DataFrame:
    """Each pixel's entry in a palette of 16 colours cut from all pixels."""
    px = _rgb_codes(spark, sf_dir)
    palette = palettes.median_cut(palettes.color_histogram(px), 16)
    return px.select("vec_id", "pos", palettes.nearest_entry((F.col("r"), F.col("g"), F.col("b")), palette).alias("entry"))


_WEB = "SELECT vec_id, pos, CAST((r + 25) // 51 * 36 + (g + 25) // 51 * 6 + (b + 25) // 51 AS INT) AS entry FROM c"


@query(f"WITH {RGB_SQL}, c AS (SELECT vec_id, pos, CAST(round(r * 255) AS INT) AS r, CAST(round(g * 255) AS INT) AS g, CAST(round(b * 255) AS INT) AS b FROM rgb) {_WEB}")
def web_palette_index(spark, sf_dir: str) -> DataFrame:
    """The nearest of the 216 web colours, whose grid makes it a rounding."""
    step = lambda k: F.floor((F.col(k) + 25) / 51).cast("int")
    return _rgb_codes(spark, sf_dir).select("vec_id", "pos", (step("r") * 36 + step("g") * 6 + step("b")).alias("entry"))
