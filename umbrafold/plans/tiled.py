"""Queries on images larger than a tile, each with its DuckDB SQL over the whole image.

The images are sheets of the embedding rasters: vectors of the same remainder by 3 stand in rows of nine, and a sheet is cut
off at 67 pixels, so that its tiles of 24 pixels end unevenly on both sides. Places without a vector are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.functions import noise
from umbrafold.operators import layer_effects, resampling, tiles
from umbrafold.plans import adjustments, neighbors
from umbrafold.sources.rasters import PX_SQL, RGB_SQL, pixels, rgb_pixels

QUERIES: dict = {}
SIDE, SHEETS, ACROSS, WIDTH = 24, 3, 9, 67
SHEET_SQL = f"""{PX_SQL}, placed AS (
  SELECT vec_id % {SHEETS} AS image, vec_id // {SHEETS} % {ACROSS} * 8 + x AS x, vec_id // {SHEETS} // {ACROSS} * 8 + y AS y, code FROM px),
sizes AS (SELECT image, {WIDTH} AS width, ((m - image) // {SHEETS} // {ACROSS} + 1) * 8 AS height FROM range({SHEETS}) r(image), (SELECT max(vec_id) AS m FROM embeddings)),
sheet AS MATERIALIZED (
  SELECT s.image, s.width, s.height, x.x, y.y, coalesce(p.code, 0) AS v
  FROM sizes s JOIN range({WIDTH}) x(x) ON x.x < s.width JOIN (SELECT unnest(range(max(height))) AS y FROM sizes) y ON y.y < s.height
  LEFT JOIN placed p ON p.image = s.image AND p.x = x.x AND p.y = y.y)"""
EDGES_SQL = {
    "clamp": "least(greatest({0}, 0), {1} - 1)",
    "wrap": "(({0}) % {1} + {1}) % {1}",
    "mirror": "CASE WHEN (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) < {1} THEN (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) ELSE 2 * {1} - 1 - (({0}) % (2 * {1}) + 2 * {1}) % (2 * {1}) END",
}


def sheet_pixels(spark, sf_dir: str) -> DataFrame:
    """The sheets' pixels where there is a vector."""
    px = pixels(spark, sf_dir)
    last = px.agg(F.max("vec_id").alias("m"))  # one row
    image, k = F.col("vec_id") % SHEETS, F.floor(F.col("vec_id") / SHEETS)
    rows = px.crossJoin(F.broadcast(last)).select(image.alias("image"), (k % ACROSS * 8 + F.col("x")).alias("x"), (F.floor(k / ACROSS) * 8 + F.col("y")).alias("y"), F.col("code").alias("v"), F.lit(WIDTH).alias("width"), ((F.floor(F.floor((F.col("m") - image) / SHEETS) / ACROSS) + 1) * 8).alias("height"))
    return rows


def sheets(spark, sf_dir: str) -> DataFrame:
    """The sheets as tiles."""
    return tiles.cut(sheet_pixels(spark, sf_dir), SIDE)


def around_sql(radius: int, edge: str, out: str) -> str:
    """`out` over each pixel's square: own, dx, dy and v are at hand."""
    xs, ys = EDGES_SQL[edge].format("p.x + dx", "p.width"), EDGES_SQL[edge].format("p.y + dy", "p.height")
    return f"""WITH {SHEET_SQL}, asked AS MATERIALIZED (
  SELECT p.image, p.x, p.y, p.v AS own, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, {xs} AS sx, {ys} AS sy
  FROM sheet p CROSS JOIN range({-radius}, {radius + 1}) a(dx) CROSS JOIN range({-radius}, {radius + 1}) b(dy)),
n AS (SELECT a.image, a.x, a.y, a.own, a.dx, a.dy, q.v FROM asked a JOIN sheet q ON q.image = a.image AND q.x = a.sx AND q.y = a.sy)
SELECT image, x, y, {out} AS out FROM n GROUP BY image, x, y"""


def _query(name: str, margin: int, kernel: tiles.Kernel, edge: str, sql: str, digits: int | None = None) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        out = F.col("v").cast("long") if digits is None else F.round("v", digits)
        return tiles.spread(tiles.filtered(sheets(spark, sf_dir), SIDE, margin, kernel, edge), SIDE).select("image", "x", "y", out.alias("out"))

    QUERIES[name] = (run, sql)


_query("tiled_box_wrap", 3, tiles.box_total(3), "wrap", around_sql(3, "wrap", "CAST(sum(v) AS BIGINT)"))
_query("tiled_box_wide", 30, tiles.box_total(2), "mirror", around_sql(2, "mirror", "CAST(sum(v) AS BIGINT)"))
_query("tiled_median", 2, tiles.median(2), "clamp", around_sql(2, "clamp", "CAST(quantile_disc(v, 0.5) AS BIGINT)"))
_BELL = [math.exp(-d * d / 2) for d in range(-3, 4)]
_WEIGHT = "[" + ", ".join(f"{w / sum(_BELL)!r}::DOUBLE" for w in _BELL) + "]"
_query("tiled_gaussian", 3, tiles.gaussian(1.0), "mirror", around_sql(3, "mirror", f"round(sum(v * {_WEIGHT}[dx + 4] * {_WEIGHT}[dy + 4]), 4)"), 4)
_query("tiled_sobel", 1, tiles.sobel, "clamp", around_sql(1, "clamp", "CAST(pow(sum(v * dx * (2 - abs(dy))), 2) + pow(sum(v * dy * (2 - abs(dx))), 2) AS BIGINT)"))
# the filters of these names; what stood in for them goes on under other ones
for _name, _kept in (("despeckle", "despeckle_flat"), ("select_smooth", "select_smooth_majority"), ("diffuse", "diffuse_fixed")):
    neighbors.QUERIES[_kept] = neighbors.QUERIES.pop(_name)
adjustments.QUERIES["blend_dissolve_fixed"] = adjustments.QUERIES.pop("blend_dissolve")
_query("despeckle", 1, tiles.median(1), "clamp", around_sql(1, "clamp", "CAST(quantile_disc(v, 0.5) AS BIGINT)"))
_MEMBERS = "SELECT image, x, y, list(v ORDER BY CASE WHEN dx = 0 AND dy = 0 THEN -1 ELSE dy * 3 + dx + 4 END) AS m FROM n GROUP BY image, x, y"
_query("facet", 1, tiles.medoid, "clamp", around_sql(1, "clamp", "0").rpartition("SELECT image")[0].rstrip() + f""", w AS ({_MEMBERS}), c AS (
  SELECT image, x, y, i, m[i] AS v, list_sum(list_transform(m, lambda o: abs(o - m[i]))) AS cost FROM w, range(1, 10) r(i))
SELECT image, x, y, CAST(arg_min(v, cost * 16 + i) AS BIGINT) AS out FROM c GROUP BY image, x, y""")  # fmt: skip
_DISC = "dx * dx + dy * dy <= 16"
_AREA = sum(1 for dx in range(-4, 5) for dy in range(-4, 5) if dx * dx + dy * dy <= 16)
_S = f"least(greatest((sum(CASE WHEN {_DISC} THEN v ELSE 0 END) / (255.0::DOUBLE * {_AREA}) - 0.5) * {2.5 * _AREA / 9}::DOUBLE + 0.5, 0), 1)"


def _crisp(canvas, margin, x0, y0):
    return (canvas >= 128) * 255.0


def _smooth(canvas, margin, x0, y0):
    return tiles.disc_smooth(4)(_crisp(canvas, margin, x0, y0), margin, x0, y0)


_query("select_smooth", 4, _smooth, "zero", f"""WITH {SHEET_SQL}, crisp AS (SELECT image, x, y, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v FROM sheet), asked AS MATERIALIZED (
  SELECT p.image, p.x, p.y, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, p.x + dx AS sx, p.y + dy AS sy FROM crisp p CROSS JOIN range(-4, 5) a(dx) CROSS JOIN range(-4, 5) b(dy)),
n AS (SELECT a.image, a.x, a.y, a.dx, a.dy, q.v FROM asked a JOIN crisp q ON q.image = a.image AND q.x = a.sx AND q.y = a.sy), s AS (SELECT image, x, y, {_S} AS s FROM n GROUP BY image, x, y)
SELECT image, x, y, CAST(floor(s * s * (3 - 2 * s) * 255 + 0.5) AS BIGINT) AS out FROM s""")  # fmt: skip


def _steps_sql(source: str, name: str, start: str, shifts: tuple[int, int, int]) -> str:
    """Common table expressions after `source` that end in `name` with its columns and z, the mixed bits."""
    a, b, c = noise.mixed_sql("z", shifts)
    return f"{name}0 AS (SELECT *, {start} AS z FROM {source}), {name}1 AS (SELECT * REPLACE ({a} AS z) FROM {name}0), {name}2 AS (SELECT * REPLACE ({b} AS z) FROM {name}1), {name} AS (SELECT * REPLACE ({c} AS z) FROM {name}2)"


_START = lambda seed: noise.start_sql("x", "y", noise.HASH_X, noise.HASH_Y, seed + noise.GOLDEN)
_DRAW = "CAST(trunc(CAST(z >> 40 AS FLOAT) * CAST(1.0 / 16777216 AS FLOAT) * CAST(5 AS FLOAT)) AS BIGINT) - 2"
_query("diffuse", 3, tiles.diffused(2, 9), "clamp", f"""WITH {SHEET_SQL}, {_steps_sql("sheet", "u", _START(9), noise.HASH_SHIFTS)}, {_steps_sql("(SELECT * RENAME (z AS zx) FROM u)", "w", _START(9 ^ noise.SECOND_DIFFUSE), noise.HASH_SHIFTS)},
d AS MATERIALIZED (SELECT image, x, y, least(greatest(x + {_DRAW.replace("z >>", "zx >>")}, 0), width - 1) AS sx, least(greatest(y + {_DRAW}, 0), height - 1) AS sy FROM w)
SELECT d.image, d.x, d.y, CAST(q.v AS BIGINT) AS out FROM d JOIN sheet q ON q.image = d.image AND q.x = d.sx AND q.y = d.sy""")  # fmt: skip



def cells_moved(spark, sf_dir: str) -> DataFrame:
    """Five cells across, each moved by a third of its side at most, over the inverse image."""
    px = tiles.spread(sheets(spark, sf_dir), SIDE)
    tall = sheet_pixels(spark, sf_dir).groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"))  # a row for each sheet
    out = tiles.shifted_cells(px.join(tall, "image"), 5, 33.0, 17, lambda v: 255 - v)
    return out.select("image", "x", "y", F.col("v").cast("long").alias("out"))


_CELL = lambda seed: noise.start_sql("tx", "ty", noise.HASH_X, noise.HASH_Y, seed + noise.GOLDEN)
_AT = lambda z: f"(CAST({z} >> 40 AS FLOAT) * CAST(1.0 / 16777216 AS FLOAT) * CAST(2 AS FLOAT) - CAST(1 AS FLOAT)) * (CAST(33 AS FLOAT) / CAST(100 AS FLOAT) * CAST(side AS FLOAT))"
_STEP = lambda a: f"CASE WHEN round({a}) <> 0 THEN CAST(round({a}) AS BIGINT) WHEN {a} < 0 THEN -1 ELSE 1 END"
QUERIES["tiles"] = (cells_moved, f"""WITH {SHEET_SQL}, cells AS (SELECT image, side, a.i AS tx, b.i AS ty FROM (SELECT image, width, height, CAST(ceil(least(width, height) / 5.0) AS BIGINT) AS side FROM sizes) s, range(200) a(i), range(200) b(i) WHERE a.i * side < width AND b.i * side < height),
{_steps_sql("cells", "u", _CELL(17), noise.HASH_SHIFTS)}, {_steps_sql("(SELECT * RENAME (z AS zx) FROM u)", "w", _CELL(17 ^ noise.SECOND_TILES), noise.HASH_SHIFTS)},
moves AS MATERIALIZED (SELECT image, side, tx, ty, {_STEP(_AT("zx"))} AS ox, {_STEP(_AT("z"))} AS oy FROM w),
near AS MATERIALIZED (SELECT p.image, p.x, p.y, p.v, p.width, p.height, m.tx, m.ty, m.side, p.x - m.ox AS sx, p.y - m.oy AS sy FROM sheet p JOIN moves m ON m.image = p.image AND abs(p.x // m.side - m.tx) <= 1 AND abs(p.y // m.side - m.ty) <= 1),
hits AS (SELECT n.image, n.x, n.y, n.ty * 1000 + n.tx AS nr, q.v FROM near n JOIN sheet q ON q.image = n.image AND q.x = n.sx AND q.y = n.sy WHERE n.sx // n.side = n.tx AND n.sy // n.side = n.ty)
SELECT p.image, p.x, p.y, CAST(coalesce(arg_max(h.v, h.nr), 255 - any_value(p.v)) AS BIGINT) AS out FROM sheet p LEFT JOIN hits h ON h.image = p.image AND h.x = p.x AND h.y = p.y GROUP BY p.image, p.x, p.y""")  # fmt: skip


def blend_dissolve(spark, sf_dir: str) -> DataFrame:
    """The source at 60 % opacity shows whole where a pixel draws less than that. Images stand one below the other."""
    keep = noise.dissolve_noise(F.col("x"), F.col("y") + 8 * F.col("vec_id"), 0, 7) < 0.6
    return rgb_pixels(spark, sf_dir).select("vec_id", "pos", F.round(F.when(keep, F.col("g")).otherwise(F.col("r")), 9).alias("out"))


_DISSOLVE = noise.start_sql("x", "(y + 8 * vec_id)", noise.DISSOLVE_X, noise.DISSOLVE_Y, 7)
QUERIES["blend_dissolve"] = (blend_dissolve, f"WITH {RGB_SQL}, {_steps_sql('rgb', 'u', _DISSOLVE, noise.DISSOLVE_SHIFTS)} SELECT vec_id, pos, round(CASE WHEN (z >> 40) / 16777216.0::DOUBLE < 0.6 THEN g ELSE r END, 9) AS out FROM u")



def add_noise(spark, sf_dir: str) -> DataFrame:
    """Uniform noise of a quarter, the same for all channels of even images, drawn for each channel of odd ones. Images stand side by side."""
    px = rgb_pixels(spark, sf_dir)
    x = F.col("x") + 8 * F.col("vec_id")
    draws = px.select("vec_id", "pos", "r", "g", "b", *(noise.signed_draw(3, x, F.col("y"), k).alias(f"d{k}") for k in (1, 2, 3, 4)))
    noisy = lambda c, k: F.round(F.least(F.greatest(F.col(c) + F.when(F.col("vec_id") % 2 == 0, F.col("d1")).otherwise(F.col(f"d{k}")) * 0.25, F.lit(0.0)), F.lit(1.0)), 9).alias(c)
    return draws.select("vec_id", "pos", noisy("r", 2), noisy("g", 3), noisy("b", 4))


def _drawn_sql(source: str, k: int) -> str:
    """CTEs that end in d{k} with the kth draw as d{k}, from `source` with the hash as h."""
    start = f"CAST((h::UHUGEINT + {k * noise.GOLDEN & noise.MASK}::UHUGEINT) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"
    return _steps_sql(source, f"m{k}", start, noise.DISSOLVE_SHIFTS) + f", d{k} AS (SELECT * EXCLUDE (z), (z >> 40) / 16777216.0::DOUBLE * 2 - 1 AS d{k} FROM m{k})"


_HASHED = _steps_sql("rgb", "u", noise.start_sql("(x + 8 * vec_id)", "y", noise.HASH_X, noise.HASH_Y, 3 + noise.GOLDEN), noise.HASH_SHIFTS)
_NOISY = lambda c, k: f"round(least(greatest({c} + CASE WHEN vec_id % 2 = 0 THEN d1 ELSE d{k} END * 0.25::DOUBLE, 0), 1), 9) AS {c}"
QUERIES["add_noise"] = (add_noise, f"WITH {RGB_SQL}, {_HASHED}, h AS (SELECT * RENAME (z AS h) FROM u), {_drawn_sql('h', 1)}, {_drawn_sql('d1', 2)}, {_drawn_sql('d2', 3)}, {_drawn_sql('d3', 4)} SELECT vec_id, pos, {_NOISY('r', 2)}, {_NOISY('g', 3)}, {_NOISY('b', 4)} FROM d4")

_SEED, _SCALE, _OCTAVES = 21, 10, 3
_CORNER = lambda dx, dy: "(gx[{g}] * (fx - {dx}) + gy[{g}] * (fy - {dy}))".format(dx=dx, dy=dy, g=f"((perm[((yi + {dy} + perm[((xi + {dx}) & 255) + 1]) & 255) + 1]) & 7) + 1")
_CLOUDS_SQL = f"""WITH {SHEET_SQL}, fixed AS (SELECT {noise.permutation(_SEED)} AS perm, {[f"{g[0]!r}" for g in noise.GRADIENTS]}::DOUBLE[] AS gx, {[f"{g[1]!r}" for g in noise.GRADIENTS]}::DOUBLE[] AS gy),
scaled AS (SELECT image, x, y, v, k.k, (x + 0.5::DOUBLE) / {_SCALE} * pow(2, k.k) AS px, (y + 0.5::DOUBLE) / {_SCALE} * pow(2, k.k) AS py FROM sheet, range({_OCTAVES}) k(k)),
lattice AS (SELECT image, x, y, v, k, CAST(floor(px) AS BIGINT) % 256 AS xi, CAST(floor(py) AS BIGINT) % 256 AS yi, px - floor(px) AS fx, py - floor(py) AS fy FROM scaled),
corners AS (SELECT image, x, y, v, k, fx * fx * fx * (fx * (fx * 6 - 15) + 10) AS fu, fy * fy * fy * (fy * (fy * 6 - 15) + 10) AS fv, {_CORNER(0, 0)} AS n00, {_CORNER(1, 0)} AS n10, {_CORNER(0, 1)} AS n01, {_CORNER(1, 1)} AS n11 FROM lattice, fixed),
lines AS (SELECT image, x, y, v, k, fv, n00 + fu * (n10 - n00) AS a, n01 + fu * (n11 - n01) AS b FROM corners),
octave AS (SELECT image, x, y, v, least(greatest((a + fv * (b - a)) * sqrt(2), -1), 1) / pow(2, k) AS o FROM lines),
field AS (SELECT image, x, y, v, 0.5 * (least(greatest(sum(o) / {sum(0.5**k for k in range(_OCTAVES))}::DOUBLE, -1), 1) + 1) AS t FROM octave GROUP BY ALL)
SELECT image, x, y, round(@, 6) AS out FROM field"""
_query("clouds", 0, tiles.clouds(_SEED, _SCALE, _OCTAVES), "zero", _CLOUDS_SQL.replace("@", "t"), 6)
_query("difference_clouds", 0, tiles.clouds(_SEED, _SCALE, _OCTAVES, against=True), "zero", _CLOUDS_SQL.replace("@", "abs(v / 255.0::DOUBLE - t)"), 6)


# effects along the outline of what a sheet covers
def _outline_sql(reach: int, out: str) -> str:
    """`out` from s, the signed distance, and v, the coverage."""
    length = "greatest(abs(dx), abs(dy)) + (sqrt(2) - 1) * least(abs(dx), abs(dy))"
    return f"""WITH {SHEET_SQL}, asked AS MATERIALIZED (
  SELECT p.image, p.x, p.y, p.v, p.x + dx AS sx, p.y + dy AS sy, {length} AS d FROM sheet p CROSS JOIN range({-reach}, {reach + 1}) a(dx) CROSS JOIN range({-reach}, {reach + 1}) b(dy)),
n AS (SELECT a.image, a.x, a.y, a.v, a.d, coalesce(q.v, 0) >= 128 AS covered FROM asked a LEFT JOIN sheet q ON q.image = a.image AND q.x = a.sx AND q.y = a.sy),
t AS (SELECT image, x, y, v, CASE WHEN v >= 128 THEN 0.5 - coalesce(min(d) FILTER (NOT covered), 1e9) ELSE coalesce(min(d) FILTER (covered), 1e9) - 0.5 END AS t FROM n GROUP BY image, x, y, v),
s AS (SELECT image, x, y, v / 255.0::DOUBLE AS v, CASE WHEN abs(t) <= 0.5 AND v > 0 AND v < 255 THEN 0.5 - v / 255.0::DOUBLE ELSE t END AS s FROM t)
SELECT image, x, y, round({out}, 6) AS out FROM s"""


_UNIT = "least(greatest({0}, 0), 1)"
_GROWN = lambda by: _UNIT.format(f"0.5::DOUBLE + {by}::DOUBLE - s")
for _position, _inner, _outer in (("outside", 0.0, 2.5), ("inside", -2.5, 0.0), ("center", -1.25, 1.25)):
    _query(f"effect_stroke_{_position}", 5, layer_effects.stroke(2.5, _position, 0.8), "zero", _outline_sql(5, f"{_UNIT.format(f'{_GROWN(_outer)} - {_GROWN(_inner)}')} * 0.8::DOUBLE"), 6)
_query("effect_outer_glow", 6, layer_effects.glow(3.0, 0.2, 0.75, 0.6), "zero", _outline_sql(6, f"{_UNIT.format('(' + _UNIT.format('1 - (s - 0.6::DOUBLE) / 3') + ' - 0.25::DOUBLE) / 0.75::DOUBLE')} * 0.6::DOUBLE"), 6)
_query("effect_inner_glow", 5, layer_effects.glow(3.0, inner=True), "zero", _outline_sql(5, f"{_UNIT.format('1 + s / 3')} * v"), 6)


# resampling to 41 pixels across and half as many again down, by weights in a table
_FORMS = {
    "triangle": (1, "greatest(1 - abs(d), 0)"),
    "mitchell": (2, "CASE WHEN abs(d) < 1 THEN (7 * pow(abs(d), 3) - 12 * d * d + 16 / 3.0::DOUBLE) / 6 WHEN abs(d) < 2 THEN (-7 / 3.0::DOUBLE * pow(abs(d), 3) + 12 * d * d - 20 * abs(d) + 32 / 3.0::DOUBLE) / 6 ELSE 0 END"),
    "lanczos3": (3, "CASE WHEN d = 0 THEN 1 WHEN abs(d) < 3 THEN 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * pi() * d * d) ELSE 0 END"),
}


def _taps_sql(name: str, src: str, dst: str, kind: str) -> str:
    radius, form = _FORMS[kind]
    scale = f"greatest({src} / CAST({dst} AS DOUBLE), 1)"
    return f"""{name}0 AS (SELECT image, {src} AS n, i.i, (i.i + 0.5) * {src} / {dst}::DOUBLE AS c, {scale} AS s FROM sizes, (SELECT unnest(range(400)) AS i) i WHERE i.i < {dst}),
{name}1 AS (SELECT image, n, i, j.j, (j.j + 0.5 - c) / s AS d FROM {name}0, (SELECT unnest(range(-20, 400)) AS j) j WHERE j.j >= ceil(c - {radius} * s - 0.5) AND j.j <= floor(c + {radius} * s - 0.5)),
{name}2 AS (SELECT image, i, least(greatest(j, 0), n - 1) AS j, {form} AS w FROM {name}1),
{name} AS MATERIALIZED (SELECT image, i, j, sum(w) / sum(sum(w)) OVER (PARTITION BY image, i) AS w FROM {name}2 GROUP BY image, i, j)"""


for _kind in _FORMS:

    def resample(spark, sf_dir: str, kind: str = _kind) -> DataFrame:
        out = resampling.resampled(sheets(spark, sf_dir), SIDE, F.lit(41), F.floor(F.col("height") * 3 / 2), kind)
        return tiles.spread(out, SIDE).select("image", "x", "y", F.round("v", 7).alias("out"))

    QUERIES[f"resample_{_kind}"] = (resample, f"""WITH {SHEET_SQL}, {_taps_sql("tx", "width", "41", _kind)}, {_taps_sql("ty", "height", "(height * 3 // 2)", _kind)},
across AS MATERIALIZED (SELECT s.image, t.i AS x, s.y, sum(s.v * t.w) AS v FROM sheet s JOIN tx t ON t.image = s.image AND t.j = s.x GROUP BY ALL)
SELECT a.image, a.x, t.i AS y, round(sum(a.v * t.w), 7) AS out FROM across a JOIN ty t ON t.image = a.image AND t.j = a.y GROUP BY ALL""")  # fmt: skip
