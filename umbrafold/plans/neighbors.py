"""Neighbourhood and geometric queries over the images, each with its DuckDB SQL as a join of pixels with their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.operators import neighborhood as nb
from umbrafold.sources.rasters import HEIGHT, PX_SQL, WIDTH, images

QUERIES: dict = {}
EDGES_SQL = {
    "clamp": "least(greatest({0}, 0), 7)",
    "wrap": "(({0}) % 8 + 8) % 8",
    "mirror": "CASE WHEN (({0}) % 16 + 16) % 16 < 8 THEN (({0}) % 16 + 16) % 16 ELSE 15 - (({0}) % 16 + 16) % 16 END",
}


def _exploded(img: DataFrame, out) -> DataFrame:
    return img.select("vec_id", F.posexplode(out).alias("pos", "out")).select("vec_id", "pos", F.col("out").cast("long").alias("out"))


def _neighbours_sql(rx: int, ry: int, edge: str = "clamp", aggregate: str = "sum(code)", weight: str = "") -> str:
    e = EDGES_SQL[edge]
    return f"""WITH {PX_SQL}, n AS (
  SELECT p.vec_id, p.pos, p.code AS own, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, q.code {weight and ", " + weight + " AS w"}
  FROM px p CROSS JOIN range({-rx}, {rx + 1}) a(dx) CROSS JOIN range({-ry}, {ry + 1}) b(dy)
  JOIN px q ON q.vec_id = p.vec_id AND q.x = {e.format("p.x + dx")} AND q.y = {e.format("p.y + dy")})
SELECT vec_id, pos, CAST({aggregate} AS BIGINT) AS out FROM n GROUP BY vec_id, pos"""


def _query(name: str, body, sql: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        img = images(spark, sf_dir)
        return _exploded(img, nb.bound(F.col("codes"), lambda codes: body(codes)))

    QUERIES[name] = (run, sql)


W, H = WIDTH, HEIGHT
_query("box_sum_h", lambda c: nb.gathered(c, nb.line(2), W, H, nb.total), _neighbours_sql(2, 0))
_query("box_sum_2d", lambda c: nb.box_sum(c, 1, W, H), _neighbours_sql(1, 1))
_query("box_sum_wrap", lambda c: nb.box_sum(c, 2, W, H, nb.wrap), _neighbours_sql(2, 2, "wrap"))
_query("box_sum_mirror", lambda c: nb.box_sum(c, 2, W, H, nb.mirror), _neighbours_sql(2, 2, "mirror"))
_query("erode", lambda c: nb.minimum(c, 1, W, H), _neighbours_sql(1, 1, aggregate="min(code)"))
_query("dilate", lambda c: nb.maximum(c, 1, W, H), _neighbours_sql(1, 1, aggregate="max(code)"))
_query("median_3x3", lambda c: nb.median(c, 1, W, H), _neighbours_sql(1, 1, aggregate="quantile_disc(code, 0.5)"))
_query("median_5x5", lambda c: nb.median(c, 2, W, H), _neighbours_sql(2, 2, aggregate="quantile_disc(code, 0.5)"))


def _weights_sql(kernel: dict) -> str:
    return "CASE " + " ".join(f"WHEN dx = {dx} AND dy = {dy} THEN {w}" for (dx, dy), w in kernel.items()) + " ELSE 0 END"


for _name, _kernel in (("emboss", nb.EMBOSS), ("sharpen", nb.SHARPEN), ("binomial_blur", nb.BINOMIAL), ("laplace", nb.LAPLACE), ("sobel_x", nb.SOBEL_X), ("sobel_y", nb.SOBEL_Y), ("custom_3x3", {(-1, -1): 2, (0, 0): 3, (1, 0): -1, (0, 1): 4})):
    _query(_name, lambda c, k=_kernel: nb.weighted(c, k, W, H), _neighbours_sql(1, 1, aggregate="sum(code * w)", weight=_weights_sql(_kernel)))


def _sum_of(values: list, fn):
    return sum((fn(v) for v in values), F.lit(0))


_query(
    "find_edges",
    lambda c: F.zip_with(nb.weighted(c, nb.SOBEL_X, W, H), nb.weighted(c, nb.SOBEL_Y, W, H), lambda a, b: a * a + b * b),
    _neighbours_sql(1, 1, aggregate="pow(sum(code * w), 2) + pow(sum(code * w2), 2)", weight=_weights_sql(nb.SOBEL_X) + " AS w2x, " + _weights_sql(nb.SOBEL_Y)).replace(" AS w2x", " AS w2").replace("sum(code * w)", "sum(code * w2)", 1).replace("+ pow(sum(code * w2), 2)", "+ pow(sum(code * w), 2)"),
)
_query("fragment", lambda c: nb.gathered(c, [(-1, -1), (1, -1), (-1, 1), (1, 1)], W, H, nb.total), _neighbours_sql(1, 1, aggregate="sum(CASE WHEN abs(dx) = 1 AND abs(dy) = 1 THEN code ELSE 0 END)"))
_query("high_pass", lambda c: F.zip_with(c, nb.box_sum(c, 1, W, H), lambda v, s: 9 * v - s), _neighbours_sql(1, 1, aggregate="9 * max(own) - sum(code)"))
_query("unsharp", lambda c: F.zip_with(c, nb.box_sum(c, 1, W, H), lambda v, s: F.when(F.abs(9 * v - s) >= 90, 9 * v + (9 * v - s)).otherwise(9 * v)), _neighbours_sql(1, 1, aggregate="CASE WHEN abs(9 * max(own) - sum(code)) >= 90 THEN 18 * max(own) - sum(code) ELSE 9 * max(own) END"))
_query("dust_and_scratches", lambda c: F.zip_with(c, nb.median(c, 1, W, H), lambda v, m: F.when(F.abs(v - m) > 20, m).otherwise(v)), _neighbours_sql(1, 1, aggregate="CASE WHEN abs(max(own) - quantile_disc(code, 0.5)) > 20 THEN quantile_disc(code, 0.5) ELSE max(own) END"))
_query("smart_blur_sum", lambda c: nb.each_pixel(W, H, lambda x, y: _sum_of([nb.at(c, x + dx, y + dy, W, H) for dx, dy in nb.square(1)], lambda v: F.when(F.abs(v - nb.at(c, x, y, W, H)) <= 24, v).otherwise(0))), _neighbours_sql(1, 1, aggregate="sum(CASE WHEN abs(code - own) <= 24 THEN code ELSE 0 END)"))
_query("surface_blur_sum", lambda c: nb.each_pixel(W, H, lambda x, y: _sum_of([nb.at(c, x + dx, y + dy, W, H) for dx, dy in nb.square(1)], lambda v: v * F.greatest(F.lit(0), 40 - F.abs(v - nb.at(c, x, y, W, H))))), _neighbours_sql(1, 1, aggregate="sum(code * greatest(0, 40 - abs(code - own)))"))
_query("sharpen_edges", lambda c: nb.each_pixel(W, H, lambda x, y: F.when(F.array_max(F.array(*[F.abs(nb.at(c, x + dx, y + dy, W, H) - nb.at(c, x, y, W, H)) for dx, dy in nb.square(1)])) >= 40, 5 * nb.at(c, x, y, W, H) - _sum_of([(1, 0), (-1, 0), (0, 1), (0, -1)], lambda d: nb.at(c, x + d[0], y + d[1], W, H))).otherwise(nb.at(c, x, y, W, H))), _neighbours_sql(1, 1, aggregate="CASE WHEN max(abs(code - own)) >= 40 THEN 5 * max(own) - sum(CASE WHEN abs(dx) + abs(dy) = 1 THEN code ELSE 0 END) ELSE max(own) END"))
_query("trace_contour", lambda c: nb.each_pixel(W, H, lambda x, y: F.when((nb.at(c, x, y, W, H) < 128) & (F.array_max(F.array(*[nb.at(c, x + dx, y + dy, W, H) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])) >= 128), 1).otherwise(0)), _neighbours_sql(1, 1, aggregate="CASE WHEN max(own) < 128 AND max(CASE WHEN abs(dx) + abs(dy) = 1 THEN code ELSE 0 END) >= 128 THEN 1 ELSE 0 END"))
_OCTAGON = [(dx, dy) for dx, dy in nb.square(2) if abs(dx) + abs(dy) <= 3]
_query("expand_selection", lambda c: nb.gathered(F.transform(c, lambda v: F.when(v >= 128, 255).otherwise(0)), _OCTAGON, W, H, F.array_max), _neighbours_sql(2, 2, aggregate="max(CASE WHEN abs(dx) + abs(dy) <= 3 AND code >= 128 THEN 255 ELSE 0 END)"))
_query("contract_selection", lambda c: nb.gathered(F.transform(c, lambda v: F.when(v >= 128, 255).otherwise(0)), _OCTAGON, W, H, F.array_min), _neighbours_sql(2, 2, aggregate="min(CASE WHEN abs(dx) + abs(dy) <= 3 THEN CASE WHEN code >= 128 THEN 255 ELSE 0 END ELSE 255 END)"))


def gaussian_blur(spark, sf_dir: str) -> DataFrame:
    img = images(spark, sf_dir)
    out = img.select("vec_id", F.posexplode(nb.weighted(F.col("codes"), nb.gaussian_kernel(0.8), W, H)).alias("pos", "out"))
    return out.select("vec_id", "pos", F.round("out", 4).alias("out"))


_G = nb.gaussian_kernel(0.8)
QUERIES["gaussian_blur"] = (gaussian_blur, _neighbours_sql(3, 3, aggregate="sum(code * w)", weight=_weights_sql({k: repr(v) + "::DOUBLE" for k, v in _G.items()})).replace("CAST(sum(code * w) AS BIGINT)", "round(sum(code * w), 4)"))

# geometry: where each pixel comes from
REMAPS = {
    "flip_horizontal": (lambda x, y: (7 - x, y), nb.clamp, "7 - x", "y", "clamp"),
    "flip_vertical": (lambda x, y: (x, 7 - y), nb.clamp, "x", "7 - y", "clamp"),
    "rotate_90": (lambda x, y: (y, 7 - x), nb.clamp, "y", "7 - x", "clamp"),
    "rotate_180": (lambda x, y: (7 - x, 7 - y), nb.clamp, "7 - x", "7 - y", "clamp"),
    "transpose": (lambda x, y: (y, x), nb.clamp, "y", "x", "clamp"),
    "offset_wrap": (lambda x, y: (x - 3, y - 2), nb.wrap, "x - 3", "y - 2", "wrap"),
    "offset_clamp": (lambda x, y: (x - 3, y + 2), nb.clamp, "x - 3", "y + 2", "clamp"),
    "offset_mirror": (lambda x, y: (x + 5, y - 6), nb.mirror, "x + 5", "y - 6", "mirror"),
    "shear": (lambda x, y: (x - F.floor(y / 2), y), nb.wrap, "x - y // 2", "y", "wrap"),
    "repeat": (lambda x, y: (x * 2, y * 2), nb.wrap, "x * 2", "y * 2", "wrap"),
    "resize_nearest": (lambda x, y: (F.floor(x / 2), F.floor(y / 2)), nb.clamp, "x // 2", "y // 2", "clamp"),
}
for _name, (_source, _edge, _sx, _sy, _kind) in REMAPS.items():
    _query(
        _name, lambda c, s=_source, e=_edge: nb.remapped(c, W, H, s, e),
        f"WITH {PX_SQL} SELECT p.vec_id, p.pos, CAST(q.code AS BIGINT) AS out FROM (SELECT *, {EDGES_SQL[_kind].format(_sx)} AS sx, {EDGES_SQL[_kind].format(_sy)} AS sy FROM px) p JOIN px q ON q.vec_id = p.vec_id AND q.x = p.sx AND q.y = p.sy",
    )
