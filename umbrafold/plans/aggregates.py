"""Histograms, layer-stack statistics, mosaics, bounds, palettes and the adjustments that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.sources.rasters import PX_SQL, RGB_SQL, pixels, rgb_pixels

QUERIES: dict = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


@query(f"WITH {PX_SQL} SELECT code, CAST(count(*) AS BIGINT) AS n FROM px GROUP BY code")
def histogram(spark, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))


@query(f"WITH {PX_SQL}, h AS (SELECT code, count(*) AS n FROM px GROUP BY code) SELECT CAST(i AS INT) AS code, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(256) r(i) LEFT JOIN h ON h.code = i")
def histogram_dense(spark, sf_dir: str) -> DataFrame:
    bins = spark.range(256).select(F.col("id").cast("int").alias("code"))
    return bins.join(histogram(spark, sf_dir), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {PX_SQL} SELECT label, CAST(count(DISTINCT code) AS BIGINT) AS n_colors FROM px GROUP BY label")
def distinct_colors(spark, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("label").agg(F.countDistinct("code").alias("n_colors"))


def bounds(spark, sf_dir: str, clip: float = 0.01) -> DataFrame:
    """(label, lo, hi): of each label's codes the first and last whose running count passes clip of all, from either end."""
    h = pixels(spark, sf_dir).groupBy("label", "code").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")  # 256 rows at most
    up, all_ = F.sum("n").over(w.orderBy("code")), F.sum("n").over(w)
    run = h.select("label", "code", up.alias("up"), (all_ - up + F.col("n")).alias("down"), F.floor(all_ * clip).alias("skip"))
    return run.groupBy("label").agg(F.min(F.when(F.col("up") > F.col("skip"), F.col("code"))).alias("lo"), F.max(F.when(F.col("down") > F.col("skip"), F.col("code"))).alias("hi"))


_BOUNDS = f"WITH {PX_SQL}, h AS (SELECT label, code, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT label, code, sum(n) OVER (PARTITION BY label ORDER BY code) AS up, sum(n) OVER (PARTITION BY label ORDER BY code DESC) AS down, floor(sum(n) OVER (PARTITION BY label) * 0.01) AS skip FROM h), b AS (SELECT label, min(CASE WHEN up > skip THEN code END) AS lo, max(CASE WHEN down > skip THEN code END) AS hi FROM c GROUP BY label)"


@query(_BOUNDS + " SELECT * FROM b")
def clipped_bounds(spark, sf_dir: str) -> DataFrame:
    return bounds(spark, sf_dir)


@query(_BOUNDS + " SELECT vec_id, pos, CAST(least(greatest(floor((code - lo) * 255.0 / (hi - lo) + 0.5), 0), 255) AS INT) AS out FROM px JOIN b USING (label)")
def auto_levels(spark, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).join(bounds(spark, sf_dir), "label")
    stretched = F.floor((F.col("code") - F.col("lo")) * F.lit(255.0) / (F.col("hi") - F.col("lo")) + 0.5)
    return px.select("vec_id", "pos", F.least(F.greatest(stretched, F.lit(0)), F.lit(255)).cast("int").alias("out"))


@query(f"WITH {PX_SQL}, h AS (SELECT code, count(*) AS n FROM px GROUP BY code), c AS (SELECT code, sum(n) OVER (ORDER BY code) AS cdf, sum(n) OVER () AS total FROM h), f AS (SELECT min(cdf) AS first FROM c) SELECT code, round(CAST((cdf - first) AS DOUBLE) / CAST((total - first) AS DOUBLE), 6) AS mapped FROM c, f")
def equalize_map(spark, sf_dir: str) -> DataFrame:
    h = histogram(spark, sf_dir)  # 256 rows at most
    w = Window.orderBy("code")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = h.select("code", F.sum("n").over(w).alias("cdf"), F.sum("n").over(whole).alias("total"), F.first("n").over(whole).alias("first"))
    return c.select("code", F.round((F.col("cdf") - F.col("first")).cast("double") / (F.col("total") - F.col("first")).cast("double"), 6).alias("mapped"))


STACK = {
    "mean": (lambda v: F.avg(v), "avg(v)"), "median": (lambda v: F.median(v), "median(v)"), "min": (F.min, "min(v)"), "max": (F.max, "max(v)"), "range": (lambda v: F.max(v) - F.min(v), "max(v) - min(v)"), "sum": (F.sum, "sum(v)"),
    "variance": (F.var_pop, "var_pop(v)"), "std": (F.stddev_pop, "stddev_pop(v)"),
    "skewness": (lambda v: F.when(F.stddev_pop(v) <= 1e-6, 0.0).otherwise(F.skewness(v)), "CASE WHEN stddev_pop(v) <= 1e-6 THEN 0 ELSE (avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(stddev_pop(v), 3) END"),
    "kurtosis": (lambda v: F.when(F.stddev_pop(v) <= 1e-6, 0.0).otherwise(F.kurtosis(v) + 3), "CASE WHEN stddev_pop(v) <= 1e-6 THEN 0 ELSE (avg(pow(v, 4)) - 4 * avg(v) * avg(pow(v, 3)) + 6 * pow(avg(v), 2) * avg(v * v) - 3 * pow(avg(v), 4)) / pow(var_pop(v), 2) END"),
}


def _stack(name: str) -> None:
    fn, sql = STACK[name]

    def run(spark, sf_dir: str) -> DataFrame:
        """A statistic over the layers of a stack (the images of a label) at each place, unclamped."""
        px = pixels(spark, sf_dir).select("label", "pos", F.col("code").cast("double").alias("v"))
        return px.groupBy("label", "pos").agg((F.round(fn(F.col("v")), 4) + 0.0).alias("stat"))

    QUERIES[f"stack_{name}"] = (run, f"WITH {PX_SQL}, t AS (SELECT label, pos, code::DOUBLE AS v FROM px) SELECT label, pos, round({sql}, 4) + 0.0 AS stat FROM t GROUP BY label, pos")


for _name in STACK:
    _stack(_name)


@query(f"WITH {PX_SQL}, h AS (SELECT label, pos, code, count(*) AS n FROM px GROUP BY ALL), t AS (SELECT label, pos, n / sum(n) OVER (PARTITION BY label, pos) AS p, sum(n) OVER (PARTITION BY label, pos) AS m FROM h) SELECT label, pos, round(CASE WHEN max(m) = 1 THEN 0 ELSE -sum(p * log2(p)) / log2(max(m)) END, 4) + 0.0 AS stat FROM t GROUP BY label, pos")
def stack_entropy(spark, sf_dir: str) -> DataFrame:
    h = pixels(spark, sf_dir).groupBy("label", "pos", "code").agg(F.count("*").alias("n"))
    t = h.groupBy("label", "pos").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    stat = F.when(F.col("m") == 1, 0.0).otherwise((F.log2("m") - F.col("w") / F.col("m")) / F.log2(F.when(F.col("m") == 1, 2).otherwise(F.col("m"))))
    return t.select("label", "pos", (F.round(stat, 4) + 0.0).alias("stat"))


def _cells(px: DataFrame, size: int) -> DataFrame:
    cell = (F.floor(F.col("y") / size) * (8 // size) + F.floor(F.col("x") / size)).cast("int")
    return px.groupBy("vec_id", cell.alias("cell")).agg(F.sum("code").cast("long").alias("total"), F.count("*").alias("n"))


@query(f"WITH {PX_SQL} SELECT vec_id, CAST((y // 4) * 2 + x // 4 AS INT) AS cell, CAST(sum(code) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM px GROUP BY 1, 2")
def mosaic(spark, sf_dir: str) -> DataFrame:
    return _cells(pixels(spark, sf_dir), 4)


@query(f"WITH {PX_SQL}, l AS (SELECT 1 AS level, 2 AS s UNION ALL SELECT 2, 4 UNION ALL SELECT 3, 8) SELECT CAST(level AS INT) AS level, vec_id, CAST((y // s) * (8 // s) + x // s AS INT) AS cell, CAST(sum(code) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM px, l GROUP BY 1, 2, 3")
def mip_pyramid(spark, sf_dir: str) -> DataFrame:
    """Each level sums the cells of the level below, so the pixels are read once and the levels shrink fourfold."""
    level = _cells(pixels(spark, sf_dir), 2).withColumn("level", F.lit(1))
    out = level
    for k, width in ((2, 4), (3, 2)):
        cell = (F.floor(F.floor(F.col("cell") / width) / 2) * (width // 2) + F.floor(F.col("cell") % width / 2)).cast("int")
        level = level.groupBy("vec_id", cell.alias("cell")).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out.select("level", "vec_id", "cell", "total", "n")


@query(f"WITH {PX_SQL} SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, CAST(count(*) AS BIGINT) AS n FROM px WHERE code >= 150 GROUP BY vec_id")
def bounding_box(spark, sf_dir: str) -> DataFrame:
    own = pixels(spark, sf_dir).where("code >= 150")
    return own.groupBy("vec_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("n"))


@query(f"WITH {PX_SQL}, k AS (SELECT vec_id, code AS corner FROM px WHERE pos = 0) SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px JOIN k USING (vec_id) WHERE abs(code - corner) > 32 GROUP BY vec_id")
def trim_bbox(spark, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    corner = px.where("pos = 0").select("vec_id", F.col("code").alias("corner"))
    own = px.join(corner, "vec_id").where("abs(code - corner) > 32")
    return own.groupBy("vec_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


_MATCH = "SELECT label, avg(code::DOUBLE) AS m, stddev_pop(code::DOUBLE) AS s FROM px GROUP BY label"


@query(f"WITH {PX_SQL}, st AS ({_MATCH}), t AS (SELECT m AS tm, s AS ts FROM st ORDER BY label LIMIT 1) SELECT vec_id, pos, round((code - m) * (CASE WHEN s <= 1e-6 THEN 1 ELSE ts / s END) + tm, 4) AS out FROM px JOIN st USING (label), t")
def match_color(spark, sf_dir: str) -> DataFrame:
    """Mean and spread of each label moved to those of the first label."""
    px = pixels(spark, sf_dir)
    stats = px.groupBy("label").agg(F.avg("code").alias("m"), F.stddev_pop("code").alias("s"))
    first = stats.orderBy("label").limit(1).select(F.col("m").alias("tm"), F.col("s").alias("ts"))
    joined = px.join(stats, "label").crossJoin(F.broadcast(first))  # one row
    gain = F.when(F.col("s") <= 1e-6, 1.0).otherwise(F.col("ts") / F.when(F.col("s") <= 1e-6, 1.0).otherwise(F.col("s")))
    return joined.select("vec_id", "pos", F.round((F.col("code") - F.col("m")) * gain + F.col("tm"), 4).alias("out"))


@query(f"WITH {RGB_SQL} SELECT CAST(round(r * 255) AS INT) // 32 * 64 + CAST(round(g * 255) AS INT) // 32 * 8 + CAST(round(b * 255) AS INT) // 32 AS cell, CAST(count(*) AS BIGINT) AS n FROM rgb GROUP BY 1")
def color_cells(spark, sf_dir: str) -> DataFrame:
    """Counts in a grid of 8 x 8 x 8 colours, the start of a palette."""
    c = [F.floor(F.round(F.col(k) * 255) / 32).cast("int") for k in ("r", "g", "b")]
    return rgb_pixels(spark, sf_dir).groupBy((c[0] * 64 + c[1] * 8 + c[2]).alias("cell")).agg(F.count("*").alias("n"))


@query(f"WITH {PX_SQL}, m AS (SELECT vec_id, round(avg(code::DOUBLE), 6) AS mean FROM px GROUP BY vec_id) SELECT px.vec_id, pos, mean FROM px JOIN m USING (vec_id)")
def average(spark, sf_dir: str) -> DataFrame:
    from umbrafold.sources.rasters import images

    mean = F.round(F.aggregate("codes", F.lit(0), lambda t, v: t + v) / F.lit(64.0), 6)
    return images(spark, sf_dir).select("vec_id", mean.alias("mean"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")).select("vec_id", "pos", "mean")


@query(f"WITH {PX_SQL}, n AS (SELECT p.vec_id, p.label, p.pos, abs(4 * p.code - sum(q.code)) AS sharp, max(p.code) AS code FROM px p JOIN px q ON q.vec_id = p.vec_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1 WHERE p.x BETWEEN 1 AND 6 AND p.y BETWEEN 1 AND 6 GROUP BY p.vec_id, p.label, p.pos, p.code) SELECT label, pos, arg_min(code, (-sharp, vec_id)) AS code FROM n GROUP BY label, pos")
def focus_stack(spark, sf_dir: str) -> DataFrame:
    """Of each stack the pixel of the layer that is sharpest there (largest Laplacian), inside the border."""
    from umbrafold.operators import neighborhood as nb
    from umbrafold.sources.rasters import images

    img = images(spark, sf_dir)
    sharp = F.arrays_zip(F.transform(nb.weighted(F.col("codes"), nb.LAPLACE, 8, 8), F.abs).alias("sharp"), F.col("codes").alias("code"))
    px = img.select("vec_id", "label", F.posexplode(sharp).alias("pos", "s")).where("pos % 8 BETWEEN 1 AND 6 AND floor(pos / 8) BETWEEN 1 AND 6")
    return px.groupBy("label", "pos").agg(F.min_by("s.code", F.struct(-F.col("s.sharp"), F.col("vec_id"))).alias("code"))


_NEAR = "q.vec_id = p.vec_id AND q.x = least(greatest(p.x + dx, 0), 7) AND q.y = least(greatest(p.y + dy, 0), 7)"
_FOCUS = f"""WITH {PX_SQL}, l AS (SELECT *, pow(code / 255.0::DOUBLE, 1 / 2.2::DOUBLE) AS v FROM px),
lap AS (SELECT p.vec_id, p.label, p.pos, p.x, p.y, pow(sum(q.v) - 4 * p.v, 2) AS s FROM l p CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dx, dy) JOIN l q ON {_NEAR} GROUP BY p.vec_id, p.label, p.pos, p.x, p.y, p.v),
e AS (SELECT p.vec_id, p.label, p.pos, round(sum(q.s) / 81, 9) AS e FROM lap p CROSS JOIN range(-4, 5) a(dx) CROSS JOIN range(-4, 5) b(dy) JOIN lap q ON {_NEAR} GROUP BY p.vec_id, p.label, p.pos),
best AS (SELECT label, pos, arg_min(vec_id, (-e, vec_id)) AS vec_id FROM e GROUP BY label, pos),
w AS (SELECT p, least(greatest(least(greatest(p + a, 0), 7) + b, 0), 7) AS q, count(*) AS n FROM range(0, 8) i(p), range(-2, 3) j(a), range(-2, 3) k(b) GROUP BY ALL)
SELECT best.label, t.pos, round(sum(c.n * d.n * t.code)::DOUBLE / 625, 4) AS out FROM best JOIN px t USING (vec_id) JOIN w c ON c.p = t.x AND c.q = best.pos % 8 JOIN w d ON d.p = t.y AND d.q = best.pos // 8 GROUP BY best.label, t.pos"""


@query(_FOCUS)
def focus_blend(spark, sf_dir: str) -> DataFrame:
    """Focus stack with whole borders: the layer with most Laplacian energy in a window of radius 4 claims a pixel, the first at a tie; masks are feathered twice by radius 2."""
    import numpy as np
    import pyarrow as pa

    from umbrafold.sources.rasters import images

    blur = lambda r: np.array([[sum(min(max(p + d, 0), 7) == q for d in range(-r, r + 1)) for q in range(8)] for p in range(8)])
    window, feather = blur(4), blur(2) @ blur(2)

    def energies(batches):
        for batch in batches:
            v = (np.array(batch.column("codes").to_pylist(), float).reshape(-1, 8, 8) / 255) ** (1 / 2.2)
            around = np.pad(v, ((0, 0), (1, 1), (1, 1)), "edge")
            lap = around[:, :-2, 1:-1] + around[:, 2:, 1:-1] + around[:, 1:-1, :-2] + around[:, 1:-1, 2:] - 4 * v
            e = (window @ (lap * lap) @ window.T / 81).reshape(-1, 64)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(list(e), pa.list_(pa.float64()))], ["vec_id", "label", "e"])

    img = images(spark, sf_dir)
    energy = img.mapInArrow(energies, "vec_id long, label int, e array<double>").select("vec_id", "label", F.posexplode("e").alias("at", "e"))
    best = energy.groupBy("label", "at").agg(F.min_by("vec_id", F.struct(-F.round("e", 9), F.col("vec_id"))).alias("vec_id"))
    px = best.join(img.select("vec_id", "codes"), "vec_id").select("label", "at", F.posexplode("codes").alias("pos", "code"))
    part = lambda p, q: F.get(F.array(*[F.lit(int(n)) for n in feather.ravel()]), (p * 8 + q).cast("int"))
    weight = part(F.col("pos") % 8, F.col("at") % 8) * part(F.floor(F.col("pos") / 8), F.floor(F.col("at") / 8))
    return px.groupBy("label", "pos").agg(F.round(F.sum(weight * F.col("code")) / 625, 4).alias("out"))
