"""Composites of random layer trees against a plain recursion, and tiles against whole images."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbrafold.functions import noise
from umbrafold.operators import layer_effects, layer_tree, resampling, tiles

LAYERS = "doc long, id long, parent long, ord long, group boolean, mode string, opacity double, through boolean, clipped boolean, visible boolean"
N = 6


def random_tree(r: random.Random, doc: int, first: int, depth: int, parent: int | None = None) -> list[tuple]:
    rows = []
    for ord_ in range(r.randint(1, 5)):
        i = first + len(rows)
        group = depth > 0 and r.random() < 0.5
        through = r.random() < 0.5
        mode = "normal" if through and r.random() < 0.7 else r.choice(list(layer_tree.MODES))
        rows.append((doc, i, parent, ord_, group, mode, r.choice([0.25, 0.5, 1.0]), through, r.random() < 0.35, r.random() < 0.85))
        if group:
            rows += random_tree(r, doc, first + len(rows), depth - 1, i)
    return rows


def plain(rows: list[tuple], pixels: dict, doc: int, tile: int) -> np.ndarray:
    """The recursion over sibling lists, bottom first."""
    below: dict = {}
    for row in rows:
        if row[0] == doc:
            below.setdefault(row[2], []).append(row)

    def source(row) -> np.ndarray:
        if not row[4]:
            return pixels.get((row[1], tile), np.zeros((4, N)))
        return siblings(below.get(row[1], []), np.zeros((4, N)))

    def siblings(found, canvas):
        found, k = sorted(found, key=lambda x: x[3]), 0
        while k < len(found):
            base, clipped, k = found[k], [], k + 1
            if not base[8]:
                while k < len(found) and found[k][8]:
                    clipped.append(found[k])
                    k += 1
            if not base[9]:
                continue
            if base[4] and base[7] and base[5] == "normal" and not clipped:
                inner = siblings(below.get(base[1], []), canvas.copy())
                canvas = canvas + (inner - canvas) * base[6]
                continue
            shape = source(base)
            for row in clipped:
                if row[9]:
                    shape = layer_tree.laid(shape, source(row), row[5], row[6], inside=True)
            canvas = layer_tree.laid(canvas, shape, base[5], base[6])
        return canvas

    return siblings(below[None], np.zeros((4, N)))


def test_random_trees_equal_the_recursion(spark):
    r = random.Random(4)
    rows = [row for doc in range(6) for row in random_tree(r, doc, doc * 10_000, 4)]
    pixels = {}
    for row in rows:
        for tile in (0, 1):
            if not row[4] and r.random() < 0.7:
                a = np.array([r.choice([0, 0.3, 1.0]) for _ in range(N)])
                pixels[row[1], tile] = np.array([[r.random() * x for x in a] for _ in range(3)] + [a.tolist()])
    content = spark.createDataFrame([(i, t, p.ravel().tolist()) for (i, t), p in pixels.items()], "id long, tile long, rgba array<double>")
    found = {(x["doc"], x["tile"]): np.reshape(x["rgba"], (4, N)) for x in layer_tree.composite(spark.createDataFrame(rows, LAYERS), content).collect()}
    assert len(found) > 8 and max(len(x["path"]) for x in layer_tree.steps(spark.createDataFrame(rows, LAYERS)).collect()) > 4
    for doc in range(6):
        for tile in (0, 1):
            want = plain(rows, pixels, doc, tile)
            assert np.allclose(found.get((doc, tile), np.zeros((4, N))), want, atol=1e-12), (doc, tile)
    assert layer_tree.composite(spark.createDataFrame([], LAYERS), content).count() == 0


def test_a_cycle_is_refused(spark):
    rows = [(0, 1, 2, 0, True, "normal", 1.0, False, False, True), (0, 2, 1, 0, True, "normal", 1.0, False, False, True)]
    with pytest.raises(ValueError, match="cycle"):
        layer_tree.steps(spark.createDataFrame(rows, LAYERS))


def image(width: int, height: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width)).astype(float)


def cut(spark, img: np.ndarray, side: int, number: int = 0):
    h, w = img.shape
    rows = [(number, x, y, float(img[y, x]), w, h) for y in range(h) for x in range(w)]
    return tiles.cut(spark.createDataFrame(rows, "image long, x long, y long, v double, width long, height long"), side)


def whole(df, side: int, shape: tuple) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in tiles.spread(df, side).collect():
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize("edge, mode", [("clamp", "edge"), ("mirror", "symmetric"), ("wrap", "wrap"), ("zero", "constant")])
@pytest.mark.parametrize("side, margin", [(8, 3), (5, 7), (64, 3)])
def test_results_do_not_depend_on_tiles(spark, edge, mode, side, margin):
    img = image(19, 22, 1)
    for kernel in (tiles.box_total(3), tiles.median(2), tiles.sobel, tiles.medoid, tiles.disc_smooth(3), tiles.diffused(2, 5)):
        got = whole(tiles.filtered(cut(spark, img, side), side, margin, kernel, edge), side, img.shape)
        assert np.allclose(got, kernel(np.pad(img, margin, mode=mode), margin, 0, 0), atol=1e-9)


def test_noise_kernels_are_of_the_place_and_odd_pixels_are_defined(spark):
    got = whole(tiles.filtered(cut(spark, image(20, 11, 2), 7), 7, 0, tiles.clouds(3, 6.0)), 7, (11, 20))
    y, x = np.mgrid[0:11, 0:20]
    assert np.array_equal(got, 0.5 * (noise.clouds_grid(3, (x + 0.5) / 6, (y + 0.5) / 6) + 1))
    rows = [(0, 0, 0, 5.0, 3, 2), (0, 0, 0, 7.0, 3, 2), (0, 9, 9, 1.0, 3, 2), (0, 2, 1, 4.0, 3, 2)]
    df = spark.createDataFrame(rows, "image long, x long, y long, v double, width long, height long")
    assert whole(tiles.cut(df, 4), 4, (2, 3)).tolist() == [[7, 0, 0], [0, 0, 4]]
    assert tiles.filtered(tiles.cut(df.where("v > 100"), 4), 4, 2, tiles.median(1)).count() == 0


def plain_resample(img: np.ndarray, dst: int, radius: float, weight, widens: bool = True) -> np.ndarray:
    """Along rows, pixel by pixel."""
    src, out = img.shape[1], np.zeros((img.shape[0], dst))
    scale = max(src / dst, 1) if widens else 1
    for i in range(dst):
        c = (i + 0.5) * src / dst
        taps = range(int(np.ceil(c - radius * scale - 0.5)), int(np.floor(c + radius * scale - 0.5)) + 1)
        w = [float(weight((j + 0.5 - c) / scale)) for j in taps]
        for j, v in zip(taps, w, strict=True):
            out[:, i] += img[:, min(max(j, 0), src - 1)] * v / sum(w)
    return out


def lanczos(d: float) -> float:
    return 1.0 if d == 0 else 3 * np.sin(np.pi * d) * np.sin(np.pi * d / 3) / (np.pi * d) ** 2 if abs(d) < 3 else 0.0


@pytest.mark.parametrize("width, height", [(9, 40), (50, 7), (1, 1), (19, 22), (300, 2)])
def test_resampled_tiles_equal_a_plain_resampling(spark, width, height):
    img = image(19, 22, 3)
    for kind, radius, weight in (("triangle", 1, lambda d: max(1 - abs(d), 0)), ("lanczos3", 3, lanczos)):
        got = whole(resampling.resampled(cut(spark, img, 6), 6, F.lit(width), F.lit(height), kind), 6, (height, width))
        assert np.allclose(got, plain_resample(plain_resample(img, width, radius, weight).T, height, radius, weight).T, atol=1e-9)


def test_the_axis_with_the_smaller_image_in_between_comes_first(spark):
    img = image(2, 300, 4)
    tall = cut(spark, img, 16)
    plan = resampling.resampled(tall, 16, F.lit(3000), F.lit(1), "lanczos3")
    assert np.allclose(whole(plan, 16, (1, 3000)), plain_resample(plain_resample(img.T, 1, 3, lanczos).T, 3000, 3, lanczos), atol=1e-9)
    first = tall.select((F.lit(3000) * F.col("height") <= F.col("width") * F.lit(1)).alias("across_first")).distinct().collect()
    assert [r[0] for r in first] == [False]
    w = resampling.weights(7, 3, "mitchell", 0, 3)
    assert np.allclose(w.sum(1), 1) and resampling.weights(5, 5, "lanczos3", 0, 5).round(9).tolist() == np.eye(5).tolist()
    assert resampling.weights(4, 2, "nearest", 0, 2).sum(1).tolist() == [1, 1]


def test_effects_follow_the_outline_and_not_the_tiles(spark):
    img = np.where(image(23, 17, 6) > 200, 255.0, 0.0)
    img[4:12, 5:15] = 255
    img[7, 9] = 100
    inside = img >= 128
    padded = np.pad(inside, 8)

    def nearest(y: int, x: int) -> float:
        at = np.argwhere(padded != padded[y + 8, x + 8]) - 8
        dy, dx = np.abs(at[:, 0] - y), np.abs(at[:, 1] - x)
        return float((np.maximum(dy, dx) + (2**0.5 - 1) * np.minimum(dy, dx)).min())

    d = np.array([[(nearest(y, x) - 0.5) * (-1 if inside[y, x] else 1) for x in range(23)] for y in range(17)])
    d = np.where((np.abs(d) <= 0.5) & (img > 0) & (img < 255), 0.5 - img / 255, d)
    m = layer_effects.margin(3.0, 0.5)
    run = lambda kernel: whole(tiles.filtered(cut(spark, img, 6), 6, m, kernel, "zero"), 6, img.shape)
    assert np.allclose(run(layer_effects.stroke(3.0, "center", 0.5)), np.clip(np.clip(2 - d, 0, 1) - np.clip(-1 - d, 0, 1), 0, 1) * 0.5, atol=1e-9)
    assert np.allclose(run(layer_effects.glow(3.0, 0.5)), np.clip(1 - (d - 1.5) / 3, 0, 1), atol=1e-9)
    assert np.allclose(run(layer_effects.glow(3.0, 0.0, 0.5, inner=True)), np.clip((np.clip(1 + d / 3, 0, 1) - 0.5) / 0.5, 0, 1) * img / 255, atol=1e-9)
