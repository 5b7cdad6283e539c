"""Noise expressions against plain 64-bit arithmetic."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from umbrafold.functions import noise

M = (1 << 64) - 1


def plain_hash(seed: int, x: int, y: int) -> int:
    z = (seed + x * 0xA24BAED4963EE407 + y * 0x9FB21C651E98DF25 + 0x9E3779B97F4A7C15) & M
    z = ((z ^ (z >> 29)) * 0xBF58476D1CE4E5B9) & M
    z = ((z ^ (z >> 32)) * 0x94D049BB133111EB) & M
    return z ^ (z >> 29)


def plain_dissolve(x: int, y: int, level: int, seed: int) -> float:
    z = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9 + seed) & M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M
    return ((z ^ (z >> 31)) >> 40) / 2**24


def test_expressions_and_grids_give_the_plain_bits(spark):
    r = random.Random(1)
    points = [(0, 0), (1, 0), (-1, -1), (2**62, -(2**62)), (7, 2**31)] + [(r.randint(-(2**40), 2**40), r.randint(-(2**20), 2**20)) for _ in range(200)]
    df = spark.createDataFrame(points, "x long, y long")
    for seed in (0, 7, 0x5851F42D4C957F2D ^ 7, M):
        hi, lo = noise.hash_halves(seed, F.col("x"), F.col("y"))
        rows = df.select("x", "y", hi.alias("hi"), lo.alias("lo"), noise.hash_unit(seed, F.col("x"), F.col("y")).alias("u"), noise.dissolve_noise(F.col("x"), F.col("y"), 3, seed).alias("d")).collect()
        for q in rows:
            assert (q["hi"] << 32 | q["lo"]) == plain_hash(seed, q["x"], q["y"])
            assert q["u"] == (plain_hash(seed, q["x"], q["y"]) >> 40) / 2**24 and q["d"] == plain_dissolve(q["x"], q["y"], 3, seed)
        grid = noise.hash_unit_grid(seed, [p[0] for p in points], [p[1] for p in points])
        assert grid.tolist() == [(plain_hash(seed, *p) >> 40) / 2**24 for p in points]


def test_noise_is_uniform_and_gradients_vanish_on_the_lattice():
    y, x = np.mgrid[0:128, 0:128]
    u = noise.hash_unit_grid(11, x, y)
    assert abs(u.mean() - 0.5) < 0.01 and (np.histogram(u, 16, (0, 1))[0] > 800).all()
    assert sorted(noise.permutation(5)) == list(range(256)) and noise.permutation(5) != noise.permutation(6)
    assert np.abs(noise.perlin_grid(5, x.astype(float), y.astype(float))).max() == 0
    fine = noise.perlin_grid(5, x / 8 + 0.1, y / 8)
    assert 0.5 < fine.max() <= 1 and np.abs(np.diff(fine, axis=1)).max() < 0.5
    assert np.allclose(noise.perlin_grid(5, x / 8 + 256, y / 8), noise.perlin_grid(5, x / 8, y / 8))
    half = noise.clouds_grid(5, x[:, 40:] / 9, y[:, 40:] / 9)
    assert np.array_equal(half, noise.clouds_grid(5, x / 9, y / 9)[:, 40:])


def test_a_place_draws_from_its_own_stream(spark):
    df = spark.createDataFrame([(x, y) for x in (-3, 0, 9) for y in (0, 5)], "x long, y long")
    for r in df.select("x", "y", *(noise.signed_draw(7, F.col("x"), F.col("y"), k).alias(f"d{k}") for k in (1, 2, 4))).collect():
        state = plain_hash(7, r["x"], r["y"])
        for k in range(1, 5):
            state = (state + 0x9E3779B97F4A7C15) & M
            z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & M
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M
            if k != 3:
                assert r[f"d{k}"] == ((z ^ (z >> 31)) >> 40) / 2**24 * 2 - 1


def test_draws_take_few_steps_in_the_plan(spark):
    """The hash as an expression had thousands of nodes, evaluated one by one for each pixel; null coordinates draw nothing."""
    df = spark.createDataFrame([(1, 2), (None, 2), (1, None)], "x long, y long")
    out = df.select(*(noise.signed_draw(3, F.col("x"), F.col("y"), k).alias(f"d{k}") for k in (1, 2, 3, 4)), noise.dissolve_noise(F.col("x"), F.col("y")).alias("e"), noise.hash_unit(3, F.col("x"), F.col("y")).alias("u"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [[v is None for v in r] for r in out.collect()] == [[False] * 6, [True] * 6, [True] * 6]
