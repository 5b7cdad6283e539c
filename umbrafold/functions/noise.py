"""Seeded noise as a pure function of absolute coordinates: the same pixel draws the same number in every tile.

The generator works on unsigned 64-bit numbers that wrap, which Spark's own arithmetic refuses in ANSI mode. So columns of
coordinates go through Arrow functions, in kernels on tiles the coordinates are arrays; both are numpy's unsigned numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
# Factors and shifts of the mixers.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
HASH_X, HASH_Y, HASH_SHIFTS = 0xA24BAED4963EE407, 0x9FB21C651E98DF25, (29, 32, 29)
DISSOLVE_X, DISSOLVE_Y, DISSOLVE_LEVEL, DISSOLVE_SHIFTS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, (30, 27, 31)
PERLIN_SEED = 0x5DEECE66D1251B68
SECOND_DIFFUSE, SECOND_TILES = 0x5851F42D4C957F2D, 0x5BD1E995

Halves = tuple[Column, Column]
_LOW = (1 << 32) - 1


def _u64(v) -> np.ndarray:
    return np.asarray(v, np.int64).astype(np.uint64)


def _mixed_grid(z: np.ndarray, shifts: tuple[int, int, int]) -> np.ndarray:
    """The finaliser: fold, multiply, fold, multiply, fold."""
    a, b, c = (np.uint64(s) for s in shifts)
    z = (z ^ (z >> a)) * np.uint64(MIX_1)
    z = (z ^ (z >> b)) * np.uint64(MIX_2)
    return z ^ (z >> c)


def _start_grid(x, y, kx: int, ky: int, add: int) -> np.ndarray:
    return np.uint64(add & MASK) + _u64(x) * np.uint64(kx) + _u64(y) * np.uint64(ky)


def _hash_grid(seed: int, x, y) -> np.ndarray:
    return _mixed_grid(_start_grid(x, y, HASH_X, HASH_Y, seed + GOLDEN), HASH_SHIFTS)


def _bits(of: Callable[[np.ndarray, np.ndarray], np.ndarray], x: Column, y: Column) -> Column:
    """What `of` makes of two columns of coordinates, as a long with the same 64 bits; null where one of them is."""

    @F.arrow_udf("long")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            z = of(*(v.fill_null(0).to_numpy(zero_copy_only=False) for v in (x, y)))
        known = pc.and_(x.is_valid(), y.is_valid())
        return pc.if_else(known, pa.array(z.view(np.int64)), None)

    return run(x.cast("long"), y.cast("long"))


def hash_halves(seed: int, x: Column, y: Column) -> Halves:
    """64 well-mixed bits of a seed and a coordinate."""
    z = _bits(lambda x, y: _hash_grid(seed, x, y), x, y)
    return F.shiftrightunsigned(z, 32), z.bitwiseAND(F.lit(_LOW).cast("long"))


def _unit(of: Callable[[np.ndarray, np.ndarray], np.ndarray], x: Column, y: Column) -> Column:
    """The upper 24 bits as a number in [0, 1), exact."""
    return F.shiftrightunsigned(_bits(of, x, y), 40) / F.lit(float(1 << 24))


def hash_unit(seed: int, x: Column, y: Column) -> Column:
    return _unit(lambda x, y: _hash_grid(seed, x, y), x, y)


def dissolve_noise(x: Column, y: Column, level: int = 0, seed: int = 0) -> Column:
    """What a pixel of a dissolving layer draws in [0, 1): it shows where this is less than its alpha."""
    return _unit(lambda x, y: _mixed_grid(_start_grid(x, y, DISSOLVE_X, DISSOLVE_Y, level * DISSOLVE_LEVEL + seed), DISSOLVE_SHIFTS), x, y)


def signed_draw(seed: int, x: Column, y: Column, nth: int) -> Column:
    """The nth number, from 1, of a place's own stream, in [-1, 1)."""
    return _unit(lambda x, y: _mixed_grid(_hash_grid(seed, x, y) + np.uint64(nth * GOLDEN & MASK), DISSOLVE_SHIFTS), x, y) * 2 - 1


def hash_unit_grid(seed: int, x, y) -> np.ndarray:
    """hash_unit over arrays of coordinates, as 32-bit floats."""
    with np.errstate(over="ignore"):
        z = _hash_grid(seed, x, y)
    return (z >> np.uint64(40)).astype(np.float32) * np.float32(1 / (1 << 24))


def permutation(seed: int) -> list[int]:
    """0..255 shuffled by the seeded stream."""
    state, perm = (seed ^ PERLIN_SEED) & MASK, list(range(256))
    for i in range(255, 0, -1):
        state = (state + GOLDEN) & MASK
        z = ((state ^ (state >> 30)) * MIX_1) & MASK
        z = ((z ^ (z >> 27)) * MIX_2) & MASK
        j = (z ^ (z >> 31)) % (i + 1)
        perm[i], perm[j] = perm[j], perm[i]
    return perm


# The gradients, four axes and four diagonals.
_D = 0.70710678118654752440
GRADIENTS = ((1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (_D, _D), (-_D, _D), (_D, -_D), (-_D, -_D))


def perlin_grid(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient noise in [-1, 1] at arrays of points, of period 256, with the quintic fade; 64-bit floats."""
    perm, gradients = np.array(permutation(seed)), np.array(GRADIENTS)
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = x - x0, y - y0
    xi, yi = (x0 % 256).astype(np.int64), (y0 % 256).astype(np.int64)
    u, v = (t * t * t * (t * (t * 6 - 15) + 10) for t in (fx, fy))

    def corner(dx: int, dy: int) -> np.ndarray:
        g = gradients[perm[(yi + dy + perm[(xi + dx) & 255]) & 255] & 7]
        return g[..., 0] * (fx - dx) + g[..., 1] * (fy - dy)

    a = corner(0, 0) + u * (corner(1, 0) - corner(0, 0))
    b = corner(0, 1) + u * (corner(1, 1) - corner(0, 1))
    return np.clip((a + v * (b - a)) * np.sqrt(2), -1, 1)


def clouds_grid(seed: int, x: np.ndarray, y: np.ndarray, octaves: int = 4, persistence: float = 0.5) -> np.ndarray:
    """Octaves of gradient noise, each of twice the frequency, divided by their total weight."""
    weights = [persistence**k for k in range(octaves)]
    return np.clip(sum(w * perlin_grid(seed, x * 2**k, y * 2**k) for k, w in enumerate(weights)) / sum(weights), -1, 1)


# The same in DuckDB.
WRAP_SQL = "CAST((CAST({a} AS UHUGEINT) * CAST({k} AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"


def mixed_sql(z: str, shifts: tuple[int, int, int]) -> list[str]:
    """SELECT lists of successive steps on a UBIGINT column z."""
    a, b, c = shifts
    return [WRAP_SQL.format(a=f"xor({z}, {z} >> {a})", k=MIX_1), WRAP_SQL.format(a=f"xor({z}, {z} >> {b})", k=MIX_2), f"xor({z}, {z} >> {c})"]


def start_sql(x: str, y: str, kx: int, ky: int, add: int) -> str:
    """The wrapped sum of x times kx, y times ky (both not negative) and a constant."""
    total = f"{WRAP_SQL.format(a=x, k=kx)}::UHUGEINT + {WRAP_SQL.format(a=y, k=ky)}::UHUGEINT + {add & MASK}::UHUGEINT"
    return f"CAST(({total}) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"
