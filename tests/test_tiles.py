"""Tiles cut from pixels: results and the memory of a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from umbrafold.operators import resampling, tiles


def test_filling_a_wide_batch_holds_no_objects_per_pixel():
    """A batch of 4,000 whole tiles: what is made besides it stays near a part's size; as objects the pixels would take a gigabyte."""
    side, n = 24, 4000
    area = side * side
    numbers = {"image": [0] * n, "tx": range(n), "ty": [0] * n, "width": [n * side] * n, "height": [side] * n, "n": [area] * n}
    lists = lambda flat: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * area, pa.int32()), pa.array(flat))
    v = np.random.default_rng(1).random(n * area)
    backwards = np.tile(np.arange(area - 1, -1, -1, dtype=np.int32), n)
    batch = pa.record_batch({**{c: pa.array(x, pa.int64()) for c, x in numbers.items()}, "at": lists(backwards), "v": lists(v)})
    tracemalloc.start()
    seen = 0
    for out in tiles._fill(side)([batch]):
        got = out.column("pixels").flatten().to_numpy().reshape(-1, area)
        assert np.array_equal(got, v.reshape(n, area)[seen : seen + out.num_rows, ::-1])
        seen += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 64 << 20


def test_strips_of_a_wide_batch_come_in_parts():
    side, n = 24, 4000
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * side * side, pa.int32()), pa.array(np.zeros(n * side * side)))
    numbers = {"image": [0] * n, "tx": range(n), "ty": [0] * n, "width": [n * side] * n, "height": [side] * n, "to_width": [n * side // 2] * n, "to_height": [side] * n, "axis": [resampling.X] * n}
    batch = pa.record_batch({**{c: pa.array(x, pa.int64()) for c, x in numbers.items()}, "pixels": flat})
    assert max(out.column("pixels").flatten().nbytes for out in resampling._send(side, "triangle")([batch])) < 32 << 20


def test_places_without_pixels_and_repeated_pixels(spark):
    px = spark.createDataFrame([(3, 1, 0, 5.0, 5, 3), (3, 1, 0, 9.0, 5, 3), (3, 4, 2, 7.0, 5, 3), (3, 5, 0, 1.0, 5, 3)], "image long, x long, y long, v double, width long, height long")
    got = {(r["tx"], r["ty"]): r["pixels"] for r in tiles.cut(px, 2).collect()}
    assert got == {(0, 0): [0, 9, 0, 0], (1, 0): [0] * 4, (2, 0): [0, 0], (0, 1): [0, 0], (1, 1): [0, 0], (2, 1): [7]}
