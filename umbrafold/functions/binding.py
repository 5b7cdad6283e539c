"""Values that an expression computes once, however often it refers to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often body refers to it and from whatever lambda."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def stepwise(values: tuple[Column, ...], *steps: Callable[[tuple[Column, ...]], tuple[Column, ...]]) -> tuple[Column, ...]:
    """The values after the steps, each of which takes what the one before gave and is computed once."""
    pack = lambda v: F.struct(*(c.alias(f"v{k}") for k, c in enumerate(v)))
    now, size = pack(values), len(values)
    for step in steps:
        given, sizes = size, []

        def body(v: Column, step=step, given=given, sizes=sizes) -> Column:
            out = step(tuple(v[f"v{k}"] for k in range(given)))
            sizes.append(len(out))
            return pack(out)

        now = bound(now, body)
        size = sizes[0]
    return tuple(now[f"v{k}"] for k in range(size))
