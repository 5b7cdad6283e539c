"""All registered raster and table queries with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from umbrafold.plans import adjustments, aggregates, compositing, effects, neighbors, pointwise, relational, tiled
from umbrafold.streaming import queries as streaming

_ALL = tiled.QUERIES | compositing.QUERIES | aggregates.QUERIES | pointwise.QUERIES | neighbors.QUERIES | effects.QUERIES | relational.QUERIES | adjustments.QUERIES | streaming.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
