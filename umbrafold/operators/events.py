"""Time and log operators: keyframe lookup, frame grids, journal recovery and replay, undo histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASING = {"linear": lambda f: f, "ease_in": lambda f: f * f, "ease_out": lambda f: 1 - (1 - f) * (1 - f), "hold": lambda f: F.lit(0.0)}


def interpolated(keys: DataFrame, asks: DataFrame, group: str | list[str], ease: str = "linear") -> DataFrame:
    """asks(group, t) with the value of keys(group, t, value) at t, between the keys before and after it, held beyond the ends.

    Keys learn the key after them among themselves, and a row before all of a group holds the first one's value. Then keys and
    asks are sorted together once and each ask looks back only, so no pair of rows is joined and a group takes one pass.
    """
    by = [group] if isinstance(group, str) else group
    order = Window.partitionBy(*by).orderBy("t")
    chained = keys.select(*by, "t", "value", F.lead("t").over(order).alias("nt"), F.lead("value").over(order).alias("nv"), F.row_number().over(order).alias("nr"))
    none = lambda c: F.lit(None).cast(chained.schema[c].dataType).alias(c)
    key = F.struct(F.lit(1).alias("kind"), "t", "value", "nt", "nv")
    held = F.struct(F.lit(0).alias("kind"), none("t"), "value", none("nt"), none("nv"))  # nulls are sorted first
    marks = chained.select(*by, F.explode(F.when(F.col("nr") == 1, F.array(held, key)).otherwise(F.array(key))).alias("p"))
    both = marks.select(*by, "p.t", "p.kind", "p").union(asks.select(*by, "t", F.lit(2), F.lit(None).cast(marks.schema["p"].dataType)))
    back = Window.partitionBy(*by).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = both.select(*by, "t", "kind", F.last("p", True).over(back).alias("p")).where("kind = 2")
    part = (F.col("t") - F.col("p.t")) / (F.col("p.nt") - F.col("p.t"))
    value = F.when(F.col("p.nt").isNull() | (F.col("t") == F.col("p.t")), F.col("p.value")).otherwise(F.col("p.value") + (F.col("p.nv") - F.col("p.value")) * EASING[ease](part))
    return near.select(*by, "t", value.alias("value"))


def frame_times(fps: Column, length_ms: Column) -> Column:
    """Array of (frame, start_ms, dur_ms): starts round(i * 1000 / fps); the durations add up to the length."""
    count = F.ceil(length_ms * fps / 1000).cast("int")
    start = lambda i: F.floor(i * 1000 / fps + 0.5).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("frame"), start(i).alias("start_ms"), (F.least(start(i + 1), length_ms) - start(i)).cast("int").alias("dur_ms")))


def after_last_marker(log: DataFrame, group: str, order: str, marker: Column) -> DataFrame:
    """The rows of each group after its last marker, all of them where there is none."""
    last = log.where(marker).groupBy(group).agg(F.max(order).alias("marked"))
    return log.join(last, group, "left").where(F.col("marked").isNull() | (F.col(order) > F.col("marked"))).drop("marked")


def recovered(journal: DataFrame) -> DataFrame:
    """The longest valid prefix of a journal(seq, kind, payload, document_hash, torn): all before the first torn line, in line order."""
    lines = journal.withColumn("line", F.monotonically_increasing_id())
    torn = lines.where("torn IS NOT NULL").agg(F.min("line").alias("first"))
    return lines.crossJoin(F.broadcast(torn)).where("torn IS NULL AND (first IS NULL OR line < first)").drop("torn", "first", "line")  # one row


def replayed(log: DataFrame, key: str, order: str) -> DataFrame:
    """The state that a log of set and clear commands (key, order, action, value) leaves: the last command of each key, if it sets."""
    last = log.groupBy(key).agg(F.max(F.struct(F.col(order), F.col("action"), F.col("value"))).alias("l"))
    return last.where("l.action = 'set'").select(key, "l.value")
