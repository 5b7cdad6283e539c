"""Compositing of a tree of layers: isolated and pass-through groups, clipping runs, modes, opacity and visibility.

The tree becomes a stream of steps. Each layer opens a canvas, its own pixels or its children come into it, the layers clipped
to it are drawn inside its shape, and it closes onto the canvas below by its mode and opacity. A step's place is its path,
so one shuffle by tile and a sort bring a tile's steps into order, and a task runs through them with one canvas for each open
layer: neither a group's children nor a stack's layers are ever held together, however many there are. A tile sees only the
groups that have something in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.operators import trees

#: Places inside an open layer: what is in it, what is clipped to it, its end.
WITHIN, CLIPPED, END = 0, 1, 2
OUT = "doc long, tile long, rgba array<double>"


def _separable(fn):
    return lambda b, s: np.clip(fn(b, s), 0, 1)


# The modes' formulas.
MODES = {
    "normal": _separable(lambda b, s: s),
    "multiply": _separable(lambda b, s: b * s),
    "screen": _separable(lambda b, s: b + s - b * s),
    "darken": _separable(np.minimum),
    "lighten": _separable(np.maximum),
    "difference": _separable(lambda b, s: np.abs(b - s)),
}


def straight(canvas: np.ndarray) -> np.ndarray:
    """Colours of premultiplied rows (r, g, b, a); 0 where nothing is."""
    a = canvas[3]
    return np.where(a > 0, canvas[:3] / np.where(a > 0, a, 1), 0)


def laid(canvas: np.ndarray, source: np.ndarray, mode: str, opacity: float, inside: bool = False) -> np.ndarray:
    """source over canvas, both premultiplied; inside keeps the canvas's alpha (atop)."""
    s, sa, b, ab = straight(source), source[3] * opacity, straight(canvas), canvas[3]
    mixed = MODES[mode](b, s)
    if inside:
        return np.concatenate([sa * ab * mixed + canvas[:3] * (1 - sa), ab[None]])
    out = sa * ((1 - ab) * s + ab * mixed) + canvas[:3] * (1 - sa)
    return np.concatenate([out, (sa + ab * (1 - sa))[None]])


def steps(layers: DataFrame) -> DataFrame:
    """layers(doc, id, parent, ord, group, mode, opacity, through, clipped, visible) to (doc, id, path, group, mode, opacity, through, inside).

    ord counts siblings from the bottom. A clipped layer belongs to the nearest sibling below it that is not clipped; if there
    is none it is drawn as if it were not. A group passes through if it is marked so, its mode is normal and nothing is
    clipped to it. Layers under a hidden one, and those clipped to it, are left out. Ids are unique. path has a struct for each
    layer from the root, (place, ord, id), by which steps sort. Raises where a layer reaches no root.
    """
    siblings = Window.partitionBy("doc", "parent").orderBy("ord", "id")
    base = F.last(F.when(~F.col("clipped"), F.col("id")), ignorenulls=True).over(siblings)
    own = layers.withColumn("base", F.when(F.col("clipped"), base))
    held = F.col("base").isNotNull()
    own = own.withColumn("above", F.coalesce("base", "parent")).withColumn("place", F.when(held, CLIPPED).otherwise(WITHIN))
    key = F.struct(F.col("place").alias("place"), F.col("ord").alias("ord"), F.col("id").alias("id"), F.col("visible").alias("visible"))
    keyed = own.select("*", key.alias("key"))
    over = keyed.select(F.col("id").alias("of"), F.col("key").alias("above_key"))
    found = trees.levels(keyed.join(over, F.col("above") == F.col("of"), "left").select(F.col("key").alias("id"), F.col("above_key").alias("parent")))
    shown = found.select(F.col("id.id").alias("step_id"), "path").where(~F.exists("path", lambda k: ~k["visible"]))
    bases = own.where(held).select(F.col("base").alias("has_clipped")).distinct()
    joined = own.join(shown, F.col("id") == F.col("step_id")).join(bases, F.col("id") == F.col("has_clipped"), "left")
    through = F.col("through") & F.col("group") & (F.col("mode") == "normal") & F.col("has_clipped").isNull() & ~held
    return joined.select("doc", "id", "path", "group", "mode", "opacity", through.alias("through"), held.alias("inside"))


_STEP = "doc long, tile long, op int, mode string, opacity double, through boolean, inside boolean, rgba array<double>"


def _run(batches):
    """The steps of tiles in order; a canvas for each open layer."""
    at, stack, done = None, [], []
    for batch in batches:
        names = ("doc", "tile", "op", "mode", "opacity", "through", "inside", "rgba")
        for doc, tile, op, mode, opacity, through, inside, rgba in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (doc, tile) != at:
                if stack:
                    done.append((*at, stack[0]))
                at, stack = (doc, tile), []
            if op != END:
                content = None if rgba is None else np.array(rgba).reshape(4, -1)
                if not stack:
                    stack.append(None)  # the ground, as wide as the first content
                stack.append(content if content is not None else "through" if through else None)
                if stack[-1] is not None and not isinstance(stack[-1], str):
                    for k, c in enumerate(stack):
                        if c is None or isinstance(c, str):  # canvases begin with the first content above them
                            stack[k] = np.zeros_like(content) if c is None else stack[k - 1].copy()
            else:
                top = stack.pop()
                if isinstance(top, np.ndarray):
                    stack[-1] = stack[-1] + (top - stack[-1]) * opacity if through else laid(stack[-1], top, mode, opacity, inside)
        if done:
            yield _canvases(done)
            done = []
    if stack and isinstance(stack[0], np.ndarray):
        yield _canvases([(*at, stack[0])])


def _canvases(rows: list[tuple]) -> pa.RecordBatch:
    rows = [r for r in rows if isinstance(r[2], np.ndarray)]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].ravel() for r in rows], pa.list_(pa.float64()))], ["doc", "tile", "rgba"])


def composite(layers: DataFrame, content: DataFrame) -> DataFrame:
    """The documents' tiles: (doc, tile, rgba).

    layers as of steps(); content(id, tile, rgba) has the premultiplied pixels of raster layers, four planes in one array, as
    many as the tile has pixels. A layer has no row for a tile it does not touch. A tile that no shown layer touches has no row.
    """
    way = steps(layers).select("doc", "id", "path", "group", "mode", "opacity", "through", "inside")
    pixels = way.where("NOT group").join(content.select(F.col("id").alias("of"), "tile", "rgba"), F.col("id") == F.col("of"))
    drawn = pixels.select("doc", "tile", "path", "mode", "opacity", "through", "inside", "rgba")
    touched = pixels.select("tile", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("k")).select("tile", F.col("k.id").alias("of")).distinct()
    bare = touched.join(content.select(F.col("id").alias("of"), "tile"), ["tile", "of"], "left_anti")  # groups, and bases that only what is clipped to them reaches
    groups = way.join(bare, F.col("id") == F.col("of")).select("doc", "tile", "path", "mode", "opacity", "through", "inside", F.lit(None).cast("array<double>").alias("rgba"))
    opened = drawn.union(groups)
    end = F.struct(F.lit(END).alias("place"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("long").alias("id"), F.lit(True).alias("visible"))
    both = opened.select("*", F.explode(F.array(F.lit(WITHIN), F.lit(END))).alias("op"))
    sorted_ = both.withColumn("path", F.when(F.col("op") == END, F.concat("path", F.array(end))).otherwise(F.col("path"))).withColumn("rgba", F.when(F.col("op") != END, F.col("rgba")))
    dealt = sorted_.repartition("doc", "tile").sortWithinPartitions("doc", "tile", "path")
    return dealt.select("doc", "tile", "op", "mode", "opacity", "through", "inside", "rgba").mapInArrow(_run, OUT)
