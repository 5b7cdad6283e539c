"""A tree of layers composited, with its DuckDB SQL as folds of lists, group by group.

Each label is a document. Its images stand in two groups of each of three groups: the first is screened over the rest, the
second passes through, and in the third one group is clipped to the other. Within groups, images have modes and opacities
of their own, some are hidden, and some are clipped to the image below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.operators import layer_tree
from umbrafold.sources.rasters import RGB_SQL, images

QUERIES: dict = {}
MODES = list(layer_tree.MODES)
_NUMBER = {m: k for k, m in enumerate(MODES)}
#: Ids of groups, apart from those of images.
INNER, GROUP = 1 << 40, 1 << 41


def layers(spark, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("doc"), F.col("vec_id").cast("long").alias("id"))
    g1, g2 = F.col("id") % 3, F.floor(F.col("id") / 3) % 2
    inner, outer = (INNER + F.col("doc") * 100 + g1 * 10 + g2), (GROUP + F.col("doc") * 10 + g1)
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("id") % 6 + 1).cast("int"))
    no, yes = F.lit(False), F.lit(True)
    leaves = raw.select("doc", "id", inner.alias("parent"), F.col("id").alias("ord"), no.alias("group"), mode.alias("mode"), ((F.col("id") % 4 + 1) / F.lit(4.0)).alias("opacity"), no.alias("through"), (F.col("id") % 5 == 2).alias("clipped"), (F.col("id") % 11 != 4).alias("visible"))
    subs = raw.select("doc", inner.alias("id"), outer.alias("parent"), g2.alias("ord"), g1.alias("g1")).distinct()
    first = F.col("ord") == 1
    subs = subs.select("doc", "id", "parent", "ord", yes, F.when(first & (F.col("g1") == 0), "multiply").otherwise("normal"), F.lit(0.8), no, first & (F.col("g1") == 2), yes)
    tops = raw.select("doc", outer.alias("id"), F.lit(None).cast("long").alias("parent"), g1.alias("ord")).distinct()
    tops = tops.select("doc", "id", "parent", "ord", yes, F.when(F.col("ord") == 0, "screen").otherwise("normal"), F.when(F.col("ord") == 0, 0.9).when(F.col("ord") == 1, 0.6).otherwise(1.0), F.col("ord") == 1, no, yes)
    return leaves.union(subs).union(tops)


def content(spark, sf_dir: str) -> DataFrame:
    """The images with two turned copies of themselves as channels and alpha from the third, premultiplied."""
    at = lambda k: F.get("codes", k.cast("int")) / F.lit(255.0)
    turned = lambda p: p % 8 * 8 + F.floor(p / 8)
    alpha = lambda p: F.lit(0.3) + F.lit(0.7) * at(turned(p))
    plane = lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), v)
    planes = [plane(lambda p: at(p) * alpha(p)), plane(lambda p: at(63 - p) * alpha(p)), plane(lambda p: at(turned(p)) * alpha(p)), plane(alpha)]
    return images(spark, sf_dir).select(F.col("vec_id").cast("long").alias("id"), F.lit(0).cast("long").alias("tile"), F.flatten(F.array(*planes)).alias("rgba"))


def composite_tree(spark, sf_dir: str) -> DataFrame:
    out = layer_tree.composite(layers(spark, sf_dir), content(spark, sf_dir))
    each = out.select(F.col("doc").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"), "rgba")
    return each.select("label", "pos", *(F.round(F.get("rgba", F.col("pos") + 64 * k), 6).alias(c) for k, c in enumerate("rgba")))


def _mixed(b: str, s: str) -> str:
    forms = {"normal": "{s}", "multiply": "{b} * {s}", "screen": "{b} + {s} - {b} * {s}", "darken": "least({b}, {s})", "lighten": "greatest({b}, {s})", "difference": "abs({b} - {s})"}
    return "CASE c.m " + " ".join(f"WHEN {_NUMBER[m]} THEN {f.format(b=b, s=s)}" for m, f in forms.items()) + " END"


def _laid(inside: bool) -> str:
    """A struct (r, g, b, a, m, o): the source over the backdrop, which gives m and o."""

    def channel(k: str) -> str:
        s, b = f"(CASE WHEN c.a > 0 THEN c.{k} / c.a ELSE 0 END)", f"(CASE WHEN b.a > 0 THEN b.{k} / b.a ELSE 0 END)"
        mixed = f"least(greatest({_mixed(b, s)}, 0), 1)"
        return f"c.a * c.o * b.a * ({mixed}) + b.{k} * (1 - c.a * c.o)" if inside else f"c.a * c.o * ((1 - b.a) * {s} + b.a * ({mixed})) + b.{k} * (1 - c.a * c.o)"

    a = "b.a" if inside else "c.a * c.o + b.a * (1 - c.a * c.o)"
    return "{" + ", ".join(f"'{k}': {channel(k)}" for k in "rgb") + f", 'a': {a}, 'm': b.m, 'o': b.o}}"


_EMPTY = "{'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'm': 0::INT, 'o': 1.0::DOUBLE}"
_OVER, _ATOP = _laid(False), _laid(True)
_AS = lambda s, m, o: "{" + ", ".join(f"'{k}': {s}.{k}" for k in "rgba") + f", 'm': {m}::INT, 'o': {o}::DOUBLE}}"
QUERIES["composite_tree"] = (composite_tree, f"""WITH {RGB_SQL}, leaf AS (
  SELECT label, pos, vec_id, vec_id % 3 AS g1, vec_id // 3 % 2 AS g2, vec_id % 5 = 2 AS clipped, vec_id % 11 <> 4 AS visible,
    {{'r': r * (0.3 + 0.7 * b)::DOUBLE, 'g': g * (0.3 + 0.7 * b)::DOUBLE, 'b': b * (0.3 + 0.7 * b)::DOUBLE, 'a': (0.3 + 0.7 * b)::DOUBLE, 'm': CAST(vec_id % 6 AS INT), 'o': (vec_id % 4 + 1) / 4.0::DOUBLE}} AS s FROM rgb),
runs AS (SELECT *, sum(CASE WHEN clipped THEN 0 ELSE 1 END) OVER (PARTITION BY label, g1, g2, pos ORDER BY vec_id) AS run FROM leaf),
unit AS (SELECT label, g1, g2, pos, min(vec_id) AS nr, list(s ORDER BY vec_id) FILTER (visible) AS l, bool_or(visible AND (NOT clipped OR run = 0)) AS shown
  FROM runs GROUP BY label, g1, g2, pos, CASE WHEN run = 0 THEN -1 - vec_id ELSE run END),
drawn AS (SELECT label, g1, g2, pos, nr, list_reduce(l, lambda b, c: {_ATOP}) AS s FROM unit WHERE shown),
inner_ AS (SELECT label, g1, g2, pos, list_reduce(list_prepend({_EMPTY}, list(s ORDER BY nr)), lambda b, c: {_OVER}) AS s FROM drawn GROUP BY ALL),
named AS (SELECT label, g1, g2, pos, {_AS("s", f"CASE WHEN g1 = 0 AND g2 = 1 THEN {_NUMBER['multiply']} ELSE 0 END", "0.8")} AS s FROM inner_),
outer_ AS (SELECT label, pos, g1, list(s ORDER BY g2) AS l FROM named GROUP BY ALL),
wide AS (SELECT label, pos, any_value(l) FILTER (g1 = 0) AS l0, any_value(l) FILTER (g1 = 1) AS l1, any_value(l) FILTER (g1 = 2) AS l2 FROM outer_ GROUP BY ALL),
one AS (SELECT label, pos, l1, l2, list_reduce(list_prepend({_EMPTY}, l0), lambda b, c: {_OVER}) AS s FROM wide),
two AS (SELECT label, pos, l1, l2, list_reduce([{_EMPTY}, {_AS("s", _NUMBER["screen"], "0.9")}], lambda b, c: {_OVER}) AS s FROM one),
three AS (SELECT label, pos, l2, s, list_reduce(list_prepend(s, l1), lambda b, c: {_OVER}) AS t FROM two),
four AS (SELECT label, pos, l2, {{{", ".join(f"'{k}': s.{k} + (t.{k} - s.{k}) * 0.6::DOUBLE" for k in "rgba")}, 'm': 0::INT, 'o': 1.0::DOUBLE}} AS s FROM three),
five AS (SELECT label, pos, s, list_reduce([{_EMPTY}, list_reduce(l2, lambda b, c: {_ATOP})], lambda b, c: {_OVER}) AS t FROM four),
six AS (SELECT label, pos, list_reduce([s, {_AS("t", 0, "1.0")}], lambda b, c: {_OVER}) AS s FROM five)
SELECT label, pos, {", ".join(f"round(s.{k}, 6) AS {k}" for k in "rgba")} FROM six""")  # fmt: skip
