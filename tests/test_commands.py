"""Edit commands and text formats on small inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from umbrafold.functions import text
from umbrafold.operators import commands, trees

LAYERS, COMMANDS = "layer_id string, parent string, props map<string,string>", "seq long, kind string, layer_id string, parent string, props map<string,string>"


def state(df) -> dict:
    return {r["layer_id"]: (r["parent"], r["props"]) for r in df.collect()}


def test_commands_by_seq(spark):
    layers = spark.createDataFrame([("g", None, {"name": "group"}), ("a", "g", {"name": "A", "opacity": "1"}), ("b", "a", {})], LAYERS)
    log = [
        (1, "patch", "a", None, {"opacity": "0.5", "note": "x"}), (2, "patch", "a", None, {"note": None}), (3, "create", "c", "g", {"name": "C"}),
        (4, "delete", "a", None, None), (5, "move", "c", None, None), (6, "create", "d", "c", None),
    ]
    done = state(commands.applied(layers, spark.createDataFrame(log, COMMANDS)))
    assert done == {"g": (None, {"name": "group"}), "c": (None, {"name": "C"}), "d": ("c", {})}  # b went with a
    back = [*log, (7, "restore", "a", "g", {"name": "A2"}), (8, "patch", "a", None, {"opacity": "0.1"})]
    done = state(commands.applied(layers, spark.createDataFrame(back, COMMANDS)))
    assert done["a"] == ("g", {"name": "A2", "opacity": "0.1"}) and done["b"] == ("a", {})
    assert state(commands.applied(layers, spark.createDataFrame([], COMMANDS))) == state(layers)


def test_layers_deep_below_a_deleted_one_go(spark):
    layers = spark.createDataFrame([("0", None, {}), *[(str(k), str(k - 1), {}) for k in range(1, 68)], ("kept", None, {})], LAYERS).coalesce(1)
    assert set(state(commands.applied(layers, spark.createDataFrame([(1, "delete", "0", None, None)], COMMANDS)))) == {"kept"}


def test_trees_of_any_depth(spark):
    chain = spark.createDataFrame([("0", None), *[(str(k), str(k - 1)) for k in range(1, 200)]], "id string, parent string")
    got = {r["id"]: (r["depth"], r["parent"], r["path"]) for r in trees.levels(chain).collect()}
    assert all(got[str(k)] == (k, str(k - 1) if k else None, [str(i) for i in range(k + 1)]) for k in range(200))
    odd = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "x"), ("d", "c"), ("e", None), ("f", "a")], "id string, parent string")
    assert {r["id"] for r in trees.hanging(odd).collect()} == {"c", "d"}


def test_inverse_patches_restore(spark):
    layers = spark.createDataFrame([("a", None, {"x": "1", "y": "2"})], LAYERS)
    patches = spark.createDataFrame([(1, "patch", "a", None, {"x": "5", "z": "9"}), (2, "patch", "a", None, {"x": None})], COMMANDS)
    undo = {r["seq"]: r["props"] for r in commands.inverses(layers, patches).collect()}
    assert undo == {1: {"x": "1", "z": None}, 2: {"x": "5"}}
    back = spark.createDataFrame([*[tuple(r) for r in patches.collect()], (3, "patch", "a", None, undo[2]), (4, "patch", "a", None, undo[1])], COMMANDS)
    assert state(commands.applied(layers, back)) == state(layers)


def test_tile_deltas_and_inverse(spark):
    tiles = spark.createDataFrame([("l", 0, 0, "h0"), ("l", 1, 0, "h1")], "owner string, x int, y int, hash string")
    delta = spark.createDataFrame([("l", 1, 0, None), ("l", 2, 0, "h2"), ("l", 0, 0, "h9")], "owner string, x int, y int, hash string")
    after = commands.tiles_after(tiles, delta)
    assert {(r["x"], r["hash"]) for r in after.collect()} == {(0, "h9"), (2, "h2")}
    undone = commands.tiles_after(after, commands.tile_inverse(tiles, delta))
    assert sorted(map(tuple, undone.collect())) == sorted(map(tuple, tiles.collect()))
    with pytest.raises(Exception, match="twice"):
        commands.tiles_after(tiles, delta.union(delta)).collect()


def test_names(spark):
    df = spark.createDataFrame([(" Yes ", "a/b?.png", "_a_walk,40", "x, y;; z "), ("no", "CON", "plain", ""), (None, "", "_a_,7", None)], "v string, f string, n string, k string")
    got = df.select(text.truth(F.col("v")).alias("v"), text.file_stem(F.col("f")).alias("f"), text.frame_label(F.col("n")).alias("l"), text.frame_delay(F.col("n")).alias("d"), text.keyword_line(text.keywords(F.col("k"))).alias("k")).collect()
    assert [tuple(r) for r in got] == [(True, "a_b__png", "walk", 40, "x, y, z"), (False, "CON_", None, None, ""), (None, "untitled", None, 7, None)]
    assert spark.range(1).select(text.frame_name(F.lit("run"), F.lit(5))).first()[0] == "_a_run,5"
