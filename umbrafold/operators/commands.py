"""Edit commands on layer tables: patches, deletions of subtrees, tile deltas, and the commands that undo them.

layers: (layer_id, parent, props map<string, string>). commands: (seq, kind, layer_id, parent, props). Kinds: create, delete, restore, move,
patch. In a patch a property that is absent is kept, one with a null value is cleared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.operators import trees
from umbrafold.operators.lineage import staged


def applied(layers: DataFrame, commands: DataFrame) -> DataFrame:
    """The layers after all commands by seq. For each layer and property the last word counts, so one aggregation does for any number of commands.

    A layer goes with its parent, however deep; a later create or restore brings it back, with the properties of that command.
    """
    start = layers.select(F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("kind"), "layer_id", "parent", "props")
    log = start.union(commands.select(F.col("seq").cast("long"), "kind", "layer_id", "parent", "props"))
    born = F.col("kind").isin("create", "restore")
    life = Window.partitionBy("layer_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("life", F.count(F.when(born, 1)).over(life))  # what was said before a rebirth no longer counts
    last = log.groupBy("layer_id").agg(F.max("life").alias("now"), F.max_by("kind", F.when(born | (F.col("kind") == "delete"), F.col("seq"))).alias("state"))
    place = log.where(born | (F.col("kind") == "move")).groupBy("layer_id").agg(F.max_by("parent", "seq").alias("parent"))
    said = log.join(last.select("layer_id", F.col("now").alias("life")), ["layer_id", "life"]).select("layer_id", "seq", F.explode("props").alias("key", "value"))
    value = said.groupBy("layer_id", "key").agg(F.max_by("value", "seq").alias("value")).where("value IS NOT NULL")
    props = value.groupBy("layer_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))  # a layer's properties
    kept = last.where("state <> 'delete'").join(place, "layer_id").join(props, "layer_id", "left")
    kept = kept.select("layer_id", "parent", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))
    kept = staged(kept, "layers")
    gone = trees.hanging(kept.select(F.col("layer_id").alias("id"), "parent"))  # what hangs on a deleted parent
    return kept.join(gone, F.col("layer_id") == F.col("id"), "left_anti")


def inverses(layers: DataFrame, patches: DataFrame) -> DataFrame:
    """For each patch (seq, layer_id, props) the patch that undoes it: the values just before, null where there was none."""
    before = layers.select(F.lit(-1).cast("long").alias("seq"), "layer_id", F.explode("props").alias("key", "value"))
    steps = patches.select(F.col("seq").cast("long").alias("seq"), "layer_id", F.explode("props").alias("key", "value"))
    w = Window.partitionBy("layer_id", "key").orderBy("seq")
    old = before.union(steps).withColumn("old", F.lag("value").over(w)).where("seq >= 0")
    return old.groupBy("seq", "layer_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("old").alias("value"))))).alias("props"))  # a layer's properties


def tiles_after(tiles: DataFrame, delta: DataFrame) -> DataFrame:
    """tiles(owner, x, y, hash) with delta(owner, x, y, hash) applied; a null hash clears. Two rows for one place in a delta are an error."""
    checked = delta.groupBy("owner", "x", "y").agg(F.max("hash").alias("new"), F.count("*").alias("n"))
    checked = checked.withColumn("new", F.when(F.col("n") > 1, F.raise_error(F.lit("a place occurs twice in the delta")).cast("string")).otherwise(F.col("new")))
    both = tiles.join(checked.withColumn("given", F.lit(True)), ["owner", "x", "y"], "full")
    return both.select("owner", "x", "y", F.when(F.col("given"), F.col("new")).otherwise(F.col("hash")).alias("hash")).where("hash IS NOT NULL")


def tile_inverse(tiles: DataFrame, delta: DataFrame) -> DataFrame:
    """The delta that brings the tiles back."""
    return delta.select("owner", "x", "y").join(tiles, ["owner", "x", "y"], "left").select("owner", "x", "y", "hash")
