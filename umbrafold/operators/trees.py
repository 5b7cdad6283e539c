"""Trees of (id, parent): walks, depths, checks, and groups of neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.operators.lineage import staged


def lifted(nodes: DataFrame) -> DataFrame:
    """(id, up, path) of nodes(id, parent): the way up as far as it goes. path ends with id; up is null where path starts with a root.

    Where up is not null it names an id that is missing, or the node hangs on a cycle. Each round doubles the length of all paths, so a tree of depth d
    takes about log2(d) joins; the tables between rounds are written. Nodes whose way is not at its end get fewer in every round unless all of them
    hang on cycles, and then the rounds end.
    """
    state = nodes.select("id", F.col("parent").alias("up"), F.array("id").alias("path"), F.col("parent").isNull().alias("ended"))
    left = None
    while True:
        state = staged(state, "lifted")
        now = state.where("NOT ended").count()
        if not now or now == left:
            return state.select("id", "up", "path")
        left = now
        above = state.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("path").alias("before"), F.col("ended").alias("over"))
        rest = state.where("NOT ended").join(above, F.col("up") == F.col("at"), "left")
        there = F.col("at").isNotNull()
        up, path = F.when(there, F.col("next")).otherwise(F.col("up")), F.when(there, F.concat("before", "path")).otherwise(F.col("path"))
        state = state.where("ended").union(rest.select("id", up.alias("up"), path.alias("path"), F.coalesce("over", F.lit(True)).alias("ended")))


def levels(nodes: DataFrame) -> DataFrame:
    """(id, parent, depth, path) of nodes(id, parent) of any depth; path holds the ids from the root. Raises where a node reaches no root."""
    found = lifted(nodes)
    if not found.where("up IS NOT NULL").isEmpty():
        raise ValueError("the tree has a cycle or an orphan")
    size = F.size("path")
    return found.select("id", F.when(size > 1, F.get("path", size - 2)).alias("parent"), (size - 1).alias("depth"), "path")


def hanging(nodes: DataFrame) -> DataFrame:
    """The ids of nodes(id, parent) whose way up ends at an id that is missing, however far up; nodes on a cycle are not among them."""
    open_ends = lifted(nodes).where("up IS NOT NULL").select("id", "up")
    return open_ends.join(nodes.select(F.col("id").alias("up")), "up", "left_anti").select("id").distinct()


def problems(nodes: DataFrame) -> DataFrame:
    """(id, problem): ids that occur twice, parents that are missing, nodes that are their own parents."""
    twice = nodes.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate").alias("problem"))
    orphan = nodes.where("parent IS NOT NULL").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("orphan").alias("problem"))
    return twice.union(orphan).union(nodes.where("id = parent").select("id", F.lit("loop").alias("problem")))


def runs(rows: DataFrame, group: str, order: list[str], starts: Column) -> DataFrame:
    """Rows with `run` added: the number, in each group, of rows so far at which a run starts."""
    return rows.withColumn("run", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(group).orderBy(*order)))
