"""Connected components by alternating star contractions, with every round in the shared folder.

A node with more neighbours than a `HUBS`-th of the edges is a hub.  There are at most 2 * HUBS of them at any
size, so the list of hubs is broadcast, and the joins on a hub are dealt to as many tasks as it needs.  Rounds without
hubs, as most are, need no join: a window over each node's neighbours finds the smallest.  Edges are dealt to as many
tasks as they need, at most the session's shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.llm.tables import partitions, scratch, stored

HUBS = 1000
LEAST = 64  # neighbours of a hub at least
EDGES = 5000  # of a task at least, where 8 tasks don't do


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m, the smallest v of each u."""
    limit = max(LEAST, n // HUBS)
    tasks = min(partitions(edges.sparkSession), max(8, n // EDGES))
    grouped = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # summed before the shuffle, so a hub is a row a task
    if (grouped.agg(F.max("n")).first()[0] or 0) <= limit:
        return edges.repartition(tasks, "u").withColumn("m", F.min("v").over(Window.partitionBy("u")))
    hubs = F.broadcast(grouped.where(F.col("n") > limit).select("u", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = edges.join(hubs, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int")).drop("parts")
    right = grouped.drop("n").join(hubs, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["u", "part"]).drop("part")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its neighbours below are linked to the smallest of these."""
    near = _with_least(edges, n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    tasks = min(partitions(edges.sparkSession), max(8, n // EDGES))
    return near.where("u <> v").repartition(tasks, "u", "v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with an edge, component being the smallest node within reach.

    Edges may repeat, stand either way round, or join a node to itself; those with a null count for nothing.
    """
    with scratch(edges.sparkSession):
        u, v = F.col(a), F.col(b)
        now = stored(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
        before = _state(now)
        while True:
            large = stored(_large_star(now, before[0]), "edges")
            now = stored(_small_star(large, before[0]), "edges")
            if (state := _state(now)) == before:
                break
            before = state
        nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return stored(nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", outer=True)
