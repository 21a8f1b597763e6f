"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.plans.runtime import cut

#: Edges of a task, below which tasks are joined.
TASK_EDGES = 50_000


def _digest(edges: DataFrame) -> tuple:
    """What two equal edge sets have in common: count and an order-free hash sum."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u")
    return larger.join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least.hint("shuffle_hash"), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge to another node; component is the smallest node.

    Edges are undirected; nulls, self-loops and repeats don't count. Nodes without links don't appear.
    Each round shuffles the edges on their node and pre-aggregates minima on the map side, so that a
    hub's rows meet in no single group: a join brings the minimum back, and its hub side can be split
    by adaptive execution. The rounds grow with the logarithm of the longest chain. Only a count and
    a hash sum of the edges reach the driver.
    """
    a, b = F.col(src), F.col(dst)
    now = (
        edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    now = cut(now)
    seen = _digest(now)
    while seen[0]:
        # Few edges are handed on by few tasks, as each leaves files.
        tasks = max(now.sparkSession.sparkContext.defaultParallelism, -(-seen[0] // TASK_EDGES))
        now = cut(_small_star(_large_star(now.coalesce(tasks)).coalesce(tasks)).distinct().coalesce(tasks))
        new = _digest(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
