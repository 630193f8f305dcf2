"""Graphs as edge tables (src, dst): counters by aggregation, orders and closures by frontier loops.

Loops run a small job per level and write each level to the shared folder (lineage.Levels), so a level plans and runs
in the same time whatever came before, and lost executors cost one level. Nodes never reach the driver. The
number of jobs is the depth of the graph: thousands of levels are thousands of jobs. Edges, which every level reads, are
written there first, in as few files as their size needs: a cached table would keep all partitions of its last shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Levels


class CycleError(ValueError):
    pass


def nodes_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The ends of edges, and the nodes given besides, with or without edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (ends if nodes is None else ends.union(nodes.select("node"))).distinct()


def edge_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, fault of edges that may not be added: an end that is no node, checked first, or a loop."""
    n = nodes.select("node").distinct()
    ends = edges.join(n.select(F.col("node").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(n.select(F.col("node").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    fault = F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "node_not_found").when(F.col("src") == F.col("dst"), "self_loop")
    return ends.select("src", "dst", fault.alias("fault")).where("fault is not null")


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, out_degree, in_degree; nodes (node) without edges have zeros."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    if nodes is not None:
        both = both.union(nodes.select("node", F.lit(0), F.lit(0)))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def successors(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node"))


def predecessors(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node"))


def contained(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of asked (node) that are nodes."""
    return asked.join(nodes.select("node"), "node", "left_semi")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def adjacency(edges: DataFrame, block: int = 1024) -> DataFrame:
    """node, first, degree: where each node's edges start when edges are sorted by source.

    Prefix sums go block by block: sums per block of nodes, then inside each block, so no task sums all nodes.
    """
    d = degrees(edges).select("node", "out_degree", F.floor(F.col("node") / block).alias("block"))
    sums = d.groupBy("block").agg(F.sum("out_degree").alias("n"))
    # one row per block of nodes
    before = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("out_degree").over(inside), F.lit(0))
    return d.join(before, "block").select("node", first.alias("first"), F.col("out_degree").alias("degree"))


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, level: the longest path that leads to it. Raises CycleError where some nodes never become free.

    Each round frees the nodes without edges from waiting ones and takes their edges off; what waits is written anew,
    what is free is written once.
    """
    spark = edges.sparkSession
    kept, waits, freed = Levels(spark, "edges"), Levels(spark, "waiting"), Levels(spark, "levels")
    edges = kept.append(edges.select("src", "dst"))
    waiting = waits.append(degrees(edges, nodes).select("node", F.col("in_degree").alias("left")))
    try:
        while not waiting.isEmpty():
            free = freed.append(waiting.where("left = 0").select("node"))
            if free.isEmpty():
                raise CycleError("a cycle keeps some nodes from any order")
            gone = edges.join(free.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
            rest = waiting.where("left > 0").join(gone, "node", "left").select("node", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"))
            waiting = waits.append(rest)
            waits.drop(waits.n - 2)
        if not freed.n:
            freed.append(waiting.select("node"))
    finally:
        kept.drop()
        waits.drop()
    return freed.all()


def renumbered(levels: DataFrame, block: int = 1 << 16) -> DataFrame:
    """node, new_node: dense numbers in the order of level and node.

    Nodes are dealt by level and range of nodes into groups of about a block, counted per group first, then numbered
    inside groups, so that no task orders a whole level. Strings are dealt by sampled ranges like numbers.
    """
    spark = levels.sparkSession
    rows = Levels(spark, "numbered")
    parts = max(1, -(-levels.count() // block))
    ranged = levels.repartitionByRange(parts, "level", "node").select("level", "node", F.spark_partition_id().alias("part"))
    ranged = rows.append(ranged)
    # one row per range of nodes
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy("level", "node")) - 1
    return ranged.join(F.broadcast(starts), "part").select("node", (F.col("before") + at).alias("new_node"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and all that they reach: node, and the other columns of seeds, which stay apart from each other.

    Columns that edges share with seeds besides (say, a workflow) must be equal along a path.
    """
    spark = edges.sparkSession
    key = seeds.columns
    on = [c for c in key if c != "node" and c in edges.columns]
    kept, seen = Levels(spark, "steps"), Levels(spark, "reached")
    step = kept.append(edges.select(*on, F.col("src").alias("node"), "dst"))
    frontier = seen.append(seeds.select(*key).distinct())
    while not frontier.isEmpty():
        new = frontier.join(step, [*on, "node"]).select(*[F.col("dst").alias("node") if c == "node" else F.col(c) for c in key]).distinct()
        frontier = seen.append(new.join(seen.all().drop("level"), key, "left_anti"))
    kept.drop()
    return seen.all().select(*key)


def descendants_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All that the seeds reach, without any seed, even where one reaches another."""
    return reachable(edges, seeds).join(seeds.select("node"), "node", "left_anti")


def ancestors_to(edges: DataFrame, targets: DataFrame) -> DataFrame:
    return descendants_from(reversed_edges(edges), targets)


def sub_dag_nodes(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """The nodes on paths from start to end, both included."""
    return reachable(edges, start).join(reachable(reversed_edges(edges), end), "node", "left_semi")


def sub_dag_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, new_src, new_dst: edges between the nodes, with dense numbers in the order of nodes."""
    ids = renumbered(nodes.select("node", F.lit(0).alias("level")))
    src, dst = ids.select(F.col("node").alias("src"), F.col("new_node").alias("new_src")), ids.select(F.col("node").alias("dst"), F.col("new_node").alias("new_dst"))
    return edges.join(src, "src").join(dst, "dst").select("src", "dst", "new_src", "new_dst")
