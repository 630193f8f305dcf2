"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return shared.join_counted(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = shared.join_counted(edges, least, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """True if the edges are stars: every u has one v, and no v is a u. Then v is the least id of its component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return roles.where("below + above > 1").isEmpty()


def components(links: DataFrame, work: shared.Workspace, name: str = "components", known: DataFrame | None = None) -> DataFrame:
    """(id, component) for every id in links (a, b): the least id that it reaches.

    known: the result for earlier links, which stay valid; only the new links between its components are worked on.
    Each round is written to the shared folder; the rounds needed grow with the logarithm of the longest path.
    """
    if known is not None:
        if links.isEmpty():
            return known
        for end in "ab":
            of_end = known.select(F.col("id").alias(end), "component")
            links = links.join(of_end, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, n = work.save(edges, f"{name}-0"), 0
    while not _settled(edges):
        n += 1
        edges = work.save(_small(_large(edges)), f"{name}-{n}")
        work.drop(f"{name}-{n - 1}")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    if known is None:
        return found
    moved = found.select(F.col("id").alias("component"), F.col("component").alias("to"))
    merged = known.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return merged.union(found.join(known, "id", "left_anti"))
