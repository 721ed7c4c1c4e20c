"""Connected components of a distributed edge list, by alternating stars.

Each round hangs all larger neighbours of a node on the least of its
neighbourhood, then all smaller ones; components become stars around their
least node in a number of rounds logarithmic in practice. Minima are taken by
partial aggregation and joined back, so a node with many edges is no group in
one task. Every round is written to the shared folder, and the one before goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u > v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.where("below > 1 OR below + above > 1").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v); large: around every node, else among a node's smaller neighbours."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    seen = near.join(least, "u")
    if large:
        moved = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = seen.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of (a, b) edges reaches."""
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        last, now = now, stored(_star(_star(now, True), False), "edges")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.stored_at = now.stored_at
    return out


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component), stored, that further links (a, b) make of ``parts``; only components that they join are looked at again."""
    own = lambda df, col: df.join(parts.toDF(col, "__at"), col, "left").withColumn(col, F.coalesce("__at", col)).drop("__at")
    crossing = stored(own(own(links.select("a", "b"), "a"), "b").where("a != b").distinct(), "crossing")
    if crossing.isEmpty():
        discard(crossing)
        return parts
    moved = connected(crossing)
    # A node that had no link was its own component.
    every = parts.union(moved.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    out = every.join(moved.toDF("component", "__to"), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    out = stored(out, "parts")
    discard(crossing, moved, parts)
    return out
