"""Connected components by alternating large-star and small-star steps.

Each step is an aggregation and a join on node keys; lineage is cut by a written
table after every round.  The number of rounds grows with the logarithm of the
longest path, and nothing but a count goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Rows (a, b), a < b.  Large: every larger neighbour of a node links to the node's smallest
    neighbour or itself.  Small: every smaller neighbour and the node do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Edges are rows (a, b); direction, repetition and loops don't matter.
    """
    spark = edges.sparkSession
    plain = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, at = written(plain, "edges")
    total = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    mark = total(now)
    for _ in range(most):
        if not mark["n"]:
            break
        new, new_at = written(_star(_star(now, large=True), large=False), "edges")
        new_mark = total(new)
        remove(spark, at)
        now, at, done, mark = new, new_at, new_mark == mark, new_mark
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def joined_components(component: DataFrame, edges: DataFrame) -> DataFrame:
    """``component`` (node, component) after further ``edges`` (a, b) between any nodes.

    Only the components that edges join are looked at again, not what is inside them.
    """
    name = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    met = edges.join(name("a"), "a", "left").join(name("b"), "b", "left")
    met, at = written(met.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "joining")
    moved, moved_at = written(connected_components(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "moved")
    fresh = met.filter("a = ca").select(F.col("a").alias("node")).unionByName(met.filter("b = cb").select(F.col("b").alias("node"))).distinct()
    fresh = fresh.join(component, "node", "left_anti").withColumn("component", F.col("node"))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("__to"))
    out, _ = written(component.unionByName(fresh).join(to, "component", "left").select("node", F.coalesce("__to", "component").alias("component")), "components")
    remove(edges.sparkSession, at, moved_at)
    return out
