"""Connected components on an edge DataFrame (alternating large-star / small-star).

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each round is two grouped ``min`` aggregations and two joins; the edge set is
written with a reliable ``checkpoint()`` every round, so lineage stays short
and a lost executor recomputes one round, not the whole loop. The loop stops
when the edges form a star forest (every node points at its component
minimum), which is exactly the fixpoint of both steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import ensure_checkpoint_dir


def _large_star(e: DataFrame) -> DataFrame:
    # m(u) = min of u and its neighbours; connect every larger neighbour v > u to m(u)
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("mn")).withColumn("mn", F.least("mn", "u"))
    return (both.filter(F.col("v") > F.col("u")).join(m, "u")
            .select(F.col("v").alias("hi"), F.col("mn").alias("lo")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    # for every node u: m = min of its lower neighbours; connect u and those neighbours to m
    m = e.groupBy("hi").agg(F.min("lo").alias("mn"))
    moved = (e.join(m, "hi").select(F.col("lo").alias("hi"), F.col("mn").alias("lo"))
             .filter(F.col("hi") != F.col("lo")))
    return moved.unionByName(m.select("hi", F.col("mn").alias("lo"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """One aggregation: no node has two outgoing edges or is both a leaf and a centre."""
    roles = e.select(F.col("hi").alias("n"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionByName(
        e.select(F.col("lo").alias("n"), F.lit(0).alias("h"), F.lit(1).alias("l")))
    bad = (roles.groupBy("n").agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
           .filter((F.col("h") > 1) | ((F.col("h") > 0) & (F.col("l") > 0))))
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, root)`` for every node that has an edge; root = smallest id of its component.

    Nodes without edges are their own component and do not appear here. Nodes
    may be of any type that can be ordered. Every round moves edges to smaller
    nodes, so the loop ends.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = (edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
         .filter(F.col("hi") != F.col("lo")).distinct().checkpoint())
    while not _is_star_forest(e):
        e = _small_star(_large_star(e)).checkpoint()
    roots = e.select("lo").distinct().select(F.col("lo").alias("id"), F.col("lo").alias("root"))
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(roots)
