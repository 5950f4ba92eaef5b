"""Connected components by alternating star contraction, all in DataFrame joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import ensure_checkpoint_dir

#: Rounds are logarithmic in the largest component; this only guards against a defect.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest reachable node.

    Edges are undirected; loops, repeats and nulls are allowed and add nothing. Each round hangs
    larger neighbours on the smallest one, first among all neighbours, then among smaller ones; it
    needs no neighbour lists, only a minimum for each node and a join. Lineage is cut by a reliable
    checkpoint each round, so that lost executors cost one round at most.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    a, b = F.col(src), F.col(dst)
    now = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = _small_star(_large_star(now)).checkpoint()
        state, before = _state(now), state
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Equal states mean, but for a hash collision, equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
