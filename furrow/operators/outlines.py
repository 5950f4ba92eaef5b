"""Outlines of lattice zones as loops: edges that cancel, straight runs, and list ranking by pointer jumping.

A cell has its ground on the left of its four directed sides; a side shared by two cells of a zone cancels. What is left leads from edge to edge: where two go on (a
pinch, two cells that meet at a corner only) the one to the right is taken. Straight runs become one edge. Loops are then numbered by pointer
jumping: in each round every edge knows twice as many of those that follow it, so a loop of n corners takes about
2 log2(n) joins on edge keys, whatever its zone's size, and no zone lies in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import ensure_checkpoint_dir

HALF = 1 << 28


def loop_edges(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, x1, y1, x2, y2, turn_x, turn_y): the straight edges of the zones' outlines, and the direction in which each one's follower leaves."""
    x, y = F.col("col").cast("long"), F.col("row").cast("long")
    side = lambda a, b, dx, dy: F.struct(a.alias("x"), b.alias("y"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
    sides = F.array(side(x, y, 1, 0), side(x + 1, y, 0, 1), side(x + 1, y + 1, -1, 0), side(x, y + 1, 0, -1))
    single = cells.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    # Opposite sides share their smaller end and whether they are level; those that stand alone stay.
    low = [F.least("x", F.col("x") + F.col("dx")).alias("lx"), F.least("y", F.col("y") + F.col("dy")).alias("ly"), (F.col("dx") != 0).alias("level")]
    alone = single.groupBy(*keys, *low).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("x", "y", "dx", "dy")]).filter("n = 1")
    line, along = F.when(F.col("level"), F.col("y")).otherwise(F.col("x")), F.when(F.col("level"), F.col("x")).otherwise(F.col("y"))
    w = Window.partitionBy(*keys, "dx", "dy", "line").orderBy("along")
    runs = alone.select(*keys, "dx", "dy", line.alias("line"), along.alias("along")).withColumn("island", F.col("along") - F.row_number().over(w))
    runs = runs.groupBy(*keys, "dx", "dy", "line", "island").agg(F.min("along").alias("low"), F.max("along").alias("high"))
    forward = F.col("dx") + F.col("dy") > 0
    begin, end = F.when(forward, F.col("low")).otherwise(F.col("high") + 0), F.when(forward, F.col("high") + 1).otherwise(F.col("low") - 1)
    level = F.col("dx") != 0
    at = lambda v: (F.when(level, v).otherwise(F.col("line")), F.when(level, F.col("line")).otherwise(v))
    (x1, y1), (x2, y2) = at(begin), at(end)
    edges = runs.select(*keys, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "dx", "dy")
    leaves = edges.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("dx").alias("ox"), F.col("dy").alias("oy"))
    cross = F.col("dx") * F.col("oy") - F.col("dy") * F.col("ox")
    follows = edges.join(leaves, [*keys, "x2", "y2"]).groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min(F.struct(cross.alias("turn"), "ox", "oy")).alias("f"))
    return follows.select(*keys, "x1", "y1", "x2", "y2", F.col("f.ox").alias("turn_x"), F.col("f.oy").alias("turn_y"))


def _edge(x: Column, y: Column, dx: Column, dy: Column) -> Column:
    """An edge by where it begins and its direction: at one corner no two leave in one direction. Coordinates fit 29 bits, signed."""
    return ((x + HALF) * (2 * HALF) + (y + HALF)) * 4 + F.when(dx > 0, 0).when(dy > 0, 1).when(dx < 0, 2).otherwise(3)


def outline_corners(cells: DataFrame, zone: str) -> DataFrame:
    """(zone, loop, seq, x, y): the corners of each zone's loops in order, from each loop's least edge on.

    `loop` is that edge's key; outer loops run counter-clockwise, holes clockwise. The number of rounds follows from the longest
    outline; each round's narrow rows are checkpointed.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    e = loop_edges(cells.select(zone, "col", "row").distinct(), zone)
    dx, dy = F.signum(F.col("x2") - F.col("x1")), F.signum(F.col("y2") - F.col("y1"))
    e = e.select(zone, _edge(F.col("x1"), F.col("y1"), dx, dy).alias("edge"), _edge(F.col("x2"), F.col("y2"), F.col("turn_x"), F.col("turn_y")).alias("next"), F.col("x1").alias("x"), F.col("y1").alias("y")).checkpoint()
    longest = e.groupBy(zone).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rounds = max(1, math.ceil(math.log2(longest or 1)))
    narrow = e.select(zone, "edge", "next")
    least = narrow.select(zone, "edge", "next", F.least("edge", "next").alias("least"))
    for _ in range(rounds):
        far = least.select(zone, F.col("edge").alias("next"), F.col("next").alias("after"), F.col("least").alias("other"))
        least = least.join(far, [zone, "next"]).select(zone, "edge", F.col("after").alias("next"), F.least("least", "other").alias("least")).checkpoint()
    named = narrow.join(least.select(zone, "edge", "least"), [zone, "edge"])
    # Steps from each edge to the end of its loop, the edge before the least one.
    steps = named.select(zone, "edge", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), "least", F.when(F.col("next") != F.col("least"), 1).otherwise(0).alias("steps")).checkpoint()
    for _ in range(rounds):
        far = steps.select(zone, F.col("edge").alias("next"), F.col("next").alias("after"), F.col("steps").alias("more"))
        joined = steps.join(far, [zone, "next"], "left")
        steps = joined.select(zone, "edge", F.col("after").alias("next"), "least", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")).checkpoint()
    length = steps.groupBy(zone, "least").agg(F.max("steps").alias("last"))
    placed = steps.join(length, [zone, "least"]).select(zone, "edge", F.col("least").alias("loop"), (F.col("last") - F.col("steps")).alias("seq"))
    return placed.join(e.select(zone, "edge", "x", "y"), [zone, "edge"]).select(zone, "loop", "seq", "x", "y")


def outlines(cells: DataFrame, zone: str) -> DataFrame:
    """(zone, loop, area, points): one row a loop with its corners, the largest of a zone as loop 0; holes have negative area.

    A loop's corners are as many as its zone's outline has; `outline_corners` keeps them as rows.
    """
    rows = outline_corners(cells, zone)
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    loops = rows.groupBy(zone, "loop").agg(points.alias("points"))
    after = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    area = F.aggregate(F.zip_with("points", after, lambda p, q: p[0] * q[1] - p[1] * q[0]), F.lit(0.0), lambda s, v: s + v) / 2
    sized = loops.withColumn("area", area)
    order = Window.partitionBy(zone).orderBy(F.abs("area").desc(), "loop")
    return sized.select(zone, (F.row_number().over(order) - 1).alias("loop"), "area", "points")
