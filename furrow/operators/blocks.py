"""Blocks to fly from a selection of lattice cells: small gaps are closed within a tolerance, the rest is cut into rectangles.

Inferred contract: every marked cell is covered, a cell that was explicitly left out never is, rates are never mixed, a tolerance of 0 gives the
selection as it is, and what is added is reported. All steps are grouped counts and joins on neighbours' keys. A lattice bounds a field's cells, so
growing and shrinking keep a field's cells in one partition, as sorted or hashed rows and never as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.session import shuffle_width

#: Share of the marked area that may be added if nothing is asked for, the most that ever is, and from which share on gaps are closed with the wider
#: kernel. Fixed values, the first and the last inferred.
DEFAULT_TOLERANCE, MAX_TOLERANCE, WIDE_FROM = 0.08, 0.25, 0.16


def tolerance_used(tolerance: float) -> float:
    return min(MAX_TOLERANCE, max(0.0, tolerance))


def kernel_radius(tolerance: float) -> int:
    """How far cells are grown and shrunk: not at all at 0, one cell by default, two at high tolerance."""
    used = tolerance_used(tolerance)
    return 0 if used == 0 else 1 if used < WIDE_FROM else 2


def _square(low: int, high: int) -> Column:
    steps = range(low, high + 1)
    return F.array(*[F.struct(F.lit(c).alias("dc"), F.lit(r).alias("dr")) for c in steps for r in steps])


def _moved(cells: DataFrame, keys: list[str], by: Column) -> DataFrame:
    moved = cells.select(*keys, "col", "row", F.explode(by).alias("d"))
    return moved.select(*keys, (F.col("col") + F.col("d.dc")).alias("col"), (F.col("row") + F.col("d.dr")).alias("row"))


def _by_field(cells: DataFrame, field: str) -> DataFrame:
    """The cells with those of a field together, so that the many rows that growing makes of each are counted where they are and never shuffled."""
    return cells.repartition(shuffle_width(cells.sparkSession, cells), field)


def gaps(cells: DataFrame, field: str, radius: int) -> DataFrame:
    """(field, rate, col, row, near, area, skip): cells that growing and shrinking the selection of one rate would take.

    `cells` holds (field, col, row, area, state, rate); states are treated, skip or anything else. `near` counts the marked cells about. A cell that two
    rates would take, or that the field doesn't have, is none.
    """
    marked = _by_field(cells.filter("state = 'treated'").select(field, "rate", "col", "row"), field)
    keys, around = [field, "rate"], _square(-radius, radius)
    grown = _moved(marked, keys, around).groupBy(*keys, "col", "row").agg(F.count("*").alias("near"))
    # A cell survives the shrinking if all cells about it were grown.
    closed = _moved(grown, keys, around).groupBy(*keys, "col", "row").agg(F.count("*").alias("n")).filter(F.col("n") == (2 * radius + 1) ** 2)
    free = cells.filter("state IS NULL OR state <> 'treated'").select(field, "col", "row", "area", F.coalesce(F.col("state") == "skip", F.lit(False)).alias("skip"))
    found = closed.select(*keys, "col", "row").join(free, [field, "col", "row"]).join(grown, [*keys, "col", "row"])
    lone = found.groupBy(field, "col", "row").agg(F.count("*").alias("k"), *[F.min(c).alias(c) for c in ("rate", "near", "area", "skip")]).filter("k = 1")
    return lone.select(field, "rate", "col", "row", "near", "area", "skip")


def close_gaps(cells: DataFrame, field: str, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """(field, rate, col, row, area, added): the marked cells and, within the tolerance, the cells of their gaps.

    Cells with most marked cells about them come first, then by row and column, until the field's added area would exceed its share.
    """
    marked = cells.filter("state = 'treated'").select(field, "rate", "col", "row", "area", F.lit(False).alias("added"))
    radius, used = kernel_radius(tolerance), tolerance_used(tolerance)
    if not radius:
        return marked
    budget = marked.groupBy(field).agg((F.sum("area") * used).alias("budget"))
    order = Window.partitionBy(field).orderBy(F.col("near").desc(), "row", "col")
    ranked = gaps(cells, field, radius).filter("NOT skip").join(budget, field).withColumn("sum", F.sum("area").over(order))
    return marked.unionByName(ranked.filter("sum <= budget").select(field, "rate", "col", "row", "area", F.lit(True).alias("added")))


def _stacked(cells: DataFrame, keys: list[str], along: str, across: str, sums: dict[str, Column]) -> DataFrame:
    """Runs of cells along one direction, equal neighbouring runs joined across it."""
    w = Window.partitionBy(*keys, across).orderBy(along)
    runs = cells.withColumn("island", F.col(along) - F.row_number().over(w)).groupBy(*keys, across, "island")
    runs = runs.agg(F.min(along).alias("first"), F.max(along).alias("last"), *[v.alias(k) for k, v in sums.items()])
    stack = Window.partitionBy(*keys, "first", "last").orderBy(across)
    piles = runs.withColumn("pile", F.col(across) - F.row_number().over(stack)).groupBy(*keys, "first", "last", "pile")
    piles = piles.agg(F.min(across).alias("low"), F.max(across).alias("high"), *[F.sum(k).alias(k) for k in sums])
    wide, tall = (F.col("last") - F.col("first") + 1), (F.col("high") - F.col("low") + 1)
    a, b = ("first", "low") if along == "col" else ("low", "first")
    cols, rows = (wide, tall) if along == "col" else (tall, wide)
    return piles.select(*keys, F.col(a).alias("col0"), F.col(b).alias("row0"), cols.alias("cols"), rows.alias("rows"), *sums)


def rectangles(cells: DataFrame, *keys: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, col0, row0, cols, rows, sums): rectangles that cover distinct cells exactly, each cell once.

    Cells of no full 2 x 2 square are spurs and stay apart, so that they leave no bite in a block. Then runs
    are stacked, along rows or along columns, whichever gives fewer rectangles for the keys' blocks or spurs.
    """
    sums, by = sums or {}, list(keys)
    corner = _moved(cells, by, _square(-1, 0)).groupBy(*by, "col", "row").agg(F.count("*").alias("n")).filter("n = 4")
    core = _moved(corner, by, _square(0, 1)).distinct().withColumn("core", F.lit(True))
    parted = cells.join(core, [*by, "col", "row"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    part = [*by, "core"]
    both = _stacked(parted, part, "col", "row", sums).withColumn("turned", F.lit(0)).unionByName(_stacked(parted, part, "row", "col", sums).withColumn("turned", F.lit(1)))
    fewer = both.groupBy(*part, "turned").agg(F.count("*").alias("n")).groupBy(*part).agg(F.min(F.struct("n", "turned")).alias("best"))
    chosen = fewer.select(*part, F.col("best.turned").alias("turned"))
    return both.join(chosen, [*part, "turned"]).select(*by, "col0", "row0", "cols", "rows", *sums)


def blocks(selection: DataFrame, field: str) -> DataFrame:
    """(field, rate, block, col0, row0, cols, rows, cells, area, added_area, litres) of the selection that `close_gaps` gives."""
    sums = {"area": F.sum("area"), "added_area": F.sum(F.when(F.col("added"), F.col("area")).otherwise(F.lit(0.0)))}
    cut = rectangles(selection, field, "rate", sums=sums)
    name = F.concat_ws(":", F.lit("b"), F.col(field).cast("string"), "col0", "row0")
    return cut.select(field, "rate", name.alias("block"), "col0", "row0", "cols", "rows", (F.col("cols") * F.col("rows")).alias("cells"), "area", "added_area", (F.col("area") / 10_000 * F.col("rate")).alias("litres"))


def block_ring(origin_lat: Column, origin_lng: Column, size_m: float, heading: float) -> Column:
    """A block's corners on the ground, counter-clockwise on the lattice: array<struct<lat,lng>>."""

    def corner(dc: Column, dr: Column) -> Column:
        lat, lng = geo.lattice_world(F.col("col0") + dc, F.col("row0") + dr, F.lit(float(size_m)), origin_lat, origin_lng, heading)
        return F.struct(lat.alias("lat"), lng.alias("lng"))

    none, cols, rows = F.lit(0), F.col("cols"), F.col("rows")
    return F.array(corner(none, none), corner(cols, none), corner(cols, rows), corner(none, rows))


def block_totals(cells: DataFrame, field: str, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """A field's plan: areas and litres that were marked, are added and are sprayed, its blocks, and the skips that stayed out of closed gaps."""
    selection = close_gaps(cells, field, tolerance)
    litres = F.col("area") / 10_000 * F.col("rate")
    own = lambda c, added: F.sum(F.when(F.col("added") == added, c).otherwise(F.lit(0.0)))
    sums = selection.groupBy(field).agg(
        own(F.col("area"), False).alias("marked_area"), own(F.col("area"), True).alias("added_area"), F.sum("area").alias("sprayed_area"),
        own(litres, False).alias("marked_litres"), own(litres, True).alias("added_litres"), F.sum(litres).alias("sprayed_litres"),
    )
    count = blocks(selection, field).groupBy(field).agg(F.count("*").alias("blocks"))
    radius = kernel_radius(tolerance)
    out = sums.join(count, field).withColumns({"tolerance_used": F.lit(tolerance_used(tolerance)), "enabled": F.lit(radius > 0)})
    if not radius:
        return out.withColumn("spared_skips", F.lit(0).cast("long"))
    spared = gaps(cells, field, radius).filter("skip").groupBy(field).agg(F.count("*").alias("spared_skips"))
    return out.join(spared, field, "left").withColumn("spared_skips", F.coalesce("spared_skips", F.lit(0).cast("long")))
