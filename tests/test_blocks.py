"""Blocks: the invariants of closing gaps and cutting rectangles."""

import random

import pytest

from furrow.operators import blocks as bl

AREA = 36.0


@pytest.fixture(scope="module")
def grid(spark):
    def make(treated, skips=(), size=14):
        rates = dict(treated)
        rows = [
            (1, c, r, AREA, "treated" if (c, r) in rates else "skip" if (c, r) in skips else "default", rates.get((c, r)))
            for c in range(size) for r in range(size)
        ]
        return spark.createDataFrame(rows, "field int, col int, row int, area double, state string, rate double")

    return make


def solid(c0, r0, w, h, rate=20.0, without=()):
    return {(c0 + i, r0 + j): rate for i in range(w) for j in range(h) if (i, j) not in without}


def plan(cells, tolerance=bl.DEFAULT_TOLERANCE):
    closed = bl.close_gaps(cells, "field", tolerance).cache()
    selection, blocks = closed.collect(), bl.blocks(closed, "field").collect()
    closed.unpersist()
    covered = [(c, r) for b in blocks for c in range(b.col0, b.col0 + b.cols) for r in range(b.row0, b.row0 + b.rows)]
    assert len(covered) == len(set(covered)) == sum(b.cells for b in blocks)
    assert set(covered) == {(s.col, s.row) for s in selection}
    return blocks, set(covered), {(s.col, s.row) for s in selection if s.added}


def test_zero_tolerance_gives_the_selection(grid):
    marked = {**solid(3, 3, 5, 5, without={(2, 2)}), (8, 5): 20.0}
    totals = bl.block_totals(grid(marked), "field", 0.0).first()
    _, covered, added = plan(grid(marked), 0.0)
    assert covered == set(marked) and not added
    assert not totals.enabled and totals.added_area == totals.added_litres == 0 and totals.sprayed_area == totals.marked_area == 25 * AREA


def test_more_tolerance_adds_area_and_leaves_fewer_blocks(grid):
    cells = grid(solid(3, 3, 7, 7, without={(2, 2), (4, 1), (1, 5), (5, 5), (3, 4)}))
    off, some = (bl.block_totals(cells, "field", t).first() for t in (0.0, bl.DEFAULT_TOLERANCE))
    assert some.added_area > 0 and some.blocks < off.blocks and some.sprayed_area == some.marked_area + some.added_area
    assert some.added_area <= bl.DEFAULT_TOLERANCE * some.marked_area


def test_kernel_and_ceiling():
    assert [bl.kernel_radius(t) for t in (0, bl.DEFAULT_TOLERANCE, 0.2)] == [0, 1, 2]
    assert bl.tolerance_used(5) == 0.25 and bl.tolerance_used(-1) == 0


def test_a_notch_is_filled_and_priced(grid):
    blocks, _, added = plan(grid(solid(3, 3, 5, 5, 30.0, without={(2, 2)})))
    assert [(b.cols, b.rows, b.cells, b.added_area) for b in blocks] == [(5, 5, 25, AREA)] and added == {(5, 5)}
    totals = bl.block_totals(grid(solid(3, 3, 5, 5, 30.0, without={(2, 2)})), "field").first()
    assert totals.added_litres == pytest.approx(AREA / 10_000 * 30) and totals.sprayed_litres == pytest.approx(totals.marked_litres + totals.added_litres)


@pytest.mark.parametrize("spur", [(8, 5), (5, 8), (2, 4), (4, 2)])
def test_a_spur_is_a_block_of_its_own(grid, spur):
    blocks, covered, _ = plan(grid({**solid(3, 3, 5, 5), spur: 20.0}))
    assert sorted((b.cols, b.rows) for b in blocks) == [(1, 1), (5, 5)] and len(covered) == 26


@pytest.mark.parametrize("tolerance", [0, 0.02, 0.08, 0.15, 0.25])
def test_no_marked_cell_is_dropped_and_no_skip_taken(grid, tolerance):
    marked = {**solid(3, 3, 6, 4), (9, 4): 20.0, (2, 5): 20.0, (5, 8): 20.0, (11, 11): 20.0}
    _, covered, _ = plan(grid(marked), tolerance)
    assert set(marked) <= covered
    skips = {(6, 6), (7, 6), (6, 7), (7, 7)}
    _, covered, added = plan(grid({k: v for k, v in solid(3, 3, 7, 7).items() if k not in skips}, skips), tolerance)
    assert not covered & skips and not added & skips


def test_rates_are_not_mixed(grid):
    blocks, _, _ = plan(grid({**solid(2, 2, 4, 4, 20.0), **solid(6, 2, 4, 4, 40.0)}))
    assert sorted((b.rate, b.col0, b.cols, b.rows) for b in blocks) == [(20.0, 2, 4, 4), (40.0, 6, 4, 4)]


def test_a_skip_is_a_hole_and_is_told(grid):
    cells = grid(solid(3, 3, 5, 5, without={(2, 2)}), {(5, 5)})
    _, covered, added = plan(cells)
    assert (5, 5) not in covered and not added and bl.block_totals(cells, "field").first().spared_skips == 1
    beside = grid(solid(3, 3, 6, 5, without={(2, 2), (3, 2)}), {(6, 5)})
    _, _, added = plan(beside)
    assert added == {(5, 5)} and bl.block_totals(beside, "field").first().spared_skips == 1


def test_cells_that_the_field_lacks_are_not_added(grid, spark):
    cells = grid(solid(3, 3, 5, 5, without={(2, 2)})).filter("NOT (col = 5 AND row = 5)")
    assert plan(cells)[2] == set()


def test_rectangles(spark):
    def cut(cells):
        df = spark.createDataFrame([(1, *c) for c in cells], "k int, col int, row int")
        return sorted((r.col0, r.row0, r.cols, r.rows) for r in bl.rectangles(df, "k").collect())

    assert cut([(c, r) for c in range(6) for r in range(4)]) == [(0, 0, 6, 4)]
    ell = [(c, r) for r in range(4) for c in range(2 if r < 2 else 4)]
    assert len(cut(ell)) == 2 and sum(w * h for *_, w, h in cut(ell)) == len(ell)
    rng = random.Random(4)
    for share in (0.3, 0.6, 0.9):
        cells = [(c, r) for c in range(9) for r in range(9) if rng.random() < share]
        covered = [(c0 + i, r0 + j) for c0, r0, w, h in cut(cells) for i in range(w) for j in range(h)]
        assert sorted(covered) == sorted(cells)


def test_a_block_on_the_ground(spark):
    df = spark.createDataFrame([(2, 3, 4, 5)], "col0 int, row0 int, cols int, rows int")
    from pyspark.sql import functions as F

    ring = df.select(bl.block_ring(F.lit(41.0), F.lit(-89.0), 6.0, 0.0).alias("r")).first().r
    assert len(ring) == 4 and ring[0].lat == pytest.approx(41 + 18 / 111320) and ring[2].lat == pytest.approx(41 + 48 / 111320)
