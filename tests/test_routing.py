"""Ways inside fields, headlands by edge, uploads that go on, and marks with undo."""

import datetime
import random

import numpy as np
import plane
import pytest
from pyspark.sql import functions as F

from furrow.functions import rings
from furrow.operators import marks, routing
from furrow.operators import zones as zn
from furrow.streaming import leases

AT = lambda n, e: {"lat": 41 + n / 111320, "lng": -93 + e / 84000}
SHOE = [AT(*p) for p in ((0, 0), (0, 100), (80, 100), (80, 70), (20, 70), (20, 30), (80, 30), (80, 0))]
xy = lambda p: np.array([p["lat"], p["lng"]])


def test_routes_go_round_the_notch(spark):
    legs = [(1, AT(60, 10), AT(60, 90), [SHOE]), (2, AT(60, 10), AT(5, 10), [SHOE]), (3, AT(60, 10), AT(60, 90), [SHOE[:3], SHOE[5:]]), (4, AT(60, 10), AT(60, 90), []), (5, None, AT(1, 1), [SHOE])]
    point = "struct<lat:double,lng:double>"
    df = spark.createDataFrame(legs, f"leg int, a {point}, b {point}, rings array<array<{point}>>")
    got = {r.leg: r for r in routing.routes_inside(df, "leg").collect()}
    assert set(got) == {1, 2, 3, 4}
    field = routing.Field([SHOE])
    path = [xy(p.asDict()) for p in got[1].path]
    assert got[1].inside and 4 <= len(path) <= 8 and got[1].steps > 48
    assert np.array_equal(path[0], xy(AT(60, 10))) and np.array_equal(path[-1], xy(AT(60, 90)))
    assert all(field.straight(a, b) for a, b in zip(path, path[1:], strict=False))
    assert 129 < got[1].length_m < 160  # 129.4 m round both corners
    assert got[2].inside and got[2].steps == 0 and len(got[2].path) == 2
    assert not got[4].inside and len(got[4].path) == 2
    assert not got[3].inside or len(got[3].path) > 2


def test_shortest_steps_are_those_of_the_slow_version():
    rng = random.Random(5)
    for _ in range(30):
        free = np.array([[rng.random() < 0.7 for _ in range(9)] for _ in range(9)])
        cells = [(r, c) for r in range(9) for c in range(9) if free[r, c]]
        (a, b), flat = rng.sample(cells, 2), free.ravel()
        far = {a: 1}
        edge = [a]
        for r, c in edge:
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= n[0] < 9 and 0 <= n[1] < 9 and free[n] and n not in far:
                    far[n] = far[(r, c)] + 1
                    edge.append(n)
        way = routing._steps(flat, a[0] * 9 + a[1], b[0] * 9 + b[1], 9)
        assert len(way) == far.get(b, 0)
        assert all(abs(p // 9 - q // 9) + abs(p % 9 - q % 9) == 1 for p, q in zip(way, way[1:], strict=False))


def test_an_interior_point_is_inside_and_near_the_mean(spark):
    point = "struct<lat:double,lng:double>"
    df = spark.createDataFrame([(1, SHOE), (2, SHOE[:2])], f"k int, ring array<{point}>")
    got = {r.k: r.p for r in df.select("k", rings.interior_point(F.col("ring")).alias("p")).collect()}
    assert got[2] is None
    flat = np.array([(p["lng"], p["lat"]) for p in SHOE])
    assert plane.inside(np.array([[got[1].lng, got[1].lat]]), flat)[0] and not plane.inside(flat.mean(axis=0)[None], flat)[0]


def test_headlands_by_edge(spark):
    metres = [(0.0, 0.0), (90.0, 4.0), (100.0, 61.0), (-7.0, 55.0)]
    ring = [{"lat": y / 111320, "lng": x / 111320} for x, y in metres]
    point = "struct<lat:double,lng:double>"
    cases = [(1, [5.0, 0.0, 2.0, 9.0]), (2, [3.0] * 4), (3, [0.0] * 4), (4, [40.0, 0.0, 0.0, 0.0])]
    df = zn.with_width(spark.createDataFrame([(k, ring, by) for k, by in cases], f"k int, ring array<{point}>, by array<double>"), out="w")
    got = {r.k: r.h for r in df.select("k", rings.headland_by_edge(F.col("ring"), F.col("w"), F.col("by")).alias("h")).collect()}
    for k, by in cases:
        kind, _, share, _ = plane.headland(np.array(metres), np.array(by))
        assert got[k].kind == ("applied" if kind == "inset" else "waived") and got[k].scale == pytest.approx(share, rel=1e-4)
    same = df.filter("k = 2").select(rings.headland(F.col("ring"), F.col("w"), F.lit(3.0)).alias("h")).first().h
    assert same == got[2]


def test_uploads_go_on_from_a_fresh_checkpoint(spark):
    now = datetime.datetime(2026, 8, 20, 12)
    files = spark.createDataFrame([(b, f"{b}-{i}") for b in "pq" for i in range(4)], "batch string, key string")
    none = spark.createDataFrame([], "batch string, saved_at timestamp, done array<string>")
    tried = spark.createDataFrame([("p-0", True), ("p-1", False), ("q-2", True), ("p-1", False)], "key string, ok boolean")
    stored = leases.checkpoint_uploads(none, files, tried, F.lit(now))
    assert {r.batch: set(r.done) for r in stored.collect()} == {"p": {"p-0"}, "q": {"q-2"}}
    left = lambda s, at: {r.key for r in leases.resume_uploads(files, s, F.lit(at)).collect()}
    assert left(stored, now + datetime.timedelta(hours=24)) == {"p-1", "p-2", "p-3", "q-0", "q-1", "q-3"}
    assert len(left(stored, now + datetime.timedelta(hours=25))) == 8
    more = spark.createDataFrame([(f"p-{i}", True) for i in (1, 2, 3)], "key string, ok boolean")
    later = leases.checkpoint_uploads(stored, files.filter("batch = 'p'"), more, F.lit(now + datetime.timedelta(hours=1)))
    assert {r.batch: (set(r.done), r.saved_at) for r in later.collect()} == {"q": ({"q-2"}, now)}  # a batch that is all done needs none


def clicks(*actions):
    return [(1, i, *a) for i, a in enumerate(actions)]


def test_marks_with_undo(spark):
    log = "session int, seq int, action string, cell string, label string"
    run = lambda *a: {r.cell: r.label for r in marks.replay(spark.createDataFrame(clicks(*a), log), "session", "seq").collect()}
    mark, undo, clear, unmark = lambda c, x="t": ("mark", c, x), ("undo", None, None), ("clear", None, None), lambda c: ("unmark", c, None)
    assert run(mark("a"), mark("b", "u")) == {"a": "t", "b": "u"}
    assert run(mark("a"), mark("a")) == {} and run(mark("a"), mark("a", "u")) == {"a": "u"}
    assert run(mark("a"), mark("b"), undo) == {"a": "t"} and run(undo, mark("a"), undo, undo) == {}
    assert run(mark("a"), mark("a", "u"), undo) == {"a": "t"} and run(mark("a"), mark("a"), undo) == {"a": "t"}
    assert run(mark("a"), mark("b"), clear, undo) == {"a": "t", "b": "t"} and run(mark("a"), clear, undo, undo) == {}
    assert run(mark("a"), unmark("z"), clear, clear, undo) == {"a": "t"}  # what changes nothing is no step
    assert run(mark("a"), unmark("a"), undo) == {"a": "t"}
    many = [mark(str(i)) for i in range(150)] + [undo] * 200
    assert set(run(*many)) == {str(i) for i in range(50)}  # a hundred steps back, no more
    assert run(("odd", "a", "t"), ("mark", None, "t"), ("mark", "a", None)) == {}


def test_marks_are_those_of_whole_snapshots(spark):
    rng = random.Random(3)
    rows = []
    want = {}
    for s in (None, *range(6)):
        state, history = {}, []
        for i in range(400):
            action, cell, label = rng.choices(["mark", "unmark", "undo", "clear"], [60, 10, 25, 3])[0], rng.choice("abcde"), rng.choice("tu")
            rows.append((s, i, action, cell, label))
            before = dict(state)
            if action == "undo":
                state = history.pop() if history else state
                continue
            if action == "clear":
                state = {}
            elif action == "unmark":
                state = {k: v for k, v in state.items() if k != cell}
            else:
                state = {k: v for k, v in state.items() if k != cell} | ({} if before.get(cell) == label else {cell: label})
            if action == "mark" or state != before:
                history = [*history, before][-100:]
        want[s] = state
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session int, seq int, action string, cell string, label string").repartition(7)
    got = {s: {} for s in want}
    for r in marks.replay(df, "session", "seq").collect():
        got[r.session][r.cell] = r.label
    assert got == want and marks.replay(df, "session", "seq", every=True).count() == len(rows)
