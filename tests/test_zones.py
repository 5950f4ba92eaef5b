"""Zones, tours, cells and small functions against brute force and hand-worked figures."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import geo, rings
from furrow.functions import kernels as kn
from furrow.operators import cells as cl
from furrow.operators import learning as ln
from furrow.operators import simulation as sim
from furrow.operators import timeseries as ts
from furrow.operators import zones as zn

LAT = 41.0
M_LNG = geo.M_PER_DEG * math.cos(math.radians(LAT))


def ring_of(*xy):
    """A ring of metres about (LAT, -93)."""
    return [{"lat": LAT + y / geo.M_PER_DEG, "lng": -93 + x / M_LNG} for x, y in xy]


def box(x, y, w, h):
    return ring_of((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def one(spark, ring_sets, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ring_sets)], f"i int, rings array<{rings.RING}>")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_anisotropy_is_the_plain_ratio_of_variances(spark):
    got = one(spark, [[box(0, 0, 40, 10)], [box(0, 0, 10, 10)], [ring_of((0, 0), (5, 5), (10, 10))]], rings.axis(F.col("rings")))
    assert got[0].anisotropy == pytest.approx(16, rel=1e-4) and got[0].theta == pytest.approx(0, abs=1e-6)
    assert got[1].anisotropy == pytest.approx(1, rel=1e-3) and got[2].theta == pytest.approx(math.pi / 4, rel=1e-4) and got[2].anisotropy > 1e6


def test_sweep_headings(spark):
    turned = lambda deg, w, h: ring_of(*[(x * math.cos(math.radians(deg)) - y * math.sin(math.radians(deg)), x * math.sin(math.radians(deg)) + y * math.cos(math.radians(deg))) for x, y in ((0, 0), (w, 0), (w, h), (0, h))])
    strips = [box(0, 18 * i, 60, 8) for i in range(4)]
    got = one(spark, [[turned(10, 60, 10)], [turned(40, 60, 10)], [turned(40, 20, 19)], strips, [turned(80, 60, 10)]], rings.sweep_heading(F.col("rings"), F.lit(0.0)))
    assert got[0] == 0 and got[1] == pytest.approx(math.radians(40), rel=1e-3) and got[2] == 0 and got[4] == pytest.approx(math.pi / 2)
    # a cluster fills a square box, and still its vertices are strung out
    many = one(spark, [strips, [box(0, 0, 60, 8)]], rings.heading_candidates(F.col("rings"), F.lit(0.3)))
    assert len(many[1]) == 1 and 2 <= len(many[0]) <= rings.MAX_HEADINGS
    assert all(min(abs(a - b), math.pi - abs(a - b)) >= rings.SAME_HEADING_RAD for a, b in itertools.combinations(many[0], 2))


def test_parallel_strips_are_swept_along_and_not_across(spark):
    groups = spark.createDataFrame([(1, list(range(6)), [box(0, 28 * i, 60, 10) for i in range(6)])], f"group int, members array<int>, rings array<{rings.RING}>")
    fence = F.array(F.array(*[F.struct(F.lit(p["lat"]).alias("lat"), F.lit(p["lng"]).alias("lng")) for p in box(-50, -50, 200, 300)]))
    s = zn.field_sweep(groups, fence, F.lit(math.pi / 2), 5.0).collect()
    assert {round(r.heading % math.pi, 6) for r in s} <= {0.0, round(math.pi, 6)}
    # lanes are centred and exactly a spacing apart, and each other one runs back
    lanes = sorted({(r.lane, round((r.a.lat - LAT) * geo.M_PER_DEG, 3)) for r in s})
    assert all(b[1] - a[1] == pytest.approx(5.0 * (b[0] - a[0]), abs=2e-3) for a, b in itertools.pairwise(lanes))
    east = [r.b.lng > r.a.lng for r in sorted(s, key=lambda r: r.nth)]
    assert all(a != b for a, b in itertools.pairwise(east))


def test_a_lane_over_two_rings_is_one_and_leaves_gaps(spark):
    over = [box(0, 0, 30, 6), box(20, 0, 30, 6), box(80, 0, 20, 6)]
    groups = spark.createDataFrame([(1, [7, 8, 9], over)], f"group int, members array<int>, rings array<{rings.RING}>")
    fence = F.array(F.array(*[F.struct(F.lit(p["lat"]).alias("lat"), F.lit(p["lng"]).alias("lng")) for p in box(-10, -10, 95, 40)]))
    s = sorted(zn.sweep_along(groups, fence, 6.5, F.lit(0.0), "group").collect(), key=lambda r: r.nth)
    x = lambda p: round((p.lng + 93) * M_LNG, 2)
    # the third ring's middle lies beyond the fence
    assert [(r.zone_id, x(r.a), x(r.b)) for r in s] == [(7, 0.0, 50.0)]
    wide = F.array(F.array(*[F.struct(F.lit(p["lat"]).alias("lat"), F.lit(p["lng"]).alias("lng")) for p in box(-10, -10, 300, 40)]))
    parts = zn.split_on_hops(zn.sweep_along(groups, wide, 6.5, F.lit(0.0), "group"), 20.0, "group").collect()
    assert [(r.zone_id, r.fragment) for r in sorted(parts, key=lambda r: r.nth)] == [(7, 0), (9, 1)]


def test_zone_groups_by_ring_gap(spark):
    zones = [(1, box(0, 0, 100, 5), 10.0), (2, box(0, 9, 100, 5), 10.0), (3, box(0, 19, 100, 5), 10.0), (4, box(0, 40, 9, 9), 10.0), (5, box(0, 9, 100, 5), 20.0), (6, box(110, 0, 5, 5), None), (7, box(117, 0, 5, 5), None), (8, box(20, 41, 2, 2), 10.0), (9, ring_of((0, 0), (1, 1)), 10.0), (10, box(1, 41, 2, 2), 10.00001)]
    df = spark.createDataFrame(zones, f"zone_id int, ring {rings.RING}, rate_lha double")
    got = {r.zone_id: r.group for r in zn.zone_groups(df, 6.0).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 10: 4}
    assert {r.zone_id: r.group for r in zn.zone_groups(df, 0.0).collect()} == {i: i for i in got}
    members = zn.group_rows(zn.zone_groups(df, 6.0)).collect()
    assert [r.group for r in members] == [1, 4, 5, 6, 8] and members[0].members == [1, 2, 3]


def test_ring_gaps(spark):
    pairs = [(box(0, 0, 10, 10), box(13, 0, 5, 5), 3.0), (box(0, 0, 10, 10), box(2, 2, 3, 3), 0.0), (box(0, 0, 10, 10), box(13, 14, 5, 5), 5.0), (box(0, 0, 10, 10), ring_of((0, 0)), math.inf)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], f"a {rings.RING}, b {rings.RING}")
    got = [r.g for r in df.select(rings.ring_gap(F.col("a"), F.col("b")).alias("g")).collect()]
    assert got == [pytest.approx(g, abs=1e-3) for _, _, g in pairs]


def test_headlands(spark):
    shapes = [box(0, 0, 100, 40), box(0, 0, 100, 10), box(0, 0, 100, 10.00000001), ring_of((0, 0), (0, 40), (100, 40), (100, 0)), ring_of((0, 0), (50, 0), (100, 0), (100, 40), (0, 40))]
    df = spark.createDataFrame([(i, r, 4000.0, 10.0) for i, r in enumerate(shapes)], f"zone_id int, ring {rings.RING}, area_m2 double, rate_lha double")
    out = {r.zone_id: r for r in zn.with_width(df).select("zone_id", "width_m", rings.headland(F.col("ring"), F.col("width_m"), F.lit(5.0)).alias("h")).collect()}
    assert [out[i].h.kind for i in range(5)] == ["applied", "waived", "waived", "applied", "applied"] and out[1].h.reason == "narrow"
    assert [out[i].h.scale for i in (0, 3, 4)] == [pytest.approx(90 * 30 / 4000, rel=1e-4)] * 3 and out[0].width_m == pytest.approx(40, rel=1e-6)
    by = spark.createDataFrame([(shapes[0], [0.0, 10.0, 0.0, 0.0])], f"ring {rings.RING}, by array<double>").select(rings.inset(F.col("ring"), F.col("by")).alias("r")).first().r
    assert max((p.lng + 93) * M_LNG for p in by) == pytest.approx(90, abs=1e-3)
    t = zn.headland_totals(df.filter("zone_id < 2"), F.lit(5.0)).first()
    assert t.waived == 1 and t.sprayed_ha == pytest.approx((4000 * 0.675 + 4000) / 10_000, rel=1e-4)


def test_tour_cost_is_that_of_the_best_ways_round():
    rng = np.random.default_rng(4)
    home = np.array([41.0, -93.0])
    for n in (1, 2, 3, 4):
        corners = home + rng.normal(size=(n, 4, 2)) / 500
        order = list(rng.permutation(n))
        cost, choice = kn.tour_cost(order, corners, home)

        def walk(ways):
            at, total = home, 0.0
            for i, w in zip(order, ways, strict=True):
                total += float(kn.metres(at, corners[i][kn.STARTS[w]]))
                at = corners[i][kn.ENDS[w]]
            return total + float(kn.metres(at, home))

        assert cost == pytest.approx(min(walk(w) for w in itertools.product(range(4), repeat=n))) and walk(choice) == pytest.approx(cost)
    assert kn.tour_cost([], np.zeros((0, 4, 2)), home) == (0.0, [])


def test_service_cost_charges_the_trip_from_where_a_load_runs_out():
    centres, stations = np.array([[41.0, -93.0], [41.01, -93.0], [41.02, -93.0]]), np.array([[41.0, -93.0]])
    spray = np.array([100.0, 100.0, 200.0])
    far = lambda i: float(kn.metres(centres[i], stations[0]))
    assert kn.service_cost([0, 1, 2], spray, centres, stations, (0.4,)) == pytest.approx(2 * far(1))
    assert kn.service_cost([0, 1, 2], spray, centres, stations, (0.25, 0.75, 1.0, 0.0)) == pytest.approx(2 * far(0) + 2 * far(2))
    assert kn.service_cost([0, 1, 2], spray, centres, np.zeros((0, 2)), (0.4,)) == 0


def test_fragment_order_is_no_worse_than_any_single_reversal(spark):
    rng = np.random.default_rng(9)
    home = np.array([41.0, -93.0])
    corners = home + rng.normal(size=(7, 1, 2)) / 300 + rng.normal(size=(7, 4, 2)) / 3000
    order, choice, cost = kn.order_fragments(corners, np.ones(7), corners.mean(axis=1), home, home[None], (0.5,))
    total = lambda o: kn.tour_cost(o, corners, home)[0] + kn.service_cost(o, np.ones(7), corners.mean(axis=1), home[None], (0.5,))
    assert sorted(order) == list(range(7)) and len(choice) == 7 and cost == pytest.approx(total(order))
    assert all(total(order[:i] + order[i : j + 1][::-1] + order[j + 1 :]) >= cost - 1e-6 for i in range(7) for j in range(i + 1, 7))


def slow_order(corners, spray, centres, home, stations, dry_at):
    """Each trial's whole path anew."""
    left, order, here = list(range(len(corners))), [], home
    while left:
        k, o = min(((k, o) for k in left for o in range(4)), key=lambda x: float(kn.metres(here, corners[x[0]][kn.STARTS[x[1]]])))
        here = corners[k][kn.ENDS[o]]
        order.append(k)
        left.remove(k)
    total = lambda x: kn.tour_cost(x, corners, home)[0] + kn.service_cost(x, spray, centres, stations, dry_at)
    cost, better = total(order), True
    for _ in range(12):
        if not better:
            break
        better = False
        for i, j in itertools.combinations(range(len(order)), 2):
            trial = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
            if total(trial) < cost - 1e-6:
                order, cost, better = trial, total(trial), True
    return order, cost


@pytest.mark.parametrize("seed", range(12))
def test_fragment_order_is_that_of_whole_recomputation(seed):
    rng = np.random.default_rng(seed)
    n, home = int(rng.integers(1, 13)), np.array([41.0, -93.0])
    corners = home + rng.normal(size=(n, 1, 2)) / 300 + rng.normal(size=(n, 4, 2)) / 3000
    spray, centres, stations = rng.random(n) * 100, corners.mean(axis=1), home + rng.normal(size=(2, 2)) / 300
    dry = tuple(rng.random(3)) if seed % 3 else ()
    order, choice, cost = kn.order_fragments(corners, spray, centres, home, stations, dry)
    slow, slow_cost = slow_order(corners, spray, centres, home, stations, dry)
    assert order == slow and cost == pytest.approx(slow_cost) and len(choice) == n


def test_many_fragments_are_ordered_in_seconds():
    rng = np.random.default_rng(3)
    home = np.array([41.0, -93.0])
    corners = home + rng.normal(size=(200, 1, 2)) / 300 + rng.normal(size=(200, 4, 2)) / 3000
    began = time.perf_counter()
    order, _, cost = kn.order_fragments(corners, np.ones(200), corners.mean(axis=1), home, home[None], (0.3, 0.6))
    assert time.perf_counter() - began < 30 and sorted(order) == list(range(200))
    assert cost == pytest.approx(kn.tour_cost(order, corners, home)[0] + kn.service_cost(order, np.ones(200), corners.mean(axis=1), home[None], (0.3, 0.6)))


def test_recurrence_and_tours():
    rng = np.random.default_rng(2)
    keep, add = rng.random(777), rng.normal(size=777)
    want, s = [], 0.0
    for k, a in zip(keep, add, strict=True):
        s = k * s + a
        want.append(s)
    assert np.allclose(kn.recurrence(keep, add), want)
    assert kn.order_stops(np.array([[3.0, 0], [1, 0], [2, 0]]), np.zeros(2)) in ([1, 2, 0], [0, 2, 1]) and kn.order_stops(np.zeros((0, 2)), np.zeros(2)) == []


def test_order_statistics_against_sorting(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random() * 1e6, 5.0, -3.0, rng.randint(0, 4) * 1.0])) for k in "abc" for _ in range(400)] + [("d", 7.0), ("e", 1.0), ("e", 2.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r for r in ln.order_statistic(df, ["k"], "x", q10=ln.nearest_rank(0.1), med=ln.upper_median(), p90=ln.floor_rank(0.9)).collect()}
    assert set(got) == set("abcde")
    for k, r in got.items():
        v = sorted(x for key, x in rows if key == k and x is not None)
        n = len(v)
        assert (r.n, r.q10, r.med, r.p90) == (n, v[math.floor(0.1 * (n - 1) + 0.5)], v[n // 2], v[min(math.floor(n * 0.9), n - 1)])


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_nearest_examples_in_any_number_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ln, "EXAMPLES_EACH", block)
    rng = random.Random(3)
    rows = [(i, [rng.randint(0, 3) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    ex = df.filter("id % 3 = 0").withColumn("positive", F.col("id") % 2 == 0)
    for own in (False, True):
        got = {r.id: [(n.d2, n.id) for n in r.near] for r in ln.nearest_examples(df, ex, "v", 3, "id", own).collect()}
        for i, v in rows:
            want = sorted((float(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in rows if j % 3 == 0 and not (own and i == j))[:3]
            assert got[i] == want


def test_find_similar_needs_marks_of_both_kinds(spark):
    rows = [(i, [i % 5, i % 7], i != 3, 1 if i < 3 else 0 if 10 <= i < 13 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<long>, usable boolean, label int")
    got = ln.find_similar(df).collect()
    assert {r.id for r in got} == {i for i in range(30) if i not in (0, 1, 2, 3, 10, 11, 12)} and all(0 <= r.score <= 1 and r.candidate == (r.score >= 0.65) for r in got)
    assert ln.find_similar(df.filter("id <> 1")).count() == 0
    assert ln.ready(df, F.col("label") == 1, F.lit(False)).first().missing == "3 more to leave"


def test_as_of_the_next_and_the_one_not_ended(spark):
    p = spark.createDataFrame([(1, "a", 5.0), (2, "a", 10.0), (3, "a", 99.0), (4, "b", 1.0)], "id int, k string, at double")
    e = spark.createDataFrame([("a", 5.0, 6.0, 1), ("a", 10.0, 12.0, 2)], "k string, s double, e double, n int")
    assert {r.id: r.n for r in ts.first_after(p, e, "k", "at", "s", "n").collect()} == {1: 2, 2: None, 3: None, 4: None}
    assert {r.id: r.n for r in cl.first_not_ended(p, e, "k", "at", "e", "n").collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_selections_never_grow_beyond_a_quarter(spark):
    cells = spark.createDataFrame([(1, c, r, 1, False) for c in range(4) for r in range(4) if (c, r) not in ((1, 1), (2, 1), (1, 2), (2, 2))], "field int, col int, row int, rate int, skip boolean")
    assert sim.regularise(cells, "field", 2, 10.0).filter("added").count() == 0
    hole = spark.createDataFrame([(1, c, r, 1, False) for c in range(5) for r in range(5) if (c, r) != (2, 2)], "field int, col int, row int, rate int, skip boolean")
    assert sim.regularise(hole, "field", 1, 10.0).filter("added").count() == 1


def _run(spark, stream, name, mode):
    # A stream with timers never runs out of batches, so wait for its rows and not for its end.
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    until = time.time() + 60
    while not spark.table(name).count() and time.time() < until:
        time.sleep(0.2)
    q.stop()
    return spark.table(name).collect()


def test_leases_cursors_and_uploads(spark, tmp_path):
    from furrow.streaming import leases

    kind = "task_id long, worker string, at double"
    spark.createDataFrame([(1, "a", 0.0), (1, "b", 60.0), (1, "a", 100.0), (1, "b", 2000.0), (2, "b", 5.0)], kind).coalesce(1).write.parquet(str(tmp_path / "c"))
    got = _run(spark, leases.leases(spark.readStream.schema(kind).parquet(str(tmp_path / "c"))), "leases", "append")
    assert {(r.task_id, r.worker, r.at): r.granted for r in got} == {(1, "a", 0.0): True, (1, "b", 60.0): False, (1, "a", 100.0): True, (1, "b", 2000.0): True, (2, "b", 5.0): True}
    kind = "bake_id long, call int, total int, size int, failed array<int>"
    rows = [(1, 0, 10, 4, []), (1, 1, 10, 4, [6]), (1, 2, 10, 4, [6]), (2, 0, 5, 9, []), (3, 0, 9, 3, [0]), (3, 1, 9, 3, [0]), (3, 2, 9, 3, [0])]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "b"))
    got = _run(spark, leases.bake_cursors(spark.readStream.schema(kind).parquet(str(tmp_path / "b"))), "bakes", "update")
    assert {r.bake_id: (r.cursor, r.stalls, r.done) for r in got} == {1: (6, 1, False), 2: (5, 0, True), 3: (1, 0, False)}
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    tried = spark.createDataFrame([("a", False), ("a", True), ("b", False), *[("c", False)] * 4], "key string, ok boolean")
    assert {r.key: r.tried for r in leases.uploads_left(files, tried).collect()} == {"b": 1, "d": 0}


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from furrow.session import ensure_checkpoint_dir

    empty = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)), getConf=lambda: {})
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
