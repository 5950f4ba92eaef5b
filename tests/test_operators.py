import numpy as np
import pandas as pd
import plane
import pytest
from pyspark.sql import functions as F

from furrow.functions import bands, filters, flight, geo, kernels, rules, text, units
from furrow.operators import learning, outlines, paths, reporting, simulation, spatial, timeseries
from furrow.operators.graph import connected_components
from furrow.sources import binary, semistructured, sinks
from furrow.streaming import pipeline, windows


def hours(spark, rows):
    cols = "site_id string, idx int, time timestamp, temp_c double, humidity double, wind_kmh double, gust_kmh double, precip_mm double"
    t0 = pd.Timestamp("2026-08-20 06:00:00")
    data = [("a", i, (t0 + pd.Timedelta(hours=i)).to_pydatetime(), 20.0, 55.0, r.get("wind", 8.0), 12.0, r.get("rain", 0.0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, cols)


def test_windows_need_two_hours_and_end_at_the_horizon(spark):
    rows = [{}, {}, {"wind": 20.0}, {}, {"wind": 20.0}, {}, {}]
    w = timeseries.spray_windows(timeseries.judge_hours(hours(spark, rows))).orderBy("start_ts").collect()
    assert [r.hours for r in w] == [2, 2]


def test_rain_ahead_blocks_hours_before_it(spark):
    rows = [{} for _ in range(10)] + [{"rain": 1.0}]
    got = [r.verdict for r in timeseries.judge_hours(hours(spark, rows)).orderBy("idx").collect()]
    assert got == ["green"] * 5 + ["red"] * 6


def test_reasons_lead_with_what_decided(spark):
    one = spark.createDataFrame([(30.0, 30.0, 0.0, 5.0, 10.0), (14.0, 10.0, 0.0, 20.0, 50.0)], "w double, g double, r double, t double, h double")
    got = [[(x.kind, x.limit) for x in r[0]] for r in one.select(rules.spray_reasons(*map(F.col, "wgrth"))).collect()]
    assert got == [[("wind", 16.0), ("gust", 24.0), ("cold", 10.0)], [("wind", 16.0)]]


@pytest.mark.parametrize("n", [1, 2, 17, 64])
def test_components_of_a_chain(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 3.0), (3, "z", 9.0)], "id int, s string, v double")
    got = [r.id for r in df.filter(filters.parse_filter("s.in.(x),and(s.eq.y,v.lt.5)")).orderBy("id").collect()]
    assert got == [1, 2]
    with pytest.raises(ValueError):
        filters.parse_filter("s.like.x")
    assert filters.owned_by(df, None, "id").count() == 0


def test_latest_page_and_merge(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (2, 3, 1)], "k int, id int, t int")
    assert {r.id for r in reporting.latest_per_key(df, "k", F.col("t").desc()).collect()} == {2, 3}
    i = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 10), (1, 1, 2)], "k int, s int, e int")
    assert sorted((r.s, r.e, r.n) for r in paths.merge_intervals(i, "k", "s", "e").collect()) == [(0, 8, 3), (9, 10, 1)]


def test_order_statistics_match_sorted_lists(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(x)) for k, x in zip(rng.integers(0, 4, 300), rng.integers(0, 20, 300), strict=True)]
    q = learning.order_statistic(spark.createDataFrame(rows, "k int, x int"), ["k"], "x", p=learning.floor_rank(0.9), m=learning.upper_median())
    for r in q.collect():
        v = sorted(x for k, x in rows if k == r.k)
        assert (r.p, r.m) == (v[min(int(len(v) * 0.9), len(v) - 1)], v[len(v) // 2])


def test_knn_in_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(0, 9, 4)], bool(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<bigint>, positive boolean")
    near = lambda: sorted((r.id, [x.id for x in r.near]) for r in learning.nearest_examples(df.drop("positive"), df, "v", 3, "id", True).collect())
    whole = near()
    monkeypatch.setattr(learning, "EXAMPLES_EACH", 8)
    assert near() == whole


def test_point_in_ring_and_nearest(spark):
    ring = [{"lat": 0.0, "lng": 0.0}, {"lat": 0.0, "lng": 4.0}, {"lat": 4.0, "lng": 4.0}, {"lat": 4.0, "lng": 0.0}]
    rings = spark.createDataFrame([(1, ring)], "ring_id int, ring array<struct<lat double, lng double>>")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0), (3, 3.9, 0.1)], "id int, lat double, lng double")
    assert {r.id for r in spatial.points_in_rings(pts, rings).collect()} == {1, 3}
    sites = spark.createDataFrame([(7, 2.0, 2.001), (8, 2.0, 2.002)], "site_id int, lat double, lng double")
    assert [(r.id, r.site_id) for r in spatial.nearest_within(pts, sites, 500.0).collect()] == [(1, 7)]


def test_outline_of_a_zone_with_a_hole(spark):
    cells = [(1, c, r) for c in range(3) for r in range(3) if (c, r) != (1, 1)]
    loops = outlines.outlines(spark.createDataFrame(cells, "z int, col int, row int"), "z").collect()
    assert sorted(x.area for x in loops) == [-1.0, 9.0]
    assert sorted(len(x.points) for x in loops) == [4, 4]


def test_regularise_keeps_marks_and_skips(spark):
    cells = [(1, c, r, 5.0, False) for c in range(4) for r in range(4) if (c, r) not in ((1, 1), (2, 2))] + [(1, 2, 2, 0.0, True)]
    df = spark.createDataFrame(cells, "field int, col int, row int, rate double, skip boolean")
    got = {(r.col, r.row): r.added for r in simulation.regularise(df, "field").collect()}
    assert got[(1, 1)] and (2, 2) not in got and len(got) == 15
    assert simulation.regularise(df, "field", 0).count() == 14


def test_kernels():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert abs(kernels.signed_area(plane.clip_convex(square, square + 2))) == 4
    assert kernels.signed_area(plane.inset(square, np.ones(4))) == 4
    assert plane.headland(square, np.full(4, 2.0))[0] == "waived"
    assert plane.headland(square, np.full(4, 0.5))[2] == pytest.approx(9 / 16)
    assert kernels.least_width(np.array([[0, 0], [10, 0], [10, 2], [0, 2]], float)) == pytest.approx(2)
    assert plane.ring_gap(square, square + [6, 0]) == pytest.approx(2)
    assert plane.ring_gap(square, square + 1) == 0
    assert sorted(kernels.order_stops(np.random.default_rng(0).random((9, 2)), np.zeros(2))) == list(range(9))
    free = np.ones((3, 3), bool)
    free[1, :2] = False
    assert plane.shortest_path(free, (0, 0), (2, 0))[0] == (0, 0) and len(plane.shortest_path(free, (0, 0), (2, 0))) == 5
    u = np.array([[0, 0], [6, 0], [6, 6], [5, 6], [5, 1], [1, 1], [1, 6], [0, 6]], float)
    assert plane.inside(plane.interior_point(u)[None, :], u)[0]


def test_tank_profile_empties_over_the_spray_legs():
    seg = pd.DataFrame({"t_start": [0.0, 10.0], "t_end": [10.0, 30.0], "speed": [0.0, 5.0], "spray": [False, True]})
    p = pd.DataFrame(dict(zip(simulation.FIELDS, simulation.tank_profile(*(seg[c].to_numpy() for c in ("t_start", "t_end", "speed", "spray")), 20.0), strict=True)))
    assert p.litres.iloc[0] == 20.0 and p.litres.iloc[-1] == pytest.approx(0, abs=0.3)
    assert (p.amp_s.diff().dropna() > 0).all() and p.slosh_cm.abs().max() > 0


def test_too_large_lattice_is_refused(spark):
    f = spark.createDataFrame([(1, [[0.0, 0.0], [1000.0, 0.0], [1000.0, 1000.0]])], "f int, ring array<array<double>>")
    with pytest.raises(Exception, match="too many cells"):
        simulation.lattice(f, "f", 1.0).count()


def test_binary_round_trips(spark, tmp_path):
    v = np.random.default_rng(3).random((5, 7)).astype(np.float32)
    v[0, 0] = -1
    raw = binary.write_geotiff(v, 10.0, 50.0, 0.001, 0.002, -1)
    back, ref = binary.read_geotiff(raw)
    assert np.array_equal(back, v) and ref["no_data"] == -1 and ref["south"] == pytest.approx(49.99)
    (tmp_path / "a.tif").write_bytes(raw)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert binary.raster_rows(files).count() == 34
    assert binary.world_file(10, 50, 0.5, 0.5).splitlines()[4] == "10.250000000000"
    ring = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    shp, _, dbf = binary.write_shapefile([ring], [{"name": "x", "rate": 2.5}])
    assert abs(kernels.signed_area(binary.read_shapefile(shp)[0][:-1])) == 12 and binary.read_dbf(dbf) == [{"name": "x", "rate": "2.500000"}]


def test_semistructured(spark):
    df = spark.createDataFrame([('{"a": {"b": 2.5}, "n": "x"}',), ("broken",), (None,)], "j string")
    got = [tuple(r[0]) for r in df.select(semistructured.settings(F.col("j"), {"a.b": 1.0, "n": "d", "k": 3})).collect()]
    assert got == [(2.5, "x", 3), (1.0, "d", 3), (1.0, "d", 3)]
    define = '"definition": {"swathM": 6, "cellMultiple": 1, "headingRad": 0.5, "origin": {"lat": 1, "lng": 2}, "boundaryHash": "h"}'
    rates = '"rates": {"a": {"state": "treated", "source": "operator", "rateLha": 5, "issue": " ", "note": " x "}, "b": {"state": "odd", "source": "operator"}, "c": {"state": "treated", "source": "default", "rateLha": 0}, "d": 7, "e": {"state": "untreated", "source": "threshold", "note": "n"}}'
    found = '"detection": {"modelVersion": "m", "scoredAt": "t", "cellIds": ["a"], "scores": [1%s]}'
    grids = ["{" + ", ".join(x) + "}" for x in ((define, rates, found % ""), (define, rates, found % ", 2"), (rates,), (define,))] + ["broken", None]
    g = [r.g for r in spark.createDataFrame([(x,) for x in grids], "j string").select(semistructured.stored_grid(F.col("j")).alias("g")).collect()]
    assert {k: tuple(v) for k, v in g[0].rates.items()} == {"a": ("treated", "operator", 5.0, None, "x"), "e": ("untreated", "threshold", None, None, None)}
    assert g[0].detection.scores == [1.0] and g[1].detection is None and g[0].definition.boundary_hash == "h"
    assert g[2] is None and g[3].rates == {} and g[4] is None and g[5] is None
    b = spark.createDataFrame([('[{"lat":1,"lng":2},{"lat":1,"lng":3}]',), ('[[{"lat":1,"lng":2}],[{"lat":1,"lng":2},{"lat":2,"lng":2},{"lat":3,"lng":3}]]',)], "j string")
    assert [len(r[0]) for r in b.select(semistructured.boundary(F.col("j"))).collect()] == [1, 1]
    feed = '{"hourly": [{"dt": 5, "temp": 20.5, "wind_speed": 1.0, "rain": {"1h": 0.1}, "snow": {"1h": 0.3}, "pop": 0.125, "weather": [{"id": 500, "icon": "10d", "description": "r"}]}, {"dt": 6}], "daily": [{"dt": 9, "temp": {"min": 1, "max": 2}, "rain": 4}]}'
    f = spark.createDataFrame([(feed,), ("{}",)], "j string").select(semistructured.forecast(F.col("j")).alias("f")).collect()
    h = f[0].f.hourly
    assert [(x.time, x.temp_c, x.wind_kmh, round(x.precip_mm, 6), x.precip_prob, x.code, x.icon) for x in h] == [(5, 20.5, 3.6, 0.4, 13.0, 500, "10d"), (6, None, 0.0, 0.0, 0.0, 800, "01d")]
    assert (f[0].f.daily[0].tmax_c, f[0].f.daily[0].precip_mm) == (2.0, 4.0) and f[1].f.hourly == []
    spare = '{"hourly": {"time": ["1970-01-01T00:01", "1970-01-01T01:00"], "temperature_2m": [3.0], "wind_speed_10m": [7.0, 8.0], "weather_code": [2]}, "daily": {"time": ["1970-01-02"], "precipitation_sum": [1.5]}}'
    f = spark.createDataFrame([(spare,)], "j string").select(semistructured.forecast_spare(F.col("j")).alias("f")).first().f
    assert [(x.time, x.temp_c, x.wind_kmh, x.precip_mm, x.desc) for x in f.hourly] == [(60, 3.0, 7.0, 0.0, "mainly clear"), (3600, None, 8.0, 0.0, "clear sky")]
    assert [(d.time, d.precip_mm, d.humidity) for d in f.daily] == [(86400, 1.5, None)]
    many = '{"hourly": {"time": [' + ", ".join(['"1970-01-01"'] * 60) + "]}}"
    assert len(spark.createDataFrame([(many,)], "j string").select(semistructured.forecast_spare(F.col("j")).alias("f")).first().f.hourly) == 48


def test_analysis_zones(spark):
    zones = [
        '{"issue": "Row gap", "confidence": "high", "polygon": [[1,11],[11.5,1.5],[0.5,0.5]], "recommendation": "r"}',  # second vertex swapped, third as shares
        '{"issue": "Row gap", "confidence": "medium", "tier": 2, "recommendation": "r"}',
        '{"issue": "Row gap", "confidence": "LOW", "tier": 2}',
        '{"issue": "Other", "confidence": "HIGH", "tier": 2}',
        '{"issue": "Row gap", "confidence": "HIGH", "tier": 1, "polygon": [[1,11]]}',
        '{"issue": "Row gap", "confidence": "HIGH", "polygon": [[1.9,11.9],[1.9,11.8],[1.8,11.9]]}',  # outside of the ring below
    ]
    box = F.struct(F.lit(2.0).alias("north"), F.lit(1.0).alias("south"), F.lit(12.0).alias("east"), F.lit(11.0).alias("west"))
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((1.0, 11.0), (1.7, 11.0), (1.7, 11.7), (1.0, 11.7))])
    df = spark.createDataFrame([('{"zones": [' + ", ".join(zones) + "]}",), ("no json",), (None,)], "j string")
    got = [r[0] for r in df.select(semistructured.analysis_zones(F.col("j"), box, F.array(ring))).collect()]
    assert [(z.id, z.tier, z.recommendation, len(z.ring)) for z in got[0]] == [("ai-0", 1, "r", 3), ("ai-1", 2, None, 0)]
    assert [tuple(v) for v in got[0][0].ring] == [(1.0, 11.0), (1.5, 11.5), (1.5, 11.5)] and got[1] == [] and got[2] == []
    rate = F.struct(F.col("s").alias("state"), F.lit("operator").alias("source"), F.lit("i").alias("issue"), F.lit("n").alias("note"))
    cells = spark.createDataFrame([("treated", " j ", True, None, False), ("treated", " ", True, None, True), ("untreated", "j", True, "k", True)], "s string, i string, hi boolean, n string, hn boolean")
    p = cells.select(semistructured.classify_cell(rate, F.col("i"), F.col("hi"), F.col("n"), F.col("hn"))).collect()
    assert [tuple(r[0])[2:] for r in p] == [("j", "n"), (None, None), ("i", "n")]


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        text.fnv1a(F.lit("abc")), text.base36(F.lit(35)), text.normalise_note(F.lit("   ")), text.compass(F.lit(-10.0)), text.compass(F.lit(350.0)),
        text.currency(F.lit("eur")), geo.ring_wkt(F.array().cast("array<struct<lat:double,lng:double>>")), units.half_up(F.lit(-2.5)), text.escape_markup(F.lit("<&")),
    ).first()
    assert list(got) == [440920331, "z", None, "N", "N", "USD", None, -2, "&lt;&amp;"]
    assert bands.band_roles(["", "", "", ""], ["red", "green", "blue", "alpha"]) == {"red": 1, "green": 2, "blue": 3}
    assert bands.available(bands.band_roles([""] * 5, ["undefined"] * 5)) == ["NDVI", "NDRE", "VARI"]


def test_bands():
    grey = ["gray", "undefined", "undefined", "undefined"]
    assert bands.analyse(["red edge", "NIR", "Red", "green"], grey).roles == {"rededge": 1, "nir": 2, "red": 3, "green": 4}
    spare = bands.analyse(["", "", "", ""], ["red", "green", "blue", "undefined"])
    assert (spare.roles["nir"], spare.method, bands.preview(spare)) == (4, "convention", (1, 2, 3))
    pair = bands.analyse(["b1", "band 2"], ["gray", "undefined", "alpha"], 3)
    assert (pair.roles, pair.method, pair.spectral) == ({"red": 1, "nir": 2}, "profile", 2) and bands.preview(pair) is None
    open4 = bands.analyse([""] * 4, grey)
    assert (open4.roles, open4.method, open4.ambiguous) == ({}, "unresolved", True)
    assert bands.analyse([""] * 4, grey, camera="M3M").roles["rededge"] == 3
    assert bands.analyse(["thermal"] * 5, ["undefined"] * 5).roles == {}  # labelled otherwise: no layout
    assert bands.choose(open4) == ("VARI", {"red": 1, "green": 2, "blue": 3}) and bands.choose(pair, "NDRE")[0] == "NDVI"
    assert [r is None for _, r in bands.options(spare)] == [True, False, True]
    assert "extra bands" in bands.options(open4)[0][1] and "ordinary RGB" in bands.options(bands.analyse([], ["red", "green", "blue"]))[1][1]
    assert all("Still checking" in r for _, r in bands.options(None))


def test_filters_and_paint(spark):
    rows = [("completed", True, "u"), ("completed", True, ""), ("running", True, "u"), (None, None, "u"), ("completed", False, "u")]
    df = spark.createDataFrame(rows, "s string, t boolean, u string")
    c = [F.col(x) for x in "stu"]
    got = [tuple(r) for r in df.select(filters.comparable(*c), filters.why_not_comparable(*c)).collect()]
    assert got[0] == (True, None) and [g[1] for g in got[1:4]] == ["This scan has no orthomosaic.", "This scan is still running.", "This scan is still null."]
    assert got[4][1].endswith("baking yet.")
    form = spark.createDataFrame([(" a ", "x@y.z", "pilot", ""), (None, "bad", "else", "no"), ("n" * 9, "", "", "yes")], "name string, email string, role string, survey string")
    e = filters.form_errors({"name": "Your name"}, {"role": ("Your role", ["pilot"], True), "survey": ("Survey", ["yes"], False)}, {"name": 5})
    assert [r[0] for r in form.select(e).collect()] == [
        {},
        {"name": "Your name is required", "email": "That doesn't look like an email address", "role": "Pick one of the listed options", "survey": "Pick one of the listed options"},
        {"name": "Keep this under 5 characters", "email": "Email is required", "role": "Your role is required"},
    ]
    assert [r[0] for r in form.select(filters.may_insert({"name": 8}, {"survey": 2})).collect()] == [True, False, False]
    cells = spark.createDataFrame([("treated", "operator", 10.0), ("treated", "threshold", 20.0), ("untreated", "default", None), ("untreated", "operator", None)], "s string, o string, r double")
    p = [tuple(r[0]) for r in cells.select(text.cell_paint(F.col("s"), F.col("o"), F.col("r"), F.lit(10.0), F.lit(20.0))).collect()]
    assert p == [("treated", "rgba(250,204,61,0.300)", "rgba(250,204,61,0.95)"), ("treated", "rgba(250,54,21,0.650)", "rgba(250,54,21,0.55)"), ("undecided", None, None), ("skipped", None, None)]
    shown = spark.createDataFrame([(0, 0.0), (2, 0.5), (3, 5.0), (90, 500.0)], "c int, v double").select(text.weather_text(F.col("c")), text.weather_icon(F.col("c")), units.decimals(F.col("v")))
    assert [tuple(r) for r in shown.collect()] == [("clear sky", "01d", 0), ("mainly clear", "02d", 3), ("overcast", "04d", 2), ("thunderstorm", "11d", 1)]


def test_pipeline_state():
    assert pipeline.next_status("completed", 30) == "completed" and pipeline.next_status(None, 20) == "running"
    assert pipeline.claim("x", 0.0, "me", 100.0) == ("x", 0.0, False)
    assert pipeline.claim("x", 0.0, "me", 1000.0)[2] and pipeline.claim("x", None, "me", 1.0)[2]
    assert pipeline.after_attempt(3, False) == (4, "failed") and pipeline.after_attempt(2, True) == (0, "done")
    assert pipeline.advance_cursor(0, 10, 5, [], 0) == (5, 0, False)
    assert pipeline.advance_cursor(0, 10, 5, [3], 0) == (3, 0, False)
    assert pipeline.advance_cursor(3, 10, 5, [3], 2) == (4, 0, False)
    assert pipeline.advance_cursor(5, 10, 5, [], 0) == (10, 0, True)
    codes = iter([503, 503, 200])
    assert pipeline.with_retry(lambda: next(codes), sleep=lambda _: None) == 200


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(1, 20, "2026-01-01 00:00:00"), (1, 40, "2026-01-01 01:00:00"), (2, 30, "2026-01-01 00:00:00")], "scan_id long, code int, t string")
    ev.select("scan_id", "code", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("scan_id long, code int, ts timestamp").parquet(str(tmp_path / "e"))
    q = pipeline.scan_status(stream).writeStream.outputMode("update").format("memory").queryName("scans").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.scan_id, r.status, r.attempts) for r in spark.table("scans").collect()} == {(1, "completed", 0), (2, "queued", 1)}
    batch = hours(spark, [{}, {}, {"wind": 30.0}, {}]).withColumn("rain_next", F.col("precip_mm"))
    batch.write.parquet(str(tmp_path / "h"))
    live = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "h"))
    q = windows.green_sessions(live).writeStream.outputMode("complete").format("memory").queryName("green").start()
    q.processAllAvailable()
    q.stop()
    whole = sorted((r.start_ts, r.hours) for r in windows.green_sessions(batch).collect())
    assert sorted((r.start_ts, r.hours) for r in spark.table("green").collect()) == whole and sum(h for _, h in whole) == 3


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r.id for r in sinks.delete_by_key(old, new, "id").collect()] == [1]


def test_mission_rows_and_small_readers(spark, tmp_path):
    m = 1 / 111_320  # a metre in degrees of latitude
    legs = [(0, 5, True), (5.2, 9, True), (9, 12, False), (20, 25, True)]
    p = spark.createDataFrame([(1, i, a * m, 0.0, b * m, 0.0, s) for i, (a, b, s) in enumerate(legs)], "m int, o int, lat1 double, lng1 double, lat2 double, lng2 double, spray boolean")
    rows = paths.mission_rows(p, "m", "o", (0.0, 0.0))
    short = {"ALTITUDE_CHANGE": "alt", "SPEED_CHANGE": "speed"}
    got = [short.get(r.action, r.action) for r in rows.orderBy("seq").collect()]
    start, climb = ["alt", "speed", "SPRAY_ON", "SPRAY_WP"], ["alt", "speed", "TRANSIT"]
    assert got == ["TAKEOFF", *start, "SPRAY_WP", "SPRAY_OFF", *climb, *climb, *start, "SPRAY_OFF", "alt", "RTH", "LAND"]
    kept = paths.reduce_waypoints(rows, "m").orderBy("seq").collect()
    assert [(round(r.lat / m, 3), r.alt) for r in kept] == [(5, 3), (9, 3), (12, 15), (20, 15), (25, 3), (0, 15)]
    twice = rows.withColumn("action", F.lit("TRANSIT")).withColumn("alt", F.lit(1.0))
    assert [round(r.lat / m, 3) for r in paths.reduce_waypoints(twice, "m").orderBy("seq").collect()] == [0, 5, 9, 12, 20, 25, 0]
    lines = [r.line for r in sinks.waypoint_text(rows, "m").orderBy("line_no").collect()]
    assert lines[0] == "QGC WPL 110" and lines[1].startswith("0\t1\t0\t16\t0.00") and len(lines) == len(got) + 2
    assert lines[2].split("\t")[:4] == ["1", "0", "3", "22"] and lines[5] == "4\t0\t3\t183\t8.00\t2000.00\t0.00\t0.00\t0.00000000\t0.00000000\t0.00\t1"
    assert lines[4] == "3\t0\t3\t178\t1.00\t5.00\t-1.00\t0.00\t0.00000000\t0.00000000\t0.00\t1"
    tiff = b"II*\0\x08\0\0\0\x01\0\x25\x88\x04\0\x01\0\0\0\0\0\0\0"
    exif = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xd9"
    assert binary.has_gps(jpeg) and not binary.has_gps(jpeg.replace(b"\x25\x88", b"\x26\x88")) and not binary.has_gps(b"")
    (tmp_path / "a.tif").write_bytes(b"x")
    (tmp_path / "a.tif.old").write_bytes(b"x")
    assert binary.list_objects(spark, str(tmp_path), "a.tif").count() == 1
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in ((1.0, 2.0), (3.0, 2.0), (3.0, 5.0))])
    r = spark.range(1).select(geo.footprint(ring).alias("f"), geo.geojson(ring).alias("j")).first()
    assert tuple(r.f) == (1.0, 2.0, 3.0, 5.0) and r.j.count("[2.0,1.0]") == 2


def test_refills(spark):
    df = spark.createDataFrame([(70.0, 40.0, 80.0), (0.0, 40.0, 50.0), (10.0, 40.0, 0.0), (32.0, 40.0, 150.0)], "need double, tank double, load double")
    got = [tuple(r[0]) for r in df.select(flight.refills(F.col("need"), F.col("tank"), F.col("load"))).collect()]
    assert got[0] == (32.0, 3, 2, [32 / 70, 64 / 70], 26.0)
    assert got[1:] == [(20.0, 1, 0, [], 20.0), (0.0, 0, 0, [], 0.0), (40.0, 1, 0, [], 8.0)]
    legs = spark.range(1).select(flight.empty_at(F.array(F.lit(0.25), F.lit(0.5), F.lit(1.0)), F.array(F.lit(10.0), F.lit(30.0))))
    assert legs.first()[0] == [0, 1, 1]


def test_conditions_fall_back(spark):
    day = 86_400
    m = spark.createDataFrame([(1, "a", 1800), (2, "a", 5401), (3, "a", 5 * day), (4, "b", 0)], "m int, site_id string, at long")
    hourly = spark.createDataFrame([("a", 0, 0, 20.0, 3.6, "h0"), ("a", 1, 3600, 21.0, None, "h1")], "site_id string, idx int, time long, temp_c double, wind_kmh double, desc string")
    daily = spark.createDataFrame([("a", 0, 10.0, 20.0, 7.2, "d0")], "site_id string, time long, tmin_c double, tmax_c double, wind_kmh double, desc string")
    now = spark.createDataFrame([("a", 5.0, 36.0, "now")], "site_id string, temp_c double, wind_kmh double, desc string")
    got = sorted(tuple(r)[0:1] + tuple(r)[3:] for r in timeseries.conditions_at(m, hourly, daily, now).collect())
    assert got == [(1, "forecast", True, 1.0, 20.0, "h0"), (2, "forecast", True, 2.0, 15.0, "d0"), (3, "current", False, 10.0, 5.0, "now"), (4, "none", False, None, None, None)]


def test_flight_physics_is_the_step_by_step_sum(spark):
    cases = [(600.0, 400.0, 20.0, 1.2, 4.0, 3), (660.0, 0.0, 50.0, 1.0, -2.0, 0), (0.0, 0.0, 10.0, 1.2, 0.0, 0), (300.0, 300.0, 40.0, 0.2, 30.0, 9)]
    df = spark.createDataFrame(cases, "t double, s double, l double, rho double, h double, n int")
    got = [r[0] for r in df.select(simulation.integrate_flight(*[F.col(c) for c in ("t", "s", "l", "rho", "h", "n")])).collect()]
    c = simulation.Craft()
    for (total, spray, litres, rho, head, turns), g in zip(cases, got, strict=True):
        start, dt, done, slosh, amp_s, cogs, amps = min(litres, c.tank_l), total / 240, 0.0, 0.0, 0.0, [0.0], [0.0]
        for i in range(240):
            done += dt if total and i / 240 < spray / total else 0.0
            left = max(0.0, start - (start / spray if spray else 0.0) * done)
            fill = left / c.tank_l
            pitch = np.clip(np.degrees(np.arctan2(head * 0.15, 9.80665)), -c.max_pitch_deg, c.max_pitch_deg)
            a = 1 - np.exp(-dt / max(0.15, c.slosh_tau_s * (0.35 + 0.65 * fill)))
            slosh = slosh + (pitch / c.max_pitch_deg * fill * c.slosh_max_cm - slosh) * a if fill > 1e-12 else 0.0
            cogs.append((fill - 1) * c.static_offset_cm + slosh)
            amps.append(((c.dry_kg + left) * 9.80665) ** 1.5 / np.sqrt(2 * max(rho, 0.3) * c.rotor_m2) / c.efficiency / c.voltage + c.amp_per_cm * abs(cogs[-1]))
            amp_s += amps[-1] * dt
        mean = amp_s / total if total else 0.0
        turning = turns * (6 / 2.5 * 2 + c.pivot_s)
        want = (mean, max(amps), max(cogs, key=abs), c.dry_kg + left, 24.0, (total + turning) / 60, max(1, np.ceil((amp_s + turning * mean * 1.15) / 3600 / 24)))
        assert tuple(g) == pytest.approx(want, abs=1e-6)
