"""Catalogue: guards, texts, colours, feeds and missions over the tables as rows of the right shape."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from furrow.functions import bands, filters, geo
from furrow.functions import text as tx
from furrow.operators import paths
from furrow.operators import simulation as sim
from furrow.session import dealt, table
from furrow.sources import semistructured as ss
from furrow.sources import sinks


def cell_colours(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type").isin("click", "view"), "treated").otherwise(F.lit("untreated"))
    source = F.when(F.col("event_id") % 3 == 0, "operator").when(F.col("event_id") % 3 == 1, "default").otherwise(F.lit("threshold"))
    return e.select("event_id", tx.cell_paint(state, source, F.col("event_id") % 9, F.lit(0), F.lit(8)).alias("p")).select("event_id", "p.*")


def scan_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    tiles, uuid = F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 > 1, "u")
    return e.select("event_id", filters.comparable(status, tiles, uuid).alias("ok"), filters.why_not_comparable(status, tiles, uuid).alias("reason"))


def form_check(spark, sf_dir):
    """What a form says of each customer's answers."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 > 0, F.col("c_name")).otherwise("  ").alias("full_name"), F.when(k % 3 == 0, "a@b.co").when(k % 3 == 1, "a b@c.d").alias("email"), F.col("c_mktsegment").alias("role"))
    e = filters.form_errors({"full_name": "Your name"}, {"role": ("Your role", ["BUILDING", "MACHINERY"], True)}, {"role": 9})
    at = c.select("c_custkey", e.alias("e"))
    return at.select("c_custkey", *[F.element_at("e", f).alias(f) for f in ("full_name", "email", "role")])


def insert_guard(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.col("c_mktsegment"), F.lit("@x.y"))).alias("email"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("notes"))
    return c.select("c_custkey", filters.may_insert({"c_name": 120}, {"notes": 9}).alias("ok"))


def tile_corners(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    lat, lng = geo.tile_corner(F.col("s_suppkey") % 1024, F.col("s_nationkey") * 37, 10)
    return s.select("s_suppkey", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"), F.round(geo.metres_per_pixel(lat, 10), 6).alias("mpp"))


def ring_texts(spark, sf_dir):
    """Outline, GeoJSON and box of a triangle a supplier; too few points give no outline."""
    s = table(spark, sf_dir, "supplier")
    a, b = F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 90).cast("double")
    p = lambda x, y: F.struct(x.alias("lat"), y.alias("lng"))
    full = F.array(p(a, b), p(a, b + 1), p(a + 2, b))
    ring = F.when(F.col("s_suppkey") % 4 == 0, F.slice(full, 1, 2)).otherwise(full)
    return s.select("s_suppkey", geo.ring_wkt(ring, 4326).alias("wkt"), geo.geojson(full).alias("geojson"), geo.footprint(full).alias("f")).select("s_suppkey", "wkt", "geojson", "f.*")


def forecast_rows(spark, sf_dir):
    """A feed of one hour an event, read back into normal form."""
    v = F.col("value").cast("string")
    sky = F.when(F.col("event_id") % 2 == 0, ', "weather": [{"id": 500, "icon": "10d", "description": "rain"}]').otherwise("")
    raw = F.concat(F.lit('{"hourly": [{"dt": '), F.col("event_id").cast("string"), F.lit(', "temp": 20, "wind_speed": '), v, F.lit(', "rain": {"1h": '), v, F.lit("}"), sky, F.lit("}]}"))
    return table(spark, sf_dir, "events").select(F.inline(ss.forecast(raw)["hourly"])).select("time", "temp_c", "humidity", "wind_kmh", "gust_kmh", "precip_mm", "code", "desc")


def stored_rates(spark, sf_dir):
    """Rates of one stored grid a user event, malformed ones dropped."""
    k = F.col("event_id")
    rate = F.concat(F.lit('{"state": "'), F.when(k % 4 == 0, "untreated").when(k % 4 == 1, "odd").otherwise("treated"), F.lit('", "source": "'), F.when(k % 3 == 0, "default").otherwise("operator"), F.lit('", "rateLha": '), (k % 5).cast("string"), F.lit(', "note": "  n "}'))
    raw = F.concat(F.lit('{"definition": {"swathM": 6, "cellMultiple": 1, "headingRad": 0, "origin": {"lat": 1, "lng": 2}, "boundaryHash": "h"}, "rates": {"c'), k.cast("string"), F.lit('": '), rate, F.lit("}}"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(ss.stored_grid(raw)["rates"]).alias("cell_id", "r")).select("event_id", "cell_id", "r.*")


def shown_zones(spark, sf_dir):
    """Zones of an analysis answer an event: allowed issues of enough confidence, by tier."""
    k = F.col("event_id")
    raw = F.concat(F.lit('{"zones": [{"issue": "'), F.when(k % 3 == 0, "Row gap").when(k % 3 == 1, "Bare soil").otherwise("Moon"), F.lit('", "confidence": "'), F.when(k % 4 == 0, "high").when(k % 4 == 1, "LOW").otherwise("Medium"), F.lit('", "recommendation": "r"'), F.when(k % 5 == 0, ', "tier": 1').otherwise(""), F.lit("}]}"))
    box = F.struct(*[F.lit(float(x)).alias(n) for x, n in ((2, "north"), (1, "south"), (2, "east"), (1, "west"))])
    rings = F.array().cast("array<array<struct<lat:double,lng:double>>>")
    return table(spark, sf_dir, "events").select("event_id", F.inline(ss.analysis_zones(raw, box, rings))).select("event_id", "id", "name", "issue", "confidence", "tier", "recommendation")


def classify_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rate = F.struct(F.when(F.col("o_orderstatus") == "F", "treated").otherwise(F.lit("untreated")).alias("state"), F.lit("operator").alias("source"), F.col("o_orderpriority").alias("issue"), F.lit("old").alias("note"))
    done = ss.classify_cell(rate, F.when(k % 3 == 0, " new "), k % 2 == 0, F.when(k % 5 == 0, "  "), k % 7 < 3)
    return o.select("o_orderkey", done.alias("r")).select("o_orderkey", "r.*")


def band_index(spark, sf_dir):
    """Indices of four bands that only colours and one spare band tell apart."""
    b = bands.analyse([""] * 4, ["red", "green", "blue", "undefined"])
    band = lambda i: (F.col("p_partkey") * (2 * i + 1) % 251).cast("double")
    ndvi, vari = (bands.expression(n, b.roles, band) for n in ("NDVI", "VARI"))
    return table(spark, sf_dir, "part").select("p_partkey", ndvi.alias("ndvi"), vari.alias("vari"), bands.zone_value(bands.from_grey(band(1))).alias("shown"))


def _missions(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", "o_orderkey", (k % 3 / 100).alias("lat1"), F.lit(0.0).alias("lng1"), (k % 4 / 100).alias("lat2"), F.lit(0.0).alias("lng2"), (k % 5 < 3).alias("spray"))
    return paths.mission_rows(rows, "o_custkey", "o_orderkey", (0.0, 0.0))


def mission_actions(spark, sf_dir):
    """Actions of each customer's orders flown as passes, counted."""
    return _missions(spark, sf_dir).groupBy("o_custkey", "action").agg(F.count("*").alias("n"))


def mission_text(spark, sf_dir):
    """Waypoint lines of events as a flight a user."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "SPRAY_ON").when(F.col("event_type") == "error", "SPEED_CHANGE").when(F.col("event_type") == "signup", "RTH").otherwise("TRANSIT")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = e.select("user_id", seq.alias("seq"), action.alias("action"), (F.col("event_id") % 90).cast("double").alias("lat"), F.lit(7.5).alias("lng"), F.lit(15.0).alias("alt"), F.lit(5.0).alias("speed"))
    return sinks.waypoint_text(rows, "user_id")


def flight_physics(spark, sf_dir):
    """A flight a supplier, summed up in 240 steps."""
    k = F.col("s_suppkey")
    f = sim.integrate_flight(k % 7 * 60 + 60.0, k % 5 * 30.0, k % 50 + 0.0, 0.9 + k % 4 / 10, k % 11 - 5.0, k % 6)
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", f.alias("f"))
    return s.select("s_suppkey", *[F.round(f"f.{n}", 6).alias(n) for n in ("mean_amps", "peak_amps", "end_kg", "minutes")], "f.batteries")


def upsert_rows(spark, sf_dir):
    """Customers with some replaced and some added, then some deleted."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    changes = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.upper("c_name").alias("c_name"))
    return sinks.delete_by_key(sinks.upsert(c, changes, "c_custkey"), c.filter("c_custkey % 7 = 0"), "c_custkey")


def fresh_rows(spark, sf_dir):
    return ss.fresh(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"), 86_400)


_MISSION = """o AS (SELECT *, o_orderkey % 3 AS a, o_orderkey % 4 AS b, o_orderkey % 5 < 3 AS spray FROM orders), p AS (SELECT *, coalesce(lag(b) OVER w, 0) <> a AS far, coalesce(lag(spray) OVER w, false) AS was, lag(b) OVER w IS NULL AS first, lead(b) OVER w IS NULL AS last FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), m AS (SELECT *, was AND NOT far AS on_ FROM p)"""
_N = {
    "TAKEOFF": "first::INT",
    "SPRAY_OFF": "(far AND was)::INT + (NOT spray AND on_)::INT + (last AND spray)::INT",
    "ALTITUDE_CHANGE": "far::INT + (spray AND NOT on_)::INT + (NOT spray)::INT + last::INT",
    "SPEED_CHANGE": "far::INT + (spray AND NOT on_)::INT + (NOT spray)::INT",
    "TRANSIT": "far::INT + (NOT spray)::INT",
    "SPRAY_ON": "(spray AND NOT on_)::INT",
    "SPRAY_WP": "spray::INT",
    "RTH": "last::INT",
    "LAND": "last::INT",
}
_B = "CAST(p_partkey * {} % 251 AS DOUBLE)"
QUERIES = {
    f.__name__: f
    for f in (cell_colours, scan_reasons, form_check, insert_guard, tile_corners, ring_texts, forecast_rows, stored_rates, shown_zones, classify_cells, band_index, mission_actions, mission_text, flight_physics, upsert_rows, fresh_rows)
}
ORACLES = {
    "cell_colours": """WITH e AS (SELECT event_id, event_type IN ('click', 'view') AS t, event_id % 3 AS s, (event_id % 9) / 8.0::DOUBLE AS f FROM events), c AS (SELECT *, '250,' || CAST(floor(204 - 150 * f + 0.5) AS BIGINT) || ',' || CAST(floor(61 - 40 * f + 0.5) AS BIGINT) AS rgb FROM e)
        SELECT event_id, CASE WHEN t THEN 'treated' WHEN s = 1 THEN 'undecided' ELSE 'skipped' END AS kind, CASE WHEN t THEN 'rgba(' || rgb || ',' || printf('%.3f', floor((0.30::DOUBLE + 0.35::DOUBLE * f) * 1000 + 0.5) / 1000) || ')' END AS fill, CASE WHEN t THEN 'rgba(' || rgb || CASE WHEN s = 0 THEN ',0.95)' ELSE ',0.55)' END END AS stroke FROM c""",
    "scan_reasons": """WITH e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS s, event_id % 2 = 0 AS t, event_id % 5 > 1 AS u FROM events)
        SELECT event_id, u AND t AND s = 'completed' AS ok, CASE WHEN NOT u THEN 'This scan has no orthomosaic.' WHEN s <> 'completed' THEN 'This scan is still ' || s || '.' WHEN NOT t THEN 'This scan''s map tiles have not finished baking yet.' END AS reason FROM e""",
    "form_check": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Your name is required' END AS full_name, CASE c_custkey % 3 WHEN 1 THEN 'That doesn''t look like an email address' WHEN 2 THEN 'Email is required' END AS email,
        CASE WHEN length(c_mktsegment) > 9 THEN 'Keep this under 9 characters' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'Pick one of the listed options' END AS role FROM customer""",
    "insert_guard": "SELECT c_custkey, c_custkey % 3 > 0 AND (c_custkey % 2 <> 0 OR length(c_mktsegment) <= 9) AS ok FROM customer",
    "tile_corners": """WITH s AS (SELECT s_suppkey, degrees(atan((exp(pi() * (1 - 2 * (s_nationkey * 37) / 1024.0::DOUBLE)) - exp(-pi() * (1 - 2 * (s_nationkey * 37) / 1024.0::DOUBLE))) / 2)) AS lat FROM supplier)
        SELECT s_suppkey, round(lat, 9) AS lat, round((s_suppkey % 1024) / 1024.0::DOUBLE * 360 - 180, 9) AS lng, round(cos(radians(lat)) * (2 * pi() * 6378137.0::DOUBLE / 256 / 1024), 6) AS mpp FROM s""",
    "ring_texts": """WITH s AS (SELECT s_suppkey, s_nationkey::DOUBLE AS a, (s_suppkey % 90)::DOUBLE AS b FROM supplier)
        SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'SRID=4326;POLYGON((' || b || ' ' || a || ', ' || (b + 1) || ' ' || a || ', ' || b || ' ' || (a + 2) || ', ' || b || ' ' || a || '))' END AS wkt,
        '{"type":"Polygon","coordinates":[[[' || b || ',' || a || '],[' || (b + 1) || ',' || a || '],[' || b || ',' || (a + 2) || '],[' || b || ',' || a || ']]]}' AS geojson, a AS south, b AS west, a + 2 AS north, b + 1 AS east FROM s""",
    "forecast_rows": """SELECT event_id AS time, 20.0::DOUBLE AS temp_c, CAST(NULL AS DOUBLE) AS humidity, value * 3.6::DOUBLE AS wind_kmh, 0.0::DOUBLE AS gust_kmh, value AS precip_mm, CASE WHEN event_id % 2 = 0 THEN 500 ELSE 800 END AS code, CASE WHEN event_id % 2 = 0 THEN 'rain' ELSE '' END AS "desc" FROM events""",
    "stored_rates": """WITH e AS (SELECT event_id, event_id % 4 > 1 AS t FROM events WHERE event_id % 4 = 0 OR (event_id % 4 > 1 AND event_id % 5 > 0))
        SELECT event_id, 'c' || event_id AS cell_id, CASE WHEN t THEN 'treated' ELSE 'untreated' END AS state, CASE WHEN event_id % 3 = 0 THEN 'default' ELSE 'operator' END AS source, CASE WHEN t THEN CAST(event_id % 5 AS DOUBLE) END AS rate_lha, CAST(NULL AS VARCHAR) AS issue, CASE WHEN t THEN 'n' END AS note FROM e""",
    "shown_zones": """SELECT event_id, 'ai-0' AS id, 'Zone 1' AS name, CASE WHEN event_id % 3 = 0 THEN 'Row gap' ELSE 'Bare soil' END AS issue, CASE WHEN event_id % 4 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, 2 AS tier, CASE WHEN event_id % 4 = 0 THEN 'r' END AS recommendation
        FROM events WHERE event_id % 3 < 2 AND event_id % 4 <> 1 AND event_id % 5 <> 0""",
    "classify_cells": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'treated' ELSE 'untreated' END AS state, 'operator' AS source, CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 2 <> 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN 'new' END AS issue, CASE WHEN o_orderstatus <> 'F' OR o_orderkey % 7 >= 3 THEN 'old' END AS note FROM orders""",
    "band_index": f"""WITH p AS (SELECT p_partkey, {_B.format(3)} AS r, {_B.format(5)} AS g, {_B.format(7)} AS b, {_B.format(9)} AS n FROM part)
        SELECT p_partkey, CASE WHEN n + r <> 0 THEN (n - r) / (n + r) END AS ndvi, CASE WHEN g + r - b <> 0 THEN (g - r) / (g + r - b) END AS vari, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (-1 + r / 255 * 2 + 1) / 2 * 1.4::DOUBLE - 0.2::DOUBLE)) AS shown FROM p""",
    "mission_actions": f"WITH {_MISSION}, c AS ("
    + " UNION ALL ".join(f"SELECT o_custkey, '{k}' AS action, CAST(sum({v}) AS BIGINT) AS n FROM m GROUP BY 1" for k, v in _N.items())
    + ") SELECT * FROM c WHERE n > 0",
    "mission_text": """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id % 90)::DOUBLE AS lat, event_type AS k FROM events), r AS (
        SELECT user_id, i + 1 AS line_no, printf('%d\t0\t3\t%d\t%.2f\t%.2f\t%.2f\t0.00\t%.8f\t%.8f\t%.2f\t1', i, CASE k WHEN 'click' THEN 183 WHEN 'error' THEN 178 WHEN 'signup' THEN 20 ELSE 16 END, CASE k WHEN 'click' THEN 8.0 WHEN 'error' THEN 1.0 ELSE 0.0 END::DOUBLE, CASE k WHEN 'click' THEN 2000.0 WHEN 'error' THEN 5.0 ELSE 0.0 END::DOUBLE, CASE k WHEN 'error' THEN -1.0 ELSE 0.0 END::DOUBLE,
            CASE WHEN k IN ('click', 'error') THEN 0.0::DOUBLE ELSE lat END, CASE WHEN k IN ('click', 'error') THEN 0.0 ELSE 7.5 END::DOUBLE, CASE WHEN k IN ('click', 'error') THEN 0.0 ELSE 15.0 END::DOUBLE) AS line FROM e
        UNION ALL SELECT user_id, 0, 'QGC WPL 110' FROM e WHERE i = 1 UNION ALL SELECT user_id, 1, printf('0\t1\t0\t16\t0.00\t0.00\t0.00\t0.00\t%.8f\t7.50000000\t15.00\t1', lat) FROM e WHERE i = 1)
        SELECT user_id, CAST(line_no AS INTEGER) AS line_no, line FROM r""",
    "flight_physics": """WITH RECURSIVE s AS (SELECT s_suppkey, s_suppkey % 7 * 60 + 60.0::DOUBLE AS t, s_suppkey % 5 * 30.0::DOUBLE AS sp, least(40.0::DOUBLE, s_suppkey % 50) AS l, 0.9::DOUBLE + s_suppkey % 4 / 10.0::DOUBLE AS rho, s_suppkey % 11 - 5.0::DOUBLE AS h, s_suppkey % 6 AS n FROM supplier),
        f(i, s_suppkey, t, sp, l, rho, h, n, litres, slosh, total, peak) AS (SELECT -1, *, l, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s UNION ALL SELECT i + 1, s_suppkey, t, sp, l, rho, h, n, w, z, total + a, greatest(peak, a) FROM (
            SELECT *, pow((50 + w) * 9.80665::DOUBLE, 1.5::DOUBLE) / sqrt(2 * rho * 4 * pi() * pow(0.635::DOUBLE, 2)) / 0.72::DOUBLE / 52.22::DOUBLE + 0.9::DOUBLE * abs((w / 40 - 1) * 4 + z) AS a FROM (
            SELECT *, CASE WHEN w > 0 THEN slosh + (least(25, greatest(-25, degrees(atan2(h * 0.15::DOUBLE, 9.80665::DOUBLE)))) / 25 * w / 40 * 12 - slosh) * (1 - exp(-(t / 240) / greatest(0.15::DOUBLE, 1.8::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * w / 40)))) ELSE 0 END AS z FROM (
            SELECT *, CASE WHEN sp > 0 THEN greatest(0, l - l / sp * (t / 240) * least(i + 2, ceil(sp / t * 240))) ELSE l END AS w FROM f WHERE i < 239)))),
        e AS (SELECT *, CASE WHEN n > 0 THEN n * (6 / 2.5::DOUBLE * 2 + 2.5::DOUBLE) ELSE 0 END AS turning FROM f WHERE i = 239)
        SELECT s_suppkey, round(total / 240, 6) AS mean_amps, round(peak, 6) AS peak_amps, round(50 + litres, 6) AS end_kg, round((t + turning) / 60, 6) AS minutes, greatest(1, CAST(ceil((total * t / 240 + turning * total / 240 * 1.15::DOUBLE) / 3600 / 24) AS BIGINT)) AS batteries FROM e""",
    "upsert_rows": """WITH ch AS (SELECT c_custkey * 2 AS c_custkey, upper(c_name) AS c_name FROM customer WHERE c_custkey % 3 = 0), u AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ch) UNION ALL SELECT * FROM ch)
        SELECT * FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)""",
    "fresh_rows": "SELECT event_id, ts FROM events WHERE CAST(floor(epoch(TIMESTAMP '2024-01-15 12:00:00')) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) <= 86400",
}
