"""Catalogue: small filters, joins, texts and cell state over the tables as rows of the right shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import filters, flight, geo, rules, units
from furrow.functions import text as tx
from furrow.operators import cells as cl
from furrow.operators import paths
from furrow.operators import reporting as rp
from furrow.plans.paths import _HASH
from furrow.plans.spatial import _CLAIMS, _claims
from furrow.session import table
from furrow.sources import semistructured as ss
from furrow.sources import sinks

BOX = {"north": 41.01, "south": 41.0, "west": -93.0, "east": -92.98}
WIDE, TALL = 160, 120


def deny_all(spark, sf_dir):
    return filters.deny_all(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


def row_checks(spark, sf_dir):
    model = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    status = F.when(F.col("c_custkey") % 11 > 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", filters.check_row(status, ["BUILDING", "MACHINERY", "FURNITURE"], model, "BUILDING").alias("ok"))


def image_caps(spark, sf_dir):
    reported = F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") * 7 - 60)
    return table(spark, sf_dir, "supplier").select("s_suppkey", filters.image_cap(reported).cast("long").alias("cap"), filters.class_label(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))).alias("label"))


def mean_scores(spark, sf_dir):
    """Mean score of a label's cells that have one; none without any."""
    e = table(spark, sf_dir, "embeddings").select("label", F.when((F.col("vec_id") % 3 == 0) & (F.col("label") != 2), F.col("vec_id") % 10).alias("score"))
    return e.groupBy("label").agg(F.avg("score").alias("score"), F.count("*").alias("cells"))


def stored_cells(spark, sf_dir):
    """Cells with their stored rate and detection; stored ids beyond the grid are dropped."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    cells = c.select(k.alias("cell_id"))
    rates = c.filter(k % 3 == 0).select((k * 2).alias("cell_id"), F.lit("treated").alias("state"), F.lit("operator").alias("source"), (k % 7).cast("double").alias("rate_lha"))
    scores = c.filter(k % 5 == 0).select((k + 3).alias("cell_id"), (k % 11 / 10).alias("score"))
    return cl.with_stored(cells, rates, scores)


def row_owners(spark, sf_dir):
    """Who owns what an order asks for; a missing row and another's look alike."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 3).alias("ask"))
    owners = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ask"), F.col("c_nationkey").alias("owner"))
    j = o.join(owners, "ask", "left")
    return j.select("o_orderkey", F.when(F.col("owner") == 7, F.col("owner")).alias("owner"))


def _pixels(spark, sf_dir):
    """A raster of WIDE x TALL pixels from the first line of each order that falls on one."""
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % (WIDE * TALL)).alias("k")).agg(F.min(F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("v"))
    k, v = F.col("k"), F.col("v")
    return li.select((k % WIDE).alias("x"), F.floor(k / WIDE).alias("y"), (v % 200).alias("r"), (v * 3 % 251).alias("g"), (v * 7 % 241).alias("b"), F.when(v % 13 == 0, 0).otherwise(255).alias("a"))


def _plots(spark, sf_dir):
    """Slanted cells in the raster, one for each of the first nations' numbers; sizes differ, so strides do."""
    n = F.col("n_nationkey")
    lat, lng, s = 41.0003 + (n % 5) * 0.0019, -92.9995 + F.floor(n / 5) * 0.0038, 0.0006 + (n % 4) * 0.00045
    p = lambda a, b: F.struct((lat + s * a).alias("lat"), (lng + s * b * 1.5).alias("lng"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell_id"), F.array(p(0.0, 0.1), p(0.15, 1.0), p(1.0, 0.9), p(0.9, 0.0)).alias("ring"))


def _held(spark, sf_dir):
    return cl.cell_pixels(_pixels(spark, sf_dir), _plots(spark, sf_dir), BOX, WIDE, TALL, 60)


def cell_pixels(spark, sf_dir):
    return _held(spark, sf_dir).select("cell_id", "x", "y")


def second_raster(spark, sf_dir):
    """A coarser raster's value at each pixel of a cell; some of its pixels are no number, and it ends before the first one does."""
    v = _pixels(spark, sf_dir).filter("x % 4 = 0 AND y % 4 = 0").select(F.floor(F.col("x") / 4).alias("x"), F.floor(F.col("y") / 4).alias("y"), F.when(F.col("r") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("g") / 251).alias("value"))
    inner = BOX | {"east": -92.985}
    return cl.second_raster(_held(spark, sf_dir), v, inner, WIDE // 4, TALL // 4).select("cell_id", "x", "y", "index")


def cell_features(spark, sf_dir):
    """Twelve features a cell and four of a second raster."""
    h = _held(spark, sf_dir).withColumn("index", F.when(F.col("x") % 3 > 0, F.col("b") / 241))
    f = cl.cell_features(h, True)
    return f.select("cell_id", "pixels", "usable", F.posexplode_outer(F.transform("features", lambda x: F.round(x, 8))).alias("f", "value"))


def sampling_verdict(spark, sf_dir):
    return cl.sampling_verdict(cl.cell_features(_held(spark, sf_dir)), _plots(spark, sf_dir))


def nearest_claims(spark, sf_dir):
    return cl.nearest_claims(_claims(spark, sf_dir)).select("new_col", "new_row", "col", "row")


def _legs(spark, sf_dir):
    """Events of a user as legs of whole seconds, one after another."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.floor("value") % 9 + 1).cast("double").alias("leg"))
    w = paths.running("user_id", "event_id")
    return e.withColumn("t_end", F.sum("leg").over(w)).withColumn("t_start", F.col("t_end") - F.col("leg")).withColumn("distance", F.col("t_end") * 2).withColumn("leg", F.col("leg") * 2)


def _probes(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id % 7 = 0").select(F.col("event_id").alias("probe"), "user_id", (F.floor("value") % 60 + 0.5 * (F.col("event_id") % 2)).alias("at"))


def playback_segment(spark, sf_dir):
    """The leg that plays at a time: the first whose end isn't before it."""
    s = cl.first_not_ended(_probes(spark, sf_dir), _legs(spark, sf_dir), "user_id", "at", "t_end", "event_id")
    return s.select("probe", "at", "event_id")


def covered_distance(spark, sf_dir):
    return cl.covered_at(_probes(spark, sf_dir), _legs(spark, sf_dir), "user_id", "at").select("probe", F.round("covered", 6).alias("covered"))


def snapped_switch(spark, sf_dir):
    legs = _legs(spark, sf_dir).select("user_id", "t_end", (F.col("event_type") == "click").alias("on"))
    return cl.snapped(legs, "user_id", "t_end", "on", 2.0)


def history_pair(spark, sf_dir):
    """Stressed area of a customer's first and last order, and the change; an older 0 gives 0."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0).cast("long")).alias("stressed"))
    s = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("stressed", F.coalesce("stressed", F.lit(0)))
    at = F.struct("o_orderdate", "o_orderkey")
    pair = s.groupBy("o_custkey").agg(F.min_by("stressed", at).alias("older"), F.max_by("stressed", at).alias("newer"), F.count("*").alias("n")).filter("n >= 2")
    return pair.select("o_custkey", "older", "newer", F.round(rp.change_percent(F.col("older"), F.col("newer")), 9).alias("delta"))


def report_summary(spark, sf_dir):
    """What a report keeps of its zones, as one struct a return flag."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    s = F.struct(F.count("*").alias("zones"), F.sum(q).alias("area"), F.max(q).alias("largest"), F.count_if(q > 40).alias("high"))
    return li.groupBy("l_returnflag").agg(s.alias("s")).select("l_returnflag", "s.*")


def pending_files(spark, sf_dir):
    """Files that aren't uploaded yet, by name, size and time."""
    p = table(spark, sf_dir, "part").select("p_partkey", tx.file_key(F.col("p_name"), F.col("p_size"), F.col("p_partkey") % 97).alias("key"))
    done = p.filter("p_partkey % 3 = 0").select("key")
    return p.join(done, "key", "left_anti").select("p_partkey", "key")


def _triangles(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = F.col("s_nationkey") * 1.25, (F.col("s_suppkey") % 90) * -0.5
    p = lambda x, y: F.struct(x.alias("lat"), y.alias("lng"))
    return s.select("s_suppkey", F.array(p(a, b), p(a, b + 1), p(a + 2, b)).alias("ring"))


def boundary_hash(spark, sf_dir):
    """Fingerprint of one or two rings."""
    rings = F.when(F.col("s_suppkey") % 2 == 0, F.array("ring")).otherwise(F.array("ring", "ring"))
    return _triangles(spark, sf_dir).select("s_suppkey", tx.boundary_hash(rings).alias("hash"))


def polygon_ewkt(spark, sf_dir):
    """A stored JSON outline as EWKT; below three points there is none."""
    t = _triangles(spark, sf_dir)
    raw = F.to_json(F.when(F.col("s_suppkey") % 5 == 0, F.slice("ring", 1, 2)).otherwise(F.col("ring")))
    return t.select("s_suppkey", geo.ring_wkt(F.get(ss.boundary(raw), F.lit(0)), 4326).alias("ewkt"))


def small_texts(spark, sf_dir):
    """Markup, compass, currency, money and keys of a customer's row."""
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, "EUR").when(k % 3 == 1, "eur").otherwise(F.col("c_mktsegment"))
    name = F.concat(F.lit("<b> & \""), F.col("c_name"), F.lit("'"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.escape_markup(name).alias("safe"), tx.compass((k * 7 % 360).cast("double")).alias("wind"), tx.currency(code).alias("currency"),
        tx.money(k / 8, tx.currency(code)).alias("money"), tx.place_key("weather", (k + 1) / 16, -(k + 1) / 32).alias("key"), filters.normalised(F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")), True).alias("name"),
    )


def small_units(spark, sf_dir):
    """Temperatures, speeds, rain and digits as the weather screen shows them."""
    v = F.floor("value") * 1.0
    return table(spark, sf_dir, "events").select("event_id", units.fahrenheit(v).alias("f"), F.round(units.mph_shown(v), 9).alias("mph"), F.round(units.inches(v), 9).alias("inches"), units.decimals(v).alias("digits"))


def small_geometry(spark, sf_dir):
    """Clamps, rotations, crossings, wind parts and grid sizes of a supplier's numbers."""
    k, n = F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")
    lat, lng = geo.rotate(n + 1, k / 100, F.lit(10.0), F.lit(0.5), 0.8, 0.6)
    cross = geo.segment_crossing((F.lit(0.0), F.lit(0.0)), (F.lit(8.0), F.lit(4.0)), (n - 4, F.lit(5.0)), (n % 7, F.lit(-3.0)))
    head, side = rules.wind_components(k % 13, k * 11 % 360, n * 10)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", geo.clamp(n, 3.0, 17.0).alias("clamped"), F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"), F.round(cross, 9).alias("t"), (F.round(head, 9) + 0.0).alias("head"), (F.round(side, 9) + 0.0).alias("side"),
        F.coalesce(rules.zone_rate(F.when(k % 3 > 0, k % 5), n), F.lit(-1.0)).alias("rate"), flight.cell_size(k % 9 + 1, n % 4).alias("cell_m"),
    )


def weather_codes(spark, sf_dir):
    code = F.col("event_id") % 101
    return table(spark, sf_dir, "events").select("event_id", tx.weather_text(code).alias("text"), tx.weather_icon(code).alias("icon"))


def reason_texts(spark, sf_dir):
    """The first reason against spraying in an hour, as a sentence."""
    v = F.floor("value")
    r = rules.spray_reasons(v % 40, v % 55, v % 3 / 4, v % 37, v % 90)
    return table(spark, sf_dir, "events").select("event_id", F.get(r, F.lit(0)).alias("r")).select("event_id", tx.reason_text(F.col("r")).alias("text"))


def radar_frames(spark, sf_dir):
    """Past and coming frames of each user's hours, and where play starts."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    past = F.filter("ids", lambda x: x % 3 > 0)
    return e.select("user_id", "hour", ss.radar_frames(past, F.filter("ids", lambda x: x % 3 == 0)).alias("f")).select("user_id", "hour", F.concat_ws(",", F.col("f.frames").cast("array<string>")).alias("frames"), "f.start")


def boundary_rings(spark, sf_dir):
    """How many rings and points a stored boundary has, old style or new."""
    p = '{{"lat": {0}, "lng": {1}}}'
    one = "[" + ", ".join(p.format(i, i * i) for i in range(3)) + "]"
    short = "[" + p.format(0, 0) + "]"
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, one).when(k == 1, f"[{one}, {short}]").when(k == 2, f"[{one}, {one}]").otherwise("nothing")
    b = ss.boundary(raw)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(F.size(b), F.lit(-1)).alias("rings"), F.aggregate(F.coalesce(F.transform(b, F.size), F.array()), F.lit(0), lambda s, x: s + x).alias("points"))


def repaired_vertices(spark, sf_dir):
    """Vertices as given, swapped, or as shares of the field's box."""
    k = F.col("c_custkey")
    box = F.struct(F.lit(40.0).alias("south"), F.lit(-94.0).alias("west"), F.lit(41.0).alias("north"), F.lit(-93.0).alias("east"))
    a, b = 40 + k % 10 / 10, -94 + k % 7 / 7
    point = F.when(k % 4 == 0, F.array(a, b)).when(k % 4 == 1, F.array(b, a)).when(k % 4 == 2, F.array(k % 10 / 10, k % 7 / 7)).otherwise(F.array(k + 50.0, k + 60.0))
    v = ss.repair_vertex(point, box)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(v["lat"], 9).alias("lat"), F.round(v["lng"], 9).alias("lng"))


def settings_leaves(spark, sf_dir):
    """A settings blob's leaves over their defaults."""
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "broken {").otherwise(F.concat(F.lit('{"units": {"area": "ac"}, "tank": '), (k % 40).cast("string"), F.when(k % 2 == 0, ', "alerts": false').otherwise(F.lit("")), F.lit("}")))
    return table(spark, sf_dir, "customer").select("c_custkey", ss.settings(raw, {"units.area": "ha", "tank": 30, "alerts": True}).alias("s")).select("c_custkey", "s.*")


def json_keys(spark, sf_dir):
    """One key of a stored object replaced, the others kept."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 > 0, F.concat(F.lit('{"a": "'), k.cast("string"), F.lit('", "grid": "old"}')))
    out = sinks.set_json_key(raw, "grid", k * 2)
    return table(spark, sf_dir, "customer").select("c_custkey", F.get_json_object(out, "$.a").alias("a"), F.get_json_object(out, "$.grid").alias("grid"))


def single_row(spark, sf_dir):
    return ss.one_or_none(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey") == 7)


def inserted_rows(spark, sf_dir):
    """Customers with new ones of unknown columns added: what the table doesn't have is left out."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_name").alias("not_there"))
    return sinks.insert(c, new)


def packed_cells(spark, sf_dir):
    """Decided cells of each nation's customers, packed to one map and counted."""
    k = F.col("c_custkey")
    rate = F.struct(F.when(k % 2 == 0, "treated").otherwise("untreated").alias("state"), F.when(k % 3 == 0, "operator").otherwise("default").alias("source"), (k % 9).cast("double").alias("rate_lha"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grid"), k.cast("string").alias("cell_id"), rate.alias("rate"))
    return ss.pack_grid(c, "grid", 1 << 30).select("grid", F.size("rates").cast("long").alias("cells"), F.aggregate(F.map_values("rates"), F.lit(0.0), lambda s, r: s + r["rate_lha"]).alias("rates"))


_TRI = """t AS (SELECT s_suppkey, s_nationkey * 1.25::DOUBLE AS a, (s_suppkey % 90) * -0.5::DOUBLE AS b FROM supplier)"""
_PX = f"""px AS (SELECT k % {WIDE} AS x, CAST(floor(k / {WIDE}) AS BIGINT) AS y, v % 200 AS r, v * 3 % 251 AS g, v * 7 % 241 AS b, CASE WHEN v % 13 = 0 THEN 0 ELSE 255 END AS a FROM (SELECT l_orderkey % {WIDE * TALL} AS k, min(l_partkey * 8 + l_linenumber) AS v FROM lineitem GROUP BY 1)),
 pl0 AS (SELECT n_nationkey AS cell_id, 41.0003::DOUBLE + (n_nationkey % 5) * 0.0019::DOUBLE AS lat0, -92.9995::DOUBLE + floor(n_nationkey / 5) * 0.0038::DOUBLE AS lng0, 0.0006::DOUBLE + (n_nationkey % 4) * 0.00045::DOUBLE AS s FROM nation),
 co AS (SELECT unnest([[1, 0.0, 0.1], [2, 0.15, 1.0], [3, 1.0, 0.9], [4, 0.9, 0.0]]::DOUBLE[][]) AS q), pv AS (SELECT cell_id, q[1] AS i, lat0 + s * q[2] AS lat, lng0 + s * q[3] * 1.5::DOUBLE AS lng FROM pl0, co),
 pe AS (SELECT a.cell_id, a.lat AS pa, a.lng AS pn, b.lat AS qa, b.lng AS qn FROM pv a JOIN pv b ON a.cell_id = b.cell_id AND b.i = a.i % 4 + 1),
 pb AS (SELECT cell_id, greatest(0, least({WIDE - 1}, floor((min(lng) + 93.0::DOUBLE) / (-92.98::DOUBLE + 93.0::DOUBLE) * {WIDE}))) AS x0, greatest(0, least({WIDE - 1}, floor((max(lng) + 93.0::DOUBLE) / (-92.98::DOUBLE + 93.0::DOUBLE) * {WIDE}))) AS x1,
  greatest(0, least({TALL - 1}, floor((41.01::DOUBLE - max(lat)) / (41.01::DOUBLE - 41.0::DOUBLE) * {TALL}))) AS y0, greatest(0, least({TALL - 1}, floor((41.01::DOUBLE - min(lat)) / (41.01::DOUBLE - 41.0::DOUBLE) * {TALL}))) AS y1, greatest(1, floor(sqrt((x1 - x0 + 1) * (y1 - y0 + 1) / 60))) AS stride FROM pv GROUP BY 1),
 pp AS (SELECT *, 41.01::DOUBLE - (y + 0.5::DOUBLE) / {TALL} * (41.01::DOUBLE - 41.0::DOUBLE) AS lat, -93.0::DOUBLE + (x + 0.5::DOUBLE) / {WIDE} * (-92.98::DOUBLE + 93.0::DOUBLE) AS lng FROM px WHERE a > 0 AND r + g + b > 0),
 hp AS (SELECT pb.cell_id, pp.x, pp.y, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, any_value(lat) AS lat, any_value(lng) AS lng FROM pp JOIN pb ON (pp.x - x0) % stride = 0 AND (pp.y - y0) % stride = 0 JOIN pe ON pe.cell_id = pb.cell_id
  GROUP BY 1, 2, 3 HAVING sum(CASE WHEN ((pa > lat) <> (qa > lat)) AND lng < (qn - pn) * (lat - pa) / (qa - pa + 1e-12::DOUBLE) + pn THEN 1 ELSE 0 END) % 2 = 1)"""
_FT = _PX + """, n AS (SELECT cell_id, r / (r + g + b)::DOUBLE AS rs, g / (r + g + b)::DOUBLE AS gs, b / (r + g + b)::DOUBLE AS bs, (r + g + b) / 3::DOUBLE AS i, CASE WHEN g + r > 0 THEN (g - r) / (g + r)::DOUBLE ELSE 0 END AS n, 2 * gs - rs - bs AS e, CASE WHEN x % 3 > 0 THEN b / 241::DOUBLE END AS ix FROM hp),
 fs AS (SELECT cell_id, count(*) AS pixels, count(*) >= 30 AS usable, list_sort(list(n)) AS ln, list_sort(list(ix) FILTER (ix IS NOT NULL)) AS lx,
  [avg(rs), avg(gs), avg(bs), avg(i), stddev_pop(i), stddev_pop(rs), stddev_pop(gs), stddev_pop(bs), avg(e), stddev_pop(e), ln[CAST(floor(0.1 * (count(*) - 1) + 0.5) AS BIGINT) + 1], ln[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1],
   avg(ix), stddev_pop(ix), lx[CAST(floor(0.1 * (len(lx) - 1) + 0.5) AS BIGINT) + 1], lx[CAST(floor(0.9 * (len(lx) - 1) + 0.5) AS BIGINT) + 1]] AS fv FROM n GROUP BY 1)"""
_LEGS = """l0 AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) % 9 + 1 AS d FROM events), l AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY event_id)::DOUBLE AS t_end FROM l0),
 pr AS (SELECT event_id AS probe, user_id, CAST(floor(value) AS BIGINT) % 60 + 0.5::DOUBLE * (event_id % 2) AS "at" FROM events WHERE event_id % 7 = 0)"""

QUERIES = {
    f.__name__: f
    for f in (deny_all, row_checks, image_caps, mean_scores, stored_cells, row_owners, cell_pixels, second_raster, cell_features, sampling_verdict, nearest_claims, playback_segment, covered_distance, snapped_switch, history_pair, report_summary, pending_files, boundary_hash, polygon_ewkt, small_texts, small_units, small_geometry, weather_codes, reason_texts, radar_frames, boundary_rings, repaired_vertices, settings_leaves, json_keys, single_row, inserted_rows, packed_cells)
}
ORACLES = {
    "deny_all": "SELECT c_custkey, c_name FROM customer WHERE false",
    "row_checks": "SELECT c_custkey, (c_custkey % 11 = 0 OR c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')) AND (c_custkey % 3 > 0 OR c_custkey % 11 = 0 OR c_mktsegment = 'BUILDING') AS ok FROM customer",
    "image_caps": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 AND s_suppkey * 7 - 60 > 0 THEN least(s_suppkey * 7 - 60, 200) ELSE 200 END AS cap, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Unclassified' END AS label FROM supplier",
    "mean_scores": "SELECT label, avg(CASE WHEN vec_id % 3 = 0 AND label <> 2 THEN vec_id % 10 END) AS score, count(*) AS cells FROM embeddings GROUP BY 1",
    "stored_cells": "WITH r AS (SELECT c_custkey * 2 AS cell_id, (c_custkey % 7)::DOUBLE AS rate_lha FROM customer WHERE c_custkey % 3 = 0), d AS (SELECT c_custkey + 3 AS cell_id, (c_custkey % 11)::DOUBLE / 10 AS score FROM customer WHERE c_custkey % 5 = 0) SELECT c_custkey AS cell_id, CASE WHEN r.cell_id IS NULL THEN 'untreated' ELSE 'treated' END AS state, CASE WHEN r.cell_id IS NULL THEN 'default' ELSE 'operator' END AS source, rate_lha, score FROM customer LEFT JOIN r ON r.cell_id = c_custkey LEFT JOIN d ON d.cell_id = c_custkey",
    "row_owners": "SELECT o_orderkey, CASE WHEN c_nationkey = 7 THEN c_nationkey END AS owner FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 3 AND c_custkey % 2 = 0",
    "cell_pixels": f"WITH {_PX} SELECT cell_id, x, y FROM hp",
    "second_raster": f"""WITH {_PX}, v AS (SELECT CAST(floor(x / 4) AS BIGINT) AS vx, CAST(floor(y / 4) AS BIGINT) AS vy, g / 251::DOUBLE AS value FROM px WHERE x % 4 = 0 AND y % 4 = 0 AND r % 5 <> 0)
        SELECT cell_id, x, y, value AS index FROM hp LEFT JOIN v ON vx = floor((lng + 93.0::DOUBLE) / (-92.985::DOUBLE + 93.0::DOUBLE) * {WIDE // 4}) AND vy = floor((41.01::DOUBLE - lat) / (41.01::DOUBLE - 41.0::DOUBLE) * {TALL // 4})""",
    "cell_features": f"WITH {_FT}, u AS (SELECT cell_id, pixels, usable, unnest(range(0, 16)) AS f, fv FROM fs WHERE usable) SELECT cell_id, pixels, usable, CAST(f AS INTEGER) AS f, round(fv[f + 1], 8) AS value FROM u UNION ALL SELECT cell_id, pixels, usable, NULL, NULL FROM fs WHERE NOT usable",
    "sampling_verdict": f"WITH {_FT}, c AS (SELECT coalesce(pixels, 0) AS p FROM pl0 LEFT JOIN fs USING (cell_id)), t AS (SELECT count(*) AS cells, count(*) FILTER (p < 30) AS under, list_sort(list(p)) AS l FROM c) SELECT cells, under, l[CAST(floor(0.5 * (cells - 1) + 0.5) AS BIGINT) + 1] AS middle, cells - under >= 2 AS ok FROM t",
    "nearest_claims": f'WITH {_CLAIMS} SELECT new_col, new_row, col, "row" FROM claims WHERE landed QUALIFY row_number() OVER (PARTITION BY new_col, new_row ORDER BY dist2, ordinal) = 1',
    "playback_segment": f'WITH {_LEGS} SELECT probe, "at", arg_min(event_id, t_end) AS event_id FROM pr LEFT JOIN l ON l.user_id = pr.user_id AND "at" <= t_end GROUP BY probe, "at"',
    "covered_distance": f'WITH {_LEGS}, e AS (SELECT user_id, max(t_end) AS m FROM l GROUP BY 1) SELECT probe, round(least("at", m) * 2, 6) AS covered FROM pr JOIN e USING (user_id)',
    "snapped_switch": f"""WITH {_LEGS}, w AS (SELECT user_id, t_end AS t0, event_type = 'click' AS f0, lead(t_end) OVER (PARTITION BY user_id ORDER BY t_end) AS t1, lead(event_type = 'click') OVER (PARTITION BY user_id ORDER BY t_end) AS f1 FROM l),
        n AS (SELECT *, unnest(range(CAST(ceil(t0 / 2) AS BIGINT), CAST(ceil(t1 / 2) AS BIGINT))) * 2.0::DOUBLE AS t FROM w WHERE t1 IS NOT NULL) SELECT user_id, t, CASE WHEN (t - t0) / (t1 - t0) < 0.5 THEN f0 ELSE f1 END AS "on" FROM n""",
    "history_pair": """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, coalesce(q, 0) AS stressed FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
        p AS (SELECT o_custkey, arg_min(stressed, [epoch(o_orderdate), o_orderkey]) AS older, arg_max(stressed, [epoch(o_orderdate), o_orderkey]) AS newer FROM s GROUP BY 1 HAVING count(*) >= 2) SELECT *, round(CASE WHEN older > 0 THEN (newer - older)::DOUBLE / older * 100 ELSE 0 END, 9) AS delta FROM p""",
    "report_summary": "SELECT l_returnflag, count(*) AS zones, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS area, max(CAST(l_quantity AS BIGINT)) AS largest, count(*) FILTER (CAST(l_quantity AS BIGINT) > 40) AS high FROM lineitem GROUP BY 1",
    "pending_files": "WITH p AS (SELECT p_partkey, p_name || ':' || p_size || ':' || p_partkey % 97 AS key FROM part) SELECT p_partkey, key FROM p WHERE key NOT IN (SELECT key FROM p WHERE p_partkey % 3 = 0)",
    "boundary_hash": f"""WITH {_TRI}, r AS (SELECT s_suppkey, printf('%.7f,%.7f;', a, b) || printf('%.7f,%.7f;', a, b + 1) || printf('%.7f,%.7f;', a + 2, b) || '_' AS one FROM t), s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN one ELSE one || one END AS s FROM r)
        SELECT s_suppkey, lower(to_base({_HASH.format(s='s')}, 36)) AS hash FROM s""",
    "polygon_ewkt": f"WITH {_TRI} SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN 'SRID=4326;POLYGON((' || b || ' ' || a || ', ' || (b + 1) || ' ' || a || ', ' || b || ' ' || (a + 2) || ', ' || b || ' ' || a || '))' END AS ewkt FROM t",
    "small_texts": r"""WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS cur FROM customer)
        SELECT c_custkey, replace(replace(replace(replace('<b> & "' || c_name || '''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(floor((c_custkey * 7 % 360) / 22.5 + 0.5) AS BIGINT) % 16 + 1] AS wind,
        cur AS currency, printf('%.2f', c_custkey / 8::DOUBLE + 1e-9) || ' ' || cur AS money, 'weather:' || printf('%.3f', (c_custkey + 1) / 16::DOUBLE + 1e-9) || ',' || printf('%.3f', -(c_custkey + 1) / 32::DOUBLE - 1e-9) AS key, CASE WHEN c_custkey % 4 > 0 THEN lower(c_name) END AS name FROM c""",
    "small_units": "WITH e AS (SELECT event_id, floor(value) AS v FROM events) SELECT event_id, v * 9 / 5 + 32 AS f, round(v * 0.621371::DOUBLE, 9) AS mph, round(v / 25.4::DOUBLE, 9) AS inches, CAST(CASE WHEN v = 0 OR abs(v) >= 1000 THEN 0 WHEN abs(v) >= 100 THEN 1 WHEN abs(v) >= 1 THEN 2 ELSE 3 END AS INTEGER) AS digits FROM e",
    "small_geometry": """WITH s AS (SELECT s_suppkey, s_suppkey::DOUBLE AS k, s_nationkey::DOUBLE AS n FROM supplier), g AS (SELECT *, cos(radians(10)) AS sc, n + 1 - 10 AS y, (k / 100 - 0.5) * sc AS x, n - 4 AS cx, n % 7 AS dx FROM s),
        h AS (SELECT *, 8 * (-8) - 4 * (dx - cx) AS den, (cx * (-8) - 5 * (dx - cx)) / den AS t, (cx * 4 - 5 * 8) / den AS u FROM g)
        SELECT s_suppkey, greatest(3, least(17, n)) AS clamped, round(10 + x * 0.6 + y * 0.8, 9) AS lat, round(0.5 + (x * 0.8 - y * 0.6) / sc, 9) AS lng, CASE WHEN abs(den) >= 1e-14 AND t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN round(t, 9) END AS t,
        round(k % 13 * cos(radians(k * 11 % 360 - n * 10)), 9) + 0.0 AS head, round(k % 13 * sin(radians(k * 11 % 360 - n * 10)), 9) + 0.0 AS side, CASE WHEN k % 3 > 0 AND k % 5 > 0 THEN k % 5 ELSE n END AS rate, (k % 9 + 1) * greatest(1, n % 4) AS cell_m FROM h""",
    "weather_codes": """WITH e AS (SELECT event_id, event_id % 101 AS c FROM events) SELECT event_id, CASE WHEN c <= 0 THEN 'clear sky' WHEN c <= 2 THEN 'mainly clear' WHEN c <= 3 THEN 'overcast' WHEN c <= 48 THEN 'fog' WHEN c <= 57 THEN 'drizzle' WHEN c <= 67 THEN 'rain' WHEN c <= 77 THEN 'snow' WHEN c <= 82 THEN 'rain showers' WHEN c <= 86 THEN 'snow showers' ELSE 'thunderstorm' END AS text,
        CASE WHEN c <= 0 THEN '01d' WHEN c <= 2 THEN '02d' WHEN c <= 3 THEN '04d' WHEN c <= 48 THEN '50d' WHEN c <= 57 THEN '09d' WHEN c <= 67 THEN '10d' WHEN c <= 77 THEN '13d' WHEN c <= 82 THEN '09d' WHEN c <= 86 THEN '13d' ELSE '11d' END AS icon FROM e""",
    "reason_texts": """WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events), h AS (SELECT event_id, v % 40 AS w, v % 55 AS g, v % 3 / 4::DOUBLE AS r, v % 37 AS t, v % 90 AS u FROM e)
        SELECT event_id, CASE WHEN w > 16 THEN 'Wind ' || w || '.0 km/h, over the 16.0 km/h limit' WHEN g > 24 THEN 'Gusts ' || g || '.0 km/h, over the 24.0 km/h limit' WHEN r > 0.5 THEN 'never' WHEN t < 10 THEN 'Too cold at ' || t || ' °C, minimum 10 °C' WHEN w > 13 THEN 'Wind ' || w || '.0 km/h, close to the 16.0 km/h limit'
         WHEN t > 29 THEN 'Warm at ' || t || ' °C, evaporation and drift risk' WHEN u < 40 THEN 'Humidity ' || u || '%, below the 40% target' WHEN u > 70 THEN 'Humidity ' || u || '%, above the 70% target' END AS text FROM h""",
    "radar_frames": "SELECT user_id, date_trunc('hour', ts) AS hour, string_agg(event_id::VARCHAR, ',' ORDER BY event_id % 3 = 0, event_id) AS frames, CAST(greatest(0, count(*) FILTER (event_id % 3 > 0) - 1) AS INTEGER) AS start FROM events GROUP BY 1, 2",
    "boundary_rings": "SELECT s_suppkey, CAST(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS INTEGER) AS rings, CAST(CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 0 END AS INTEGER) AS points FROM supplier",
    "repaired_vertices": "WITH c AS (SELECT c_custkey, c_custkey % 4 AS m, c_custkey % 10 / 10::DOUBLE AS a, c_custkey % 7 / 7::DOUBLE AS b FROM customer) SELECT c_custkey, CASE WHEN m < 2 THEN round(40 + a, 9) WHEN m = 2 THEN round(41 - b, 9) END AS lat, CASE WHEN m < 2 THEN round(-94 + b, 9) WHEN m = 2 THEN round(-94 + a, 9) END AS lng FROM c",
    "settings_leaves": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'ha' ELSE 'ac' END AS units_area, CASE WHEN c_custkey % 5 = 0 THEN 30 ELSE c_custkey % 40 END AS tank, c_custkey % 5 = 0 OR c_custkey % 2 > 0 AS alerts FROM customer",
    "json_keys": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::VARCHAR END AS a, (c_custkey * 2)::VARCHAR AS grid FROM customer",
    "single_row": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7",
    "inserted_rows": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 10000000, s_name FROM supplier",
    "packed_cells": "SELECT c_nationkey AS grid, count(*) AS cells, sum((c_custkey % 9)::DOUBLE) AS rates FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 GROUP BY 1",
}
