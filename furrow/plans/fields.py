"""Catalogue: fields as lattices, blocks, outlines, rasters and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import blocks as bl
from furrow.operators import lattices as lt
from furrow.operators import marks, outlines, rasters
from furrow.plans.spatial import _COMP, components
from furrow.session import table


def _grid(spark, sf_dir):
    """Cells of 12 x 10 for each ten customers: an order is one, and the sum of its orders' keys tells its state."""
    o = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 10).alias("field"), (F.col("o_orderkey") % 12).cast("int").alias("col"), (F.floor("o_totalprice") % 10).cast("int").alias("row"), "o_orderkey"
    )
    c = o.groupBy("field", "col", "row").agg((F.sum("o_orderkey") % 10).alias("s"))
    treated = F.col("s") < 7
    state = F.when(treated, "treated").when(F.col("s") == 9, "skip").otherwise("default")
    rate = F.when(treated, F.when(F.col("col") < 7, 20.0).otherwise(40.0))
    return c.select("field", "col", "row", (36.0 + (F.col("col") + F.col("row")) % 3).alias("area"), state.alias("state"), rate.alias("rate"))


def flight_blocks(spark, sf_dir):
    """Rectangles of each field's selection after its gaps are closed with the wider kernel."""
    b = bl.blocks(bl.close_gaps(_grid(spark, sf_dir), "field", 0.2), "field")
    return b.select("field", "rate", "block", "col0", "row0", "cols", "rows", "cells", "area", "added_area", F.round("litres", 9).alias("litres"))


def block_totals(spark, sf_dir):
    """What closing gaps within the default tolerance adds to each field."""
    t = bl.block_totals(_grid(spark, sf_dir), "field")
    return t.select("field", "marked_area", "added_area", "sprayed_area", *[F.round(f"{c}_litres", 9).alias(f"{c}_litres") for c in ("marked", "added", "sprayed")], "blocks", "spared_skips")


def outline_loops(spark, sf_dir):
    """The corners of every zone's loops, in order."""
    return outlines.outline_corners(components(spark, sf_dir), "component").withColumnRenamed("component", "zone")


def _fields(spark, sf_dir):
    """A field with a dent a supplier, about 100 m wide, on its own heading."""
    k = F.col("s_suppkey").cast("double")
    at = lambda n, e: F.struct((41 + n / 111320.0).alias("lat"), (-93 + e / 84000.0).alias("lng"))
    ring = F.array(at(k % 5, k % 7), at(3.3 - k % 3, 90.7 + k % 11), at(F.lit(31.9), F.lit(52.3)), at(70.1 + k % 13, 97.9 - k % 4), at(61.7 - k % 5, 4.1 + k % 3))
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.array(ring).alias("rings"), F.struct(F.lit(41.00031).alias("lat"), F.lit(-92.99953).alias("lng")).alias("origin"), (F.col("s_nationkey") * 0.1 + 0.05).alias("heading"), F.lit(6.0).alias("swath_m"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("cell_multiple"))


def heading_lattice(spark, sf_dir):
    """Cells of slanted fields along their headings."""
    cells = lt.treatment_lattice(_fields(spark, sf_dir), "s_suppkey")
    return cells.select("s_suppkey", "col", "row", F.round("share", 6).alias("share"), "clipped")


def _prescription(spark, sf_dir):
    """A raster of 50 x 40 a nation, its boundary, and a triangle a supplier, partly over the boundary and each other."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").cast("double").alias("k"))
    p = lambda lat, lng: F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng"))
    grids = n.select("n_nationkey", F.lit(41.0).alias("origin_lat"), F.lit(-93.0).alias("origin_lng"), F.lit(0.00011).alias("pixel_lat"), F.lit(0.00013).alias("pixel_lng"), F.lit(50).alias("width"), F.lit(40).alias("height"))
    fence = F.array(p(40.9991 - F.col("k") * 1e-5, F.lit(-92.9993)), p(F.lit(40.99871), -92.99417 + F.col("k") * 1e-5), p(F.lit(40.99613), F.lit(-92.99501)), p(40.99629 + F.col("k") * 1e-5, F.lit(-92.99877)))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").cast("double").alias("k"))
    lat, lng = 40.9987 - F.col("k") % 17 * 0.00013, -92.9989 + F.col("k") % 23 * 0.00021
    ring = F.array(p(lat, lng), p(lat + 0.00031, lng + 0.00177), p(lat - 0.00119, lng + 0.00093))
    zones = s.select("n_nationkey", ring.alias("ring"), (F.col("k") % 6 * 5).alias("rate_lha"))
    return grids, zones, n.select("n_nationkey", fence.alias("ring"))


def burnt_pixels(spark, sf_dir):
    """Every pixel of every nation's prescription."""
    return rasters.burn_zones(*_prescription(spark, sf_dir), "n_nationkey")


def burnt_summary(spark, sf_dir):
    return rasters.raster_summary(burnt_pixels(spark, sf_dir), "n_nationkey")


def _clicks(spark, sf_dir):
    """Events as a marking session a user: clicks and views mark, errors unmark, signups go back, and some purchases clear."""
    v = F.floor("value").cast("long")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "undo").when(kind == "error", "unmark").when((kind == "purchase") & (v % 9 == 0), "clear").otherwise("mark")
    label = F.when(kind == "click", "treat").otherwise("leave")
    return table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"), (v % 15).cast("string").alias("cell"), label.alias("label"))


def marks_undone(spark, sf_dir):
    """What is marked at the end of each user's session."""
    return marks.replay(_clicks(spark, sf_dir), "user_id", "event_id")


def mark_steps(spark, sf_dir):
    """How many cells are marked after each event, and how many steps back there are."""
    return marks.replay(_clicks(spark, sf_dir), "user_id", "event_id", every=True)


_GRID = """g AS (SELECT CAST(floor(o_custkey / 10) AS BIGINT) AS field, CAST(o_orderkey % 12 AS INTEGER) AS col, CAST(floor(o_totalprice) % 10 AS INTEGER) AS "row", CAST(sum(o_orderkey) % 10 AS INTEGER) AS s FROM orders GROUP BY 1, 2, 3),
    cells AS MATERIALIZED (SELECT field, col, "row", 36.0::DOUBLE + (col + "row") % 3 AS area, CASE WHEN s < 7 THEN 'treated' WHEN s = 9 THEN 'skip' ELSE 'default' END AS state, CASE WHEN s < 7 THEN CASE WHEN col < 7 THEN 20.0::DOUBLE ELSE 40.0::DOUBLE END END AS rate FROM g),
    m AS MATERIALIZED (SELECT field, rate, col, "row", area FROM cells WHERE state = 'treated')"""


def _closed_sql(radius: int, tolerance: float) -> str:
    about = f"range({-radius}, {radius + 1}) AS a(dc), range({-radius}, {radius + 1}) AS b(dr)"
    return f"""{_GRID}, grown AS MATERIALIZED (SELECT field, rate, col + dc AS col, "row" + dr AS "row", count(*) AS near FROM m, {about} GROUP BY 1, 2, 3, 4),
    closed AS (SELECT field, rate, col + dc AS col, "row" + dr AS "row" FROM grown, {about} GROUP BY 1, 2, 3, 4 HAVING count(*) = {(2 * radius + 1) ** 2}),
    found AS MATERIALIZED (SELECT field, col, "row", min(c.rate) AS rate, min(w.near) AS near, min(f.area) AS area, bool_or(f.state = 'skip') AS skip
        FROM closed c JOIN cells f USING (field, col, "row") JOIN grown w ON w.field = c.field AND w.rate = c.rate AND w.col = c.col AND w."row" = c."row" WHERE f.state <> 'treated' GROUP BY 1, 2, 3 HAVING count(*) = 1),
    ranked AS (SELECT *, sum(area) OVER (PARTITION BY field ORDER BY near DESC, "row", col) AS total FROM found WHERE NOT skip),
    sel AS MATERIALIZED (SELECT *, false AS added FROM m UNION ALL SELECT field, rate, col, "row", area, true FROM ranked r WHERE total <= (SELECT sum(area) FROM m WHERE m.field = r.field) * {tolerance!r}::DOUBLE),
    corner AS (SELECT field, rate, col + dc AS col, "row" + dr AS "row" FROM sel, range(-1, 1) AS a(dc), range(-1, 1) AS b(dr) GROUP BY 1, 2, 3, 4 HAVING count(*) = 4),
    core AS (SELECT DISTINCT field, rate, col + dc AS col, "row" + dr AS "row" FROM corner, range(0, 2) AS a(dc), range(0, 2) AS b(dr)),
    parted AS MATERIALIZED (SELECT s.*, c.col IS NOT NULL AS core FROM sel s LEFT JOIN core c ON c.field = s.field AND c.rate = s.rate AND c.col = s.col AND c."row" = s."row"),
    runs AS (SELECT field, rate, core, 0 AS turned, "row" AS across, min(col) AS first, max(col) AS last, sum(area) AS area, coalesce(sum(area) FILTER (added), 0) AS added_area
        FROM (SELECT *, col - row_number() OVER (PARTITION BY field, rate, core, "row" ORDER BY col) AS i FROM parted) GROUP BY field, rate, core, "row", i
        UNION ALL SELECT field, rate, core, 1, col, min("row"), max("row"), sum(area), coalesce(sum(area) FILTER (added), 0)
        FROM (SELECT *, "row" - row_number() OVER (PARTITION BY field, rate, core, col ORDER BY "row") AS i FROM parted) GROUP BY field, rate, core, col, i),
    piles AS (SELECT field, rate, core, turned, first, last, min(across) AS low, max(across) AS high, sum(area) AS area, sum(added_area) AS added_area
        FROM (SELECT *, across - row_number() OVER (PARTITION BY field, rate, core, turned, first, last ORDER BY across) AS p FROM runs) GROUP BY field, rate, core, turned, first, last, p),
    best AS (SELECT field, rate, core, min({{'n': n, 'turned': turned}}).turned AS turned FROM (SELECT field, rate, core, turned, count(*) AS n FROM piles GROUP BY ALL) GROUP BY 1, 2, 3),
    rects AS MATERIALIZED (SELECT field, rate, CAST(CASE turned WHEN 0 THEN first ELSE low END AS INTEGER) AS col0, CAST(CASE turned WHEN 0 THEN low ELSE first END AS INTEGER) AS row0,
        CAST(CASE turned WHEN 0 THEN last - first ELSE high - low END + 1 AS INTEGER) AS cols, CAST(CASE turned WHEN 0 THEN high - low ELSE last - first END + 1 AS INTEGER) AS rows, area, added_area FROM piles JOIN best USING (field, rate, core, turned))"""


_RING = """VALUES (0, k % 5, k % 7), (1, 3.3::DOUBLE - k % 3, 90.7::DOUBLE + k % 11), (2, 31.9::DOUBLE, 52.3::DOUBLE), (3, 70.1::DOUBLE + k % 13, 97.9::DOUBLE - k % 4), (4, 61.7::DOUBLE - k % 5, 4.1::DOUBLE + k % 3)"""

QUERIES = {f.__name__: f for f in (flight_blocks, block_totals, outline_loops, heading_lattice, burnt_pixels, burnt_summary, marks_undone, mark_steps)}
_BURNT = """z AS (SELECT s_nationkey AS n, CAST(s_suppkey AS DOUBLE) AS k, 40.9987::DOUBLE - s_suppkey % 17 * 0.00013::DOUBLE AS lat, -92.9989::DOUBLE + s_suppkey % 23 * 0.00021::DOUBLE AS lng FROM supplier),
    rings AS (SELECT n, 1 AS zone, k AS id, k % 6 * 5 AS rate, [{'y': lat, 'x': lng}, {'y': lat + 0.00031::DOUBLE, 'x': lng + 0.00177::DOUBLE}, {'y': lat - 0.00119::DOUBLE, 'x': lng + 0.00093::DOUBLE}] AS r FROM z WHERE k % 6 > 0
        UNION ALL SELECT n_nationkey, 0, -1, 0, [{'y': 40.9991::DOUBLE - n_nationkey * 1e-5::DOUBLE, 'x': -92.9993::DOUBLE}, {'y': 40.99871::DOUBLE, 'x': -92.99417::DOUBLE + n_nationkey * 1e-5::DOUBLE}, {'y': 40.99613::DOUBLE, 'x': -92.99501::DOUBLE}, {'y': 40.99629::DOUBLE + n_nationkey * 1e-5::DOUBLE, 'x': -92.99877::DOUBLE}] FROM nation),
    e AS (SELECT n, zone, id, rate, r[i] AS p, r[i % len(r) + 1] AS q FROM rings, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)),
    px AS (SELECT n_nationkey AS n, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 41.0::DOUBLE - (y + 0.5::DOUBLE) * 0.00011::DOUBLE AS lat, -93.0::DOUBLE + (x + 0.5::DOUBLE) * 0.00013::DOUBLE AS lng FROM nation, range(40) AS a(y), range(50) AS b(x)),
    hits AS (SELECT px.n, y, x, zone, id, any_value(rate) AS rate FROM px JOIN e ON e.n = px.n AND (p.y > lat) <> (q.y > lat) AND lng < (q.x - p.x) * (lat - p.y) / (q.y - p.y + 1e-12::DOUBLE) + p.x GROUP BY 1, 2, 3, 4, 5 HAVING count(*) % 2 = 1),
    burnt AS (SELECT px.n AS n_nationkey, px.y, px.x, CAST(CASE WHEN coalesce(bool_or(zone = 0), false) THEN coalesce(max(rate) FILTER (zone = 1), 0) ELSE -9999 END AS FLOAT) AS rate FROM px LEFT JOIN hits USING (n, y, x) GROUP BY 1, 2, 3)"""
_MARKS = """ev AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CAST(CAST(floor(value) AS BIGINT) % 15 AS VARCHAR) AS cell, CASE WHEN event_type = 'click' THEN 'treat' ELSE 'leave' END AS label,
        CASE WHEN event_type = 'signup' THEN 'undo' WHEN event_type = 'error' THEN 'unmark' WHEN event_type = 'purchase' AND CAST(floor(value) AS BIGINT) % 9 = 0 THEN 'clear' ELSE 'mark' END AS action FROM events),
    walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS STRUCT(c VARCHAR, l VARCHAR)[]) AS marks, CAST([] AS STRUCT(c VARCHAR, l VARCHAR)[][]) AS hist FROM ev
        UNION ALL SELECT w.user_id, ev.n, ev.event_id,
            CASE WHEN action = 'undo' THEN CASE WHEN len(hist) > 0 THEN hist[len(hist)] ELSE marks END WHEN action = 'clear' THEN [] WHEN action = 'unmark' OR list_contains(marks, {'c': cell, 'l': label}) THEN list_filter(marks, lambda m: m.c <> cell)
                 ELSE list_append(list_filter(marks, lambda m: m.c <> cell), {'c': cell, 'l': label}) END,
            CASE WHEN action = 'undo' THEN hist[1 : len(hist) - 1] WHEN (action = 'clear' AND len(marks) = 0) OR (action = 'unmark' AND len(list_filter(marks, lambda m: m.c = cell)) = 0) THEN hist
                 ELSE list_slice(list_append(hist, marks), greatest(1, len(hist) - 98), len(hist) + 1) END
        FROM walk w JOIN ev ON ev.user_id = w.user_id AND ev.n = w.n + 1)"""
ORACLES = {
    "flight_blocks": f"WITH {_closed_sql(2, 0.2)} SELECT field, rate, concat_ws(':', 'b', field, col0, row0) AS block, col0, row0, cols, rows, cols * rows AS cells, area, CAST(added_area AS DOUBLE) AS added_area, round(area / 10000 * rate, 9) AS litres FROM rects",
    "block_totals": f"""WITH {_closed_sql(1, 0.08)} SELECT field, coalesce(sum(area) FILTER (NOT added), 0) AS marked_area, coalesce(sum(area) FILTER (added), 0) AS added_area, sum(area) AS sprayed_area, round(coalesce(sum(area / 10000 * rate) FILTER (NOT added), 0), 9) AS marked_litres,
        round(coalesce(sum(area / 10000 * rate) FILTER (added), 0), 9) AS added_litres, round(sum(area / 10000 * rate), 9) AS sprayed_litres, (SELECT count(*) FROM rects WHERE rects.field = sel.field) AS blocks, (SELECT count(*) FROM found WHERE skip AND found.field = sel.field) AS spared_skips FROM sel GROUP BY field""",
    "outline_loops": _COMP + """, side AS (SELECT component AS z, col + dx0 AS x, "row" + dy0 AS y, dx, dy FROM comp, (VALUES (0, 0, 1, 0), (1, 0, 0, 1), (1, 1, -1, 0), (0, 1, 0, -1)) AS s(dx0, dy0, dx, dy)),
        e AS MATERIALIZED (SELECT z, any_value(x) AS x, any_value(y) AS y, any_value(dx) AS dx, any_value(dy) AS dy FROM side GROUP BY z, least(x, x + dx), least(y, y + dy), dx <> 0 HAVING count(*) = 1),
        f AS MATERIALIZED (SELECT e.z, e.x, e.y, e.dx, e.dy, min({'turn': e.dx * o.dy - e.dy * o.dx, 'dx': o.dx, 'dy': o.dy}) AS o, ((e.x + 268435456) * 536870912 + (e.y + 268435456)) * 4 + CASE WHEN e.dx > 0 THEN 0 WHEN e.dy > 0 THEN 1 WHEN e.dx < 0 THEN 2 ELSE 3 END AS k
            FROM e JOIN e o ON o.z = e.z AND o.x = e.x + e.dx AND o.y = e.y + e.dy GROUP BY e.z, e.x, e.y, e.dx, e.dy),
        c AS MATERIALIZED (SELECT b.*, (a.dx, a.dy) <> (b.dx, b.dy) AS corner FROM f a JOIN f b ON b.z = a.z AND b.x = a.x + a.dx AND b.y = a.y + a.dy AND b.dx = a.o.dx AND b.dy = a.o.dy),
        walk AS (SELECT z, k AS start, 0 AS n, k, x, y, dx, dy, o, corner FROM c WHERE corner UNION ALL
            SELECT w.z, w.start, w.n + 1, c.k, c.x, c.y, c.dx, c.dy, c.o, c.corner FROM walk w JOIN c ON c.z = w.z AND c.x = w.x + w.dx AND c.y = w.y + w.dy AND c.dx = w.o.dx AND c.dy = w.o.dy WHERE c.k <> w.start),
        head AS (SELECT z, start FROM walk WHERE corner GROUP BY 1, 2 HAVING min(k) = start)
        SELECT z AS zone, start AS loop, CAST(row_number() OVER (PARTITION BY z, start ORDER BY n) - 1 AS INTEGER) AS seq, x, y FROM walk JOIN head USING (z, start) WHERE corner""",
    "heading_lattice": f"""WITH s AS (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS k, s_nationkey * 0.1::DOUBLE + 0.05::DOUBLE AS h, 6.0::DOUBLE * (s_suppkey % 3 + 1) AS size, cos(radians(41.00031::DOUBLE)) * 111320.0::DOUBLE AS wide FROM supplier),
        p AS (SELECT s.*, i, (-93 + e / 84000.0::DOUBLE + 92.99953::DOUBLE) * wide AS x, (41 + n / 111320.0::DOUBLE - 41.00031::DOUBLE) * 111320.0::DOUBLE AS y FROM s, LATERAL ({_RING}) AS r(i, n, e)),
        uv AS MATERIALIZED (SELECT s_suppkey, i, (x * cos(h) + y * sin(h)) / size AS u, (y * cos(h) - x * sin(h)) / size AS v FROM p),
        e AS MATERIALIZED (SELECT a.s_suppkey, a.u AS ua, a.v AS va, b.u AS ub, b.v AS vb FROM uv a JOIN uv b ON a.s_suppkey = b.s_suppkey AND b.i = (a.i + 1) % 5),
        b AS (SELECT s_suppkey, CAST(floor(min(u)) AS INTEGER) AS c0, CAST(ceil(max(u)) AS INTEGER) AS c1, CAST(floor(min(v)) AS INTEGER) AS r0, CAST(ceil(max(v)) AS INTEGER) AS r1 FROM uv GROUP BY 1),
        c AS MATERIALIZED (SELECT s_suppkey, CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row" FROM b, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS col), LATERAL (SELECT unnest(range(r0, r1 + 1)) AS "row")),
        t AS (SELECT c.*, sign(ub - ua) AS way, greatest(least(ua, ub), col) AS lo, least(greatest(ua, ub), col + 1) AS hi, ua, va, (vb - va) / (ub - ua) AS slope FROM c JOIN e USING (s_suppkey)),
        w AS (SELECT *, va + (lo - ua) * slope AS v1, va + (hi - ua) * slope AS v2 FROM t WHERE hi > lo),
        k AS (SELECT *, CASE WHEN v1 < "row" THEN "row" * v1 WHEN v1 <= "row" + 1 THEN "row" * "row" + (v1 * v1 - "row" * "row") / 2 ELSE "row" * "row" + (2 * "row" + 1) / 2.0::DOUBLE + ("row" + 1) * (v1 - "row" - 1) END AS g1,
            CASE WHEN v2 < "row" THEN "row" * v2 WHEN v2 <= "row" + 1 THEN "row" * "row" + (v2 * v2 - "row" * "row") / 2 ELSE "row" * "row" + (2 * "row" + 1) / 2.0::DOUBLE + ("row" + 1) * (v2 - "row" - 1) END AS g2 FROM w),
        area AS (SELECT s_suppkey, col, "row", abs(sum(way * (hi - lo) * (g2 - g1) / (v2 - v1))) AS share FROM k GROUP BY 1, 2, 3),
        hit AS (SELECT c.s_suppkey, c.col, c."row", dc, dr, count(*) AS n FROM c JOIN e USING (s_suppkey), (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) AS q(dc, dr) WHERE (va > c."row" + dr) <> (vb > c."row" + dr) AND c.col + dc < (ub - ua) * (c."row" + dr - va) / (vb - va + 1e-12::DOUBLE) + ua GROUP BY ALL HAVING count(*) % 2 = 1),
        whole AS (SELECT s_suppkey, col, "row" FROM hit GROUP BY 1, 2, 3 HAVING count(*) = 4)
        SELECT s_suppkey, col, "row", round(CASE WHEN w.col IS NULL THEN share ELSE 1 END, 6) AS share, w.col IS NULL AS clipped FROM area LEFT JOIN whole w USING (s_suppkey, col, "row") WHERE share >= 0.01""",
    "burnt_pixels": f"WITH {_BURNT} SELECT n_nationkey, y, x, rate FROM burnt",
    "burnt_summary": f"WITH {_BURNT} SELECT n_nationkey, count(*) FILTER (rate > 0) AS treated, count(*) FILTER (rate = 0) AS untreated, count(*) FILTER (rate < 0) AS no_data, coalesce(min(rate) FILTER (rate > 0), 0) AS min, coalesce(max(rate) FILTER (rate > 0), 0) AS max FROM burnt GROUP BY 1",
    "marks_undone": f"WITH RECURSIVE {_MARKS} SELECT user_id, m.c AS cell, m.l AS label FROM (SELECT user_id, unnest(marks) AS m FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)",
    "mark_steps": f"WITH RECURSIVE {_MARKS} SELECT user_id, event_id, len(marks) AS marked, len(hist) AS steps FROM walk WHERE n > 0",
}
