"""Catalogue: ordered paths, intervals and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import text as tx
from furrow.functions import units
from furrow.operators import paths as pa
from furrow.session import table


def _points(spark, sf_dir):
    """Events as points of a path of whole numbers: value in cents and the number in props."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("x"), (k * 100).alias("y"))


ORDER = ["ts", "event_id"]


def polyline_length(spark, sf_dir):
    return pa.polyline_length(_points(spark, sf_dir), "user_id", ORDER).select("user_id", F.round("length", 4).alias("length"), "points")


def timeline(spark, sf_dir):
    on = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    t = pa.timeline(_points(spark, sf_dir), "user_id", ORDER, 8.0, on, 1000.0)
    return t.select("user_id", "event_id", F.round("t_end", 4).alias("t_end"), "spraying")


def split_on_gaps(spark, sf_dir):
    return pa.split_on_gaps(_points(spark, sf_dir), "user_id", ORDER, 9000.0).groupBy("user_id", "fragment").agg(F.count("*").alias("n"))


def interval_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start"), F.date_add(F.to_date("o_orderdate"), 60).alias("end"))
    return pa.merge_intervals(o, "o_custkey", "start", "end")


def alternate_passes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return pa.alternate(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "reversed")


def segment_at(spark, sf_dir):
    """The last view before each purchase of a user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    seg = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return pa.last_at_or_before(e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), seg, "user_id", "ts", "ts", "view_id").select("event_id", "view_id")


def interpolate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("t"), F.col("value").alias("v"))
    first = e.groupBy("user_id", "t").agg(F.min("v").alias("v"))
    return pa.interpolate(first, "user_id", "t", "v", 7200.0).select("user_id", "t", F.round("value", 9).alias("value"))


def at_fraction(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    one = li.groupBy("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("q").alias("q"))
    return pa.at_fractions(one, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "q", [0.25, 0.5, 0.75])


def battery_recall(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 100).alias("level"), (F.col("p_size") / 20).alias("drain"))
    return pa.depletion(p, F.col("level"), F.col("drain")).select("p_partkey", "recall_minute")


def month_grid(spark, sf_dir):
    """The calendar of each month that has orders, with the orders of each day that it shows."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    months = o.select(F.trunc("day", "month").alias("month")).distinct()
    shown = months.select("month", F.explode(pa.month_grid(F.col("month"), 1)).alias("day"))
    return shown.join(o, "day", "left").select("month", "day", F.coalesce("n", F.lit(0)).alias("orders"))


def crossfade(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", pa.crossfade(F.col("value") / 50, 8).alias("c"))
    return e.select("event_id", "c.a", "c.b", "c.weight_a", "c.weight_b")


def fnv_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.fnv1a(F.col("p_name")).alias("h"), tx.grid_id(F.col("p_name"), F.col("p_size")).alias("grid_id"))


def url_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.url_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path", "u.query")


def cell_id_parse(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.concat_ws(":", F.lit("g"), "user_id")).when(F.col("event_id") % 7 == 0, F.lit("g:a:1")).otherwise(F.concat_ws(":", F.lit("g"), -F.col("user_id"), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", tx.parse_cell_id(text).alias("c")).select("event_id", "c.col", "c.row")


def unit_report(spark, sf_dir):
    v = F.col("p_retailprice")
    cols = [units.convert(v, k, u).alias(f"{k}_{i}") for i, (k, u) in enumerate((("area", "ha"), ("volume", "gal"), ("distance", "ft"), ("speed", "mph"), ("mass", "lb")))]
    return table(spark, sf_dir, "part").select("p_partkey", *cols, units.fahrenheit(v).alias("f"), units.decimals(v).alias("digits"), tx.compass(v).alias("compass"))


def note_and_stage(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    crop = F.element_at(F.array(F.lit("Wheat"), F.lit("corn"), F.lit("beans")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    note = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("<&>  "))
    return o.select("o_orderkey", tx.growth_stage(crop, F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp")).alias("stage"), tx.escape_markup(tx.normalise_note(note, 12)).alias("note"), tx.weather_text(F.col("o_orderkey") % 100).alias("weather"))


_P = "p AS (SELECT user_id, ts, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS x, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) * 100 AS y FROM events)"
_H = _P + ", h AS (SELECT *, coalesce(sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)), 0) AS hop FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_STAGE = """CASE WHEN days >= 0 THEN '~' || wk || CASE WHEN crop = 'wheat' THEN CASE WHEN wk < 4 THEN ' weeks (emergence / tillering)' WHEN wk < 10 THEN ' weeks (tillering / stem extension)' WHEN wk < 16 THEN ' weeks (heading / flowering)' ELSE ' weeks (grain fill / ripening)' END
 WHEN crop = 'corn' THEN CASE WHEN wk < 4 THEN ' weeks (V1–V4)' WHEN wk < 10 THEN ' weeks (V6–V12)' WHEN wk < 14 THEN ' weeks (tasseling / silking)' ELSE ' weeks (grain fill / dent)' END ELSE ' weeks since planting' END END"""
_HASH = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({s}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"

QUERIES = {
    f.__name__: f
    for f in (polyline_length, timeline, split_on_gaps, interval_merge, alternate_passes, segment_at, interpolate, at_fraction, battery_recall, month_grid, crossfade, fnv_id, url_parse, cell_id_parse, unit_report, note_and_stage)
}
ORACLES = {
    "polyline_length": f"WITH {_H} SELECT user_id, round(sum(hop), 4) AS length, count(*) AS points FROM h GROUP BY 1",
    "timeline": f"WITH {_H} SELECT user_id, event_id, round(sum(CASE WHEN hop >= 1000 THEN hop ELSE 0 END) OVER w / 8.0::DOUBLE, 4) AS t_end, coalesce(last_value(CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER w, false) AS spraying FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "split_on_gaps": f"WITH {_H} SELECT user_id, fragment, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN hop > 9000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fragment FROM h) GROUP BY 1, 2",
    "interval_merge": """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 60 AS e FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM o),
        i AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT o_custkey, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY o_custkey, i""",
    "alternate_passes": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 2 = 0 AS reversed FROM orders",
    "segment_at": "SELECT event_id, view_id FROM (SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC) = 1)",
    "interpolate": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, min(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT user_id, t AS t0, lead(t) OVER w AS t1, v AS v0, lead(v) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
        k AS (SELECT *, unnest(generate_series(CAST(ceil(t0 / 7200.0) AS BIGINT), CAST(ceil(t1 / 7200.0) AS BIGINT) - 1)) AS k FROM s WHERE t1 > t0) SELECT user_id, CAST(k * 7200 AS DOUBLE) AS t, round(v0 + (v1 - v0) * ((k * 7200 - t0)::DOUBLE / (t1 - t0)), 9) AS value FROM k""",
    "at_fraction": """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(q) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS hi, sum(q) OVER (PARTITION BY l_suppkey) AS total FROM l),
        f AS (SELECT *, unnest([0.25, 0.5, 0.75])::DOUBLE AS fraction FROM c) SELECT l_suppkey, fraction, l_orderkey, l_linenumber, l_partkey FROM f WHERE hi >= fraction * total AND hi - q < fraction * total""",
    "battery_recall": "SELECT p_partkey, CAST(list_min(list_filter(range(0, 61), lambda m: floor(greatest(0, p_retailprice % 100 - (p_size / 20) * m) * 10 + 0.5) / 10 <= 25.0)) AS INTEGER) AS recall_minute FROM part",
    "month_grid": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month FROM o),
        g AS (SELECT month, CAST(month - CAST((isodow(month) - 1) AS INTEGER) + CAST(i AS INTEGER) AS DATE) AS day FROM m, range(42) t(i)) SELECT month, g.day, coalesce(n, 0) AS orders FROM g LEFT JOIN o ON o.day = g.day""",
    "crossfade": """WITH p AS (SELECT event_id, greatest(0.0::DOUBLE, least(7.0::DOUBLE, value / 50)) AS p FROM events), q AS (SELECT *, CAST(floor(p) AS BIGINT) AS a, least(CAST(floor(p) AS BIGINT) + 1, 7) AS b FROM p)
        SELECT event_id, a, b, 1 - (p - a) AS weight_a, CASE WHEN b > a THEN p - a ELSE 0 END AS weight_b FROM q""",
    "fnv_id": f"WITH s AS (SELECT p_partkey, p_name, p_name || '|' || p_size AS g FROM part) SELECT p_partkey, {_HASH.format(s='p_name')} AS h, lower(to_base({_HASH.format(s='g')}, 36, 7)) AS grid_id FROM s",
    "url_parse": "SELECT page_id, nullif(regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 1), '') AS scheme, nullif(regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 2), '') AS host, nullif(regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 3), '') AS path, nullif(regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 4), '') AS query FROM pages",
    "cell_id_parse": 'SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(-user_id AS INTEGER) END AS col, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(event_id AS INTEGER) END AS "row" FROM events',
    "unit_report": f"""SELECT p_partkey, p_retailprice * {1 / 10_000!r}::DOUBLE AS area_0, p_retailprice * {1 / 3.785411784!r}::DOUBLE AS volume_1, p_retailprice * {1 / 0.3048!r}::DOUBLE AS distance_2, p_retailprice * {3600 / 1609.344!r}::DOUBLE AS speed_3, p_retailprice * {1 / 0.45359237!r}::DOUBLE AS mass_4,
        p_retailprice * 9 / 5 + 32 AS f, CAST(CASE WHEN p_retailprice = 0 OR abs(p_retailprice) >= 1000 THEN 0 WHEN abs(p_retailprice) >= 100 THEN 1 WHEN abs(p_retailprice) >= 1 THEN 2 ELSE 3 END AS INTEGER) AS digits, {list(tx.COMPASS)!r}[CAST(floor(p_retailprice / 22.5::DOUBLE + 0.5) AS BIGINT) % 16 + 1] AS compass FROM part""",
    "note_and_stage": f"""WITH o AS (SELECT o_orderkey, lower(['Wheat', 'corn', 'beans'][o_orderkey % 3 + 1]) AS crop, CAST(floor((epoch(TIMESTAMP '1998-01-01') - floor(epoch(o_orderdate))) / 86400) AS BIGINT) AS days, o_orderpriority, o_orderkey % 100 AS w FROM orders),
        k AS (SELECT *, CAST(floor(days / 7.0 + 0.5) AS BIGINT) AS wk FROM o) SELECT o_orderkey, {_STAGE} AS stage, replace(replace(replace(substr(o_orderpriority || '<&>', 1, 12), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS note,
        CASE WHEN w <= 0 THEN 'clear sky' WHEN w <= 2 THEN 'mainly clear' WHEN w <= 3 THEN 'overcast' WHEN w <= 48 THEN 'fog' WHEN w <= 57 THEN 'drizzle' WHEN w <= 67 THEN 'rain' WHEN w <= 77 THEN 'snow' WHEN w <= 82 THEN 'rain showers' WHEN w <= 86 THEN 'snow showers' ELSE 'thunderstorm' END AS weather FROM k""",
}
