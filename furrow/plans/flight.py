"""Catalogue: flight rules over parts, orders and events as numbers of the right kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import flight as fl
from furrow.functions import rules
from furrow.operators import marks
from furrow.operators import reporting as rp
from furrow.session import table


def pass_spacing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    overlap = F.when(F.col("p_size") > 3, F.col("p_size") / 40)
    s = fl.pass_spacing((F.col("p_size") - 5).cast("double"), F.col("p_size") / 10, overlap)
    return p.select("p_partkey", s.alias("spacing"), fl.turns(F.col("p_retailprice") * 10, s, F.lit(50.0)).alias("turns"))


def maneuvers(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"v": (F.col("p_size") % 12 + 1).cast("double"), "s": (F.col("p_partkey") % 9 + 1).cast("double"), "h": (F.col("p_partkey") % 23).cast("double")})
    m = fl.maneuver_checks(F.col("s"), F.col("v"), F.col("h") - 3, F.lit(2.0), F.lit(3.0))
    x = fl.auto_fix(F.col("s"), F.col("v"), F.col("h"), F.lit(3.0), F.lit(2.0))
    return p.select("p_partkey", m.alias("m"), x.alias("x")).select("p_partkey", "m.*", "x.*")


def derating(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value"))
    d = fl.derating(F.col("v") / 40, F.col("v") % 360, (F.col("v") * 3) % 360, F.col("v") / 10, F.col("v") / 3, F.col("v") % 35)
    e = e.select("event_id", "v", d.alias("d"))
    product = F.col("d.wind") * F.col("d.altitude") * F.col("d.payload") * F.col("d.temperature")
    return e.select("event_id", "d.kind", F.round(product, 9).alias("factor"), fl.batteries(F.round(F.col("v") / 10 * product, 6), F.lit(18.0)).alias("batteries"))


def drift_and_air(spark, sf_dir):
    v = F.col("value")
    rho = rules.air_density(v % 40, v * 4, v / 300)
    amps = rules.hover_amps(v / 10, v % 5, rho, 0.7, 52.0, 2.0, 0.4)
    e = table(spark, sf_dir, "events")
    minutes = rules.endurance_minutes(rules.usable_capacity(F.lit(30.0), v * 10, v / 600), amps)
    return e.select("event_id", rules.drift_level(v / 50, v / 30).alias("drift"), F.round(rho, 9).alias("rho"), F.round(minutes, 6).alias("minutes"))


def sampling_zoom(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumns({"lat": F.col("s_nationkey") * 2.0 - 30, "lng": (F.col("s_suppkey") % 300) - 150.0, "d": (F.col("s_suppkey") % 17 + 1) / 500})
    z = fl.sampling_zoom(F.col("lat") + F.col("d"), F.col("lat"), F.col("lng") + F.col("d"), F.col("lng"), (F.col("s_suppkey") % 5 + 4).cast("double"), 20)
    return s.select("s_suppkey", z.alias("zoom"), fl.detail_level(F.col("s_suppkey") % 15, F.col("s_suppkey") * 100).alias("detail"))


def ninths(spark, sf_dir):
    """Mean index, range and verdict of each ninth of a field, per event type; sums of whole numbers."""
    e = table(spark, sf_dir, "events").withColumns({"i": F.floor(F.col("value") % 100).cast("long"), "y": F.col("event_id") % 97, "x": F.col("user_id") % 31})
    cell = fl.ninth(F.col("y"), F.col("x"), F.lit(97.0), F.lit(0.0), F.lit(31.0), F.lit(0.0))
    g = e.groupBy("event_type", cell.alias("cell")).agg(F.sum("i").alias("s"), F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"))
    return g.select("event_type", "cell", "n", "low", "high", fl.health_band(F.col("s") / F.col("n") / 100).alias("verdict"))


def mark_replay(spark, sf_dir):
    """Each user's marks after replaying events as clicks on a few cells, counted."""
    label = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type").isin("click", "view"), "wanted").otherwise("unwanted")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7).cast("string").alias("cell"), label.alias("label"))
    log = e.withColumn("action", F.when(F.col("label").isNull(), "unmark").otherwise("mark"))
    m = marks.replay(log, "user_id", "event_id").groupBy("user_id").agg(F.count_if(F.col("label") == "wanted").alias("w"), F.count_if(F.col("label") == "unwanted").alias("u"))
    w, u = (F.coalesce(c, F.lit(0)).cast("int") for c in ("w", "u"))
    return e.select("user_id").distinct().join(m, "user_id", "left").select("user_id", w.alias("wanted"), u.alias("unwanted"), fl.readiness(w, u).alias("message"))


def logged_litres(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rp.exact_sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("done"), rp.exact_sum(F.col("l_quantity")).alias("total"))
    return li.select("l_suppkey", fl.logged_litres(F.coalesce("done", F.lit(0.0)), F.col("total"), F.lit(12.5), F.col("l_suppkey") % 4).alias("litres"))


_G = "9.81::DOUBLE * tan(radians(25))"
_MPP = "cos(radians((lat + lat + d) / 2)) * (2 * pi() * 6378137.0::DOUBLE / 256 / (1 << z))"
QUERIES = {f.__name__: f for f in (pass_spacing, maneuvers, derating, drift_and_air, sampling_zoom, ninths, mark_replay, logged_litres)}
ORACLES = {
    "mark_replay": """WITH e AS (SELECT user_id, event_id, event_id % 7 AS cell, CASE WHEN event_type = 'error' THEN NULL WHEN event_type IN ('click', 'view') THEN 'wanted' ELSE 'unwanted' END AS label FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, cell ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, cell, label ORDER BY event_id) AS run, max(event_id) OVER (PARTITION BY user_id, cell) AS last FROM e),
        f AS (SELECT user_id, cell, label FROM r GROUP BY user_id, cell, label, run HAVING max(event_id) = any_value(last) AND count(*) % 2 = 1 AND label IS NOT NULL),
        c AS (SELECT user_id, CAST(count(*) FILTER (label = 'wanted') AS INTEGER) AS w, CAST(count(*) FILTER (label = 'unwanted') AS INTEGER) AS u FROM f RIGHT JOIN (SELECT DISTINCT user_id FROM events) USING (user_id) GROUP BY 1)
        SELECT user_id, w AS wanted, u AS unwanted, CASE WHEN w >= 3 AND u >= 3 THEN w || ' wanted · ' || u || ' not wanted'
            ELSE 'Mark ' || concat_ws(' and ', CASE WHEN w < 3 THEN (3 - w) || ' more to treat' END, CASE WHEN u < 3 THEN (3 - u) || ' more to leave' END) || '.' END AS message FROM c""",
    "pass_spacing": """WITH s AS (SELECT p_partkey, p_retailprice * 10 AS a, (CASE WHEN p_size > 5 THEN CAST(p_size - 5 AS DOUBLE) ELSE 6.0 END) * (p_size / 10) * (1 - greatest(0, least(0.5::DOUBLE, CASE WHEN p_size > 3 THEN p_size / 40 ELSE 0.1::DOUBLE END))) AS spacing FROM part)
        SELECT p_partkey, spacing, CASE WHEN a > 0 THEN greatest(0, CAST(ceil(a / (spacing * 50)) AS BIGINT) - 1) ELSE 0 END AS turns FROM s""",
    "maneuvers": f"""WITH p AS (SELECT p_partkey, CAST(p_size % 12 + 1 AS DOUBLE) AS v, CAST(p_partkey % 9 + 1 AS DOUBLE) AS s, CAST(p_partkey % 23 AS DOUBLE) AS h FROM part), b AS (SELECT *, s / 2 < v * v / ({_G}) AS bank, abs(h - 3) / 2 * v > s * 4 AS climb,
        CASE WHEN sqrt(s / 2 * {_G}) < v THEN greatest(3.0::DOUBLE, floor(sqrt(s / 2 * {_G}) * 2) / 2) ELSE v END AS transit_ms FROM p)
        SELECT p_partkey, NOT bank AND NOT climb AS ok, bank, climb, s / 2 < 3 AS tight, transit_ms, CASE WHEN abs(h - 3) / 2 * transit_ms > s * 4 THEN greatest(1.0::DOUBLE, floor((h - s * 4 * 2 / greatest(1, transit_ms)) * 2 + 0.5) / 2) ELSE 3.0::DOUBLE END AS spray_alt FROM b""",
    "derating": """WITH e AS (SELECT event_id, value AS v, abs(((value % 360 + 180) % 360 - (value * 3) % 360 + 540) % 360 - 180) AS off FROM events), a AS (SELECT *, abs(cos(radians(off))) AS al FROM e),
        f AS (SELECT *, (CASE WHEN v / 40 > 0.3 THEN 1 + v / 40 * 0.02::DOUBLE * (0.5 + 0.5 * al) ELSE 1 END) * (1 + v / 10 * 0.001::DOUBLE) * (1 + greatest(0, least(100, v / 3)) / 100 * 0.15::DOUBLE) * (CASE WHEN v % 35 < 15 THEN 1 + (15 - v % 35) * 0.01::DOUBLE ELSE 1 END) AS f FROM a)
        SELECT event_id, CASE WHEN v / 40 <= 0.3 THEN 'calm' WHEN al > 0.7 THEN 'headwind' WHEN al > 0.3 THEN 'crosswind' ELSE 'tailwind' END AS kind, round(f, 9) AS factor, greatest(1, CAST(ceil(round(v / 10 * f, 6) / 18 * 100 / 80) AS BIGINT)) AS batteries FROM f""",
    "drift_and_air": """WITH e AS (SELECT event_id, value AS v, value % 40 AS t FROM events), p AS (SELECT *, 101325 * pow(1 - 2.25577e-5::DOUBLE * greatest(0, v * 4), 5.25588::DOUBLE) AS p, greatest(0, least(1, v / 300)) * 610.78::DOUBLE * exp(17.27::DOUBLE * t / (t + 237.3::DOUBLE)) AS w FROM e),
        r AS (SELECT *, (p - w) / (287.058::DOUBLE * (t + 273.15::DOUBLE)) + w / (461.495::DOUBLE * (t + 273.15::DOUBLE)) AS rho FROM p), a AS (SELECT *, pow(greatest(1, v / 10) * 9.80665::DOUBLE, 1.5::DOUBLE) / sqrt(2 * greatest(rho, 0.3::DOUBLE) * 2) / 0.7::DOUBLE / 52 + 0.4::DOUBLE * (v % 5) AS amps FROM r)
        SELECT event_id, CASE WHEN v / 50 >= 12 * 0.44704::DOUBLE OR v / 30 >= 12 * 0.44704::DOUBLE + 2 THEN 'unsafe' WHEN v / 50 >= 10 * 0.44704::DOUBLE THEN 'caution' ELSE 'ok' END AS drift, round(rho, 9) AS rho,
        round(30 * greatest(0.6::DOUBLE, 1 - v * 10 / 1000 * 0.2::DOUBLE) * (1 - greatest(0, least(0.5::DOUBLE, v / 600))) / amps * 60, 6) AS minutes FROM a""",
    "sampling_zoom": f"""WITH s AS (SELECT s_suppkey, s_nationkey * 2.0::DOUBLE - 30 AS lat, (s_suppkey % 300) - 150.0::DOUBLE AS lng, (s_suppkey % 17 + 1) / 500 AS d, CAST(s_suppkey % 5 + 4 AS DOUBLE) AS cell FROM supplier),
        z AS (SELECT *, unnest(range(1, 21)) AS z FROM s), t AS (SELECT *, (floor((lng + d + 180) / 360 * (1 << z)) - floor((lng + 180) / 360 * (1 << z)) + 1) * (floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * (1 << z)) - floor((1 - ln(tan(radians(lat + d)) + 1 / cos(radians(lat + d))) / pi()) / 2 * (1 << z)) + 1) AS n, cell / ({_MPP}) >= 10 AS good FROM z)
        SELECT s_suppkey, CAST(least(coalesce(max(z) FILTER (n <= 64), 1), coalesce(min(z) FILTER (good), 99)) AS INTEGER) AS zoom, CASE WHEN s_suppkey % 15 < 3 THEN 'sparse' WHEN s_suppkey % 15 < 10 OR s_suppkey * 100 > 4000 THEN 'fill' ELSE 'outline' END AS detail FROM t GROUP BY s_suppkey""",
    "ninths": """WITH e AS (SELECT event_type, CAST(floor(value % 100) AS BIGINT) AS i, ['S', 'C', 'N'][least(2, CAST(floor((event_id % 97) / 97.0::DOUBLE * 3) AS INTEGER)) + 1] || ['W', 'C', 'E'][least(2, CAST(floor((user_id % 31) / 31.0::DOUBLE * 3) AS INTEGER)) + 1] AS c FROM events),
        g AS (SELECT event_type, CASE WHEN c = 'CC' THEN 'Center' ELSE c END AS cell, count(*) AS n, min(i) AS low, max(i) AS high, CAST(sum(i) AS BIGINT) / count(*) / 100 AS m FROM e GROUP BY 1, 2)
        SELECT event_type, cell, n, low, high, CASE WHEN m < 0.1 THEN 'bare soil / no vegetation' WHEN m < 0.3 THEN 'severely stressed' WHEN m < 0.5 THEN 'moderately stressed' WHEN m < 0.7 THEN 'moderate health' ELSE 'healthy canopy' END AS verdict FROM g""",
    "logged_litres": """SELECT l_suppkey, 12.5::DOUBLE * (l_suppkey % 4 + 1) * least(1, coalesce(CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) FILTER (l_returnflag = 'R') AS DOUBLE), 0) / CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE)) AS litres FROM lineitem GROUP BY 1""",
}
