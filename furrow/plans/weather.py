"""Catalogue: time-series queries over events (users as sites, events as hours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import timeseries as ts
from furrow.session import table

NOW = "2024-01-15 00:00:00"


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as forecast hours: a measure split into wind, gust, rain and so on by exact arithmetic."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("value").cast("decimal(12,2)").alias("v"))
    return ts.hour_index(e, "user_id", "ts", "event_id").select(
        F.col("user_id").alias("site_id"),
        "idx",
        F.col("ts").alias("time"),
        (F.col("v") % 20).alias("wind_kmh"),
        (F.col("v") % 30).alias("gust_kmh"),
        F.when(F.col("v") % 7 < 1, F.col("v") % 7).otherwise(F.lit(0).cast("decimal(12,2)")).alias("precip_mm"),
        (8 + F.col("v") % 23).alias("temp_c"),
        (35 + F.col("v") % 40).alias("humidity"),
    )


HOURS_SQL = """
hours AS (
  SELECT user_id AS site_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts AS "time",
         v % 20 AS wind_kmh, v % 30 AS gust_kmh, CASE WHEN v % 7 < 1 THEN v % 7 ELSE 0 END AS precip_mm,
         8 + v % 23 AS temp_c, 35 + v % 40 AS humidity
  FROM (SELECT *, CAST(value AS DECIMAL(12,2)) AS v FROM events)
), judged AS (
  SELECT *, CASE
    WHEN wind_kmh > 16 OR gust_kmh > 24 OR rain_next > 0.5 OR temp_c < 10 THEN 'red'
    WHEN wind_kmh > 13 OR temp_c > 29 OR humidity < 40 OR humidity > 70 THEN 'yellow' ELSE 'green' END AS verdict
  FROM (SELECT *, sum(precip_mm) OVER (PARTITION BY site_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS rain_next FROM hours)
), runs AS (
  SELECT site_id, min("time") AS start_ts, max("time") AS end_ts, count(*) AS hours
  FROM (SELECT *, idx - row_number() OVER (PARTITION BY site_id ORDER BY idx) AS island FROM judged WHERE idx < 72 AND verdict = 'green')
  GROUP BY site_id, island HAVING count(*) >= 2
)"""


def _judged(spark, sf_dir):
    return ts.judge_hours(hours(spark, sf_dir))


def rolling_rain(spark, sf_dir):
    return ts.rain_ahead(hours(spark, sf_dir), "site_id", "idx", "precip_mm").select("site_id", "idx", F.col("rain_next").cast("double").alias("rain_next"))


def hour_verdict(spark, sf_dir):
    return _judged(spark, sf_dir).select("site_id", "idx", "verdict")


def verdict_reasons(spark, sf_dir):
    from furrow.functions.rules import spray_reasons

    c = F.col
    j = _judged(spark, sf_dir).withColumn("r", spray_reasons(c("wind_kmh"), c("gust_kmh"), c("rain_next"), c("temp_c"), c("humidity")))
    return j.select("site_id", "idx", F.size("r").alias("n_reasons"), F.get("r", F.lit(0))["kind"].alias("headline"), F.array_join("r.kind", ",").alias("kinds"))


def spray_windows(spark, sf_dir):
    return ts.spray_windows(_judged(spark, sf_dir))


def next_window(spark, sf_dir):
    return ts.next_window(ts.spray_windows(_judged(spark, sf_dir), horizon=1 << 30), F.lit(NOW).cast("timestamp"))


def _missions(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return e.select(F.col("event_id").alias("mission_id"), F.col("user_id").alias("site_id"), F.unix_timestamp("ts").alias("at"))


MISSION_SQL = "missions AS (SELECT event_id AS mission_id, user_id AS site_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE event_type = 'purchase')"


def asof_first_within(spark, sf_dir):
    h = _judged(spark, sf_dir).select("site_id", "idx", F.unix_timestamp("time").alias("t"), "verdict")
    m = ts.asof_first_within(_missions(spark, sf_dir), h, "site_id", "at", "t", "idx", 1800)
    return m.select("mission_id", "site_id", "at", F.col("r_idx").alias("idx"), F.col("r_verdict").alias("verdict"))


def mission_checks(spark, sf_dir):
    m = asof_first_within(spark, sf_dir)
    outcome = F.when(F.col("verdict").isNull(), "beyond_forecast").otherwise(F.col("verdict"))
    return m.select("mission_id", outcome.alias("outcome"))


def conflicts_only(spark, sf_dir):
    return asof_first_within(spark, sf_dir).filter(F.col("verdict") != "green").select("mission_id", "verdict")


def suggested_move(spark, sf_dir):
    """The first window that opens strictly after each mission that shouldn't fly."""
    bad = asof_first_within(spark, sf_dir).filter(F.col("verdict") != "green").select("mission_id", "site_id", "at")
    w = ts.spray_windows(_judged(spark, sf_dir), horizon=1 << 30).select("site_id", F.unix_timestamp("start_ts").alias("start_s"), F.unix_timestamp("end_ts").alias("end_s"))
    moved = ts.first_after(bad, w, "site_id", "at", "start_s", "start_s", "end_s")
    return moved.filter(F.col("start_s").isNotNull()).select("mission_id", "start_s", "end_s")


def mission_outcomes(spark, sf_dir):
    """Every third user is no site of the board, and purchases of other users may lie beyond their hours."""
    h = _judged(spark, sf_dir).select("site_id", "idx", F.unix_timestamp("time").alias("t"), "verdict")
    sites = h.select("site_id").filter("site_id % 3 > 0")
    return ts.mission_outcomes(_missions(spark, sf_dir), sites, h).select("mission_id", "site_known", "outcome")


def _board(spark, sf_dir):
    j = _judged(spark, sf_dir)
    sites = table(spark, sf_dir, "events").select(F.col("user_id").alias("site_id")).distinct().withColumn("name", F.format_string("site-%06d", "site_id"))
    return ts.outlooks(sites, j, ts.spray_windows(j, horizon=1 << 30), F.lit(NOW).cast("timestamp"))


def site_board(spark, sf_dir):
    return ts.board_order(_board(spark, sf_dir)).select("site_id", "name", "now_verdict", "start_ts", "hours_until", "k0", "k1")


def board_summary(spark, sf_dir):
    return ts.board_summary(_board(spark, sf_dir))


def condition_fallback(spark, sf_dir):
    """Hour, else day, else any reading, with the basis that matched."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.col("value").cast("decimal(12,2)").alias("v"))
    views = e.filter(F.col("event_type") == "view")
    hour = views.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.max("v").alias("hv"))
    day = views.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("v").alias("dv"))
    whole = views.groupBy("user_id").agg(F.max("v").alias("av"))
    m = e.filter(F.col("event_type") == "purchase").withColumns({"h": F.date_trunc("hour", "ts"), "d": F.to_date("ts")})
    j = m.join(hour, ["user_id", "h"], "left").join(day, ["user_id", "d"], "left").join(whole, "user_id", "left")
    basis = F.when(F.col("hv").isNotNull(), "hour").when(F.col("dv").isNotNull(), "day").when(F.col("av").isNotNull(), "current")
    return j.select("event_id", basis.alias("basis"), F.coalesce("hv", "dv", "av").cast("double").alias("reading"))


_W = "WITH " + HOURS_SQL
_ASOF = (
    f"{_W}, {MISSION_SQL}, matched AS (SELECT m.mission_id, m.site_id, m.at, h.idx, h.verdict FROM missions m LEFT JOIN (SELECT site_id, idx, verdict,"
    " CAST(floor(epoch(\"time\")) AS BIGINT) AS t FROM judged) h ON m.site_id = h.site_id AND abs(h.t - m.at) <= 1800"
    " QUALIFY row_number() OVER (PARTITION BY m.mission_id ORDER BY h.idx) = 1)"
)
_LONG = HOURS_SQL.replace("idx < 72 AND ", "")
_NEXT = (
    f"WITH {_LONG}, near AS (SELECT *, start_ts <= TIMESTAMP '{NOW}' AND end_ts >= TIMESTAMP '{NOW}' AS active FROM runs), nextw AS (SELECT site_id,"
    f" start_ts, end_ts, hours, active, greatest(0, CAST(floor((floor(epoch(start_ts)) - epoch(TIMESTAMP '{NOW}')) / 3600 + 0.5) AS BIGINT)) AS hours_until"
    f" FROM near WHERE active OR start_ts > TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY active DESC, start_ts) = 1)"
)
_BOARD = (
    _NEXT + ", board AS (SELECT s.site_id, printf('site-%06d', s.site_id) AS name, j.verdict AS now_verdict, w.start_ts, w.active, w.hours_until"
    " FROM (SELECT DISTINCT user_id AS site_id FROM events) s LEFT JOIN judged j ON j.site_id = s.site_id AND j.idx = 0 LEFT JOIN nextw w ON w.site_id = s.site_id)"
)

QUERIES = {
    f.__name__: f
    for f in (rolling_rain, hour_verdict, verdict_reasons, spray_windows, next_window, asof_first_within, mission_checks, conflicts_only, suggested_move, mission_outcomes, site_board, board_summary, condition_fallback)
}
ORACLES = {
    "rolling_rain": f"{_W} SELECT site_id, idx, CAST(rain_next AS DOUBLE) AS rain_next FROM judged",
    "hour_verdict": f"{_W} SELECT site_id, idx, verdict FROM judged",
    "verdict_reasons": _W + """, r AS (SELECT site_id, idx, list_filter([CASE WHEN wind_kmh > 16 THEN 'wind' END, CASE WHEN gust_kmh > 24 THEN 'gust' END,
        CASE WHEN rain_next > 0.5 THEN 'rain' END, CASE WHEN temp_c < 10 THEN 'cold' END], lambda x: x IS NOT NULL) AS hard,
        list_filter([CASE WHEN wind_kmh > 13 THEN 'wind' END, CASE WHEN temp_c > 29 THEN 'hot' END, CASE WHEN humidity < 40 THEN 'humidity-low' END,
        CASE WHEN humidity > 70 THEN 'humidity-high' END], lambda x: x IS NOT NULL) AS soft FROM judged),
        k AS (SELECT site_id, idx, CASE WHEN len(hard) > 0 THEN hard ELSE soft END AS k FROM r)
        SELECT site_id, idx, CAST(len(k) AS INTEGER) AS n_reasons, k[1] AS headline, array_to_string(k, ',') AS kinds FROM k""",
    "spray_windows": f"{_W} SELECT site_id, start_ts, end_ts, hours FROM runs",
    "next_window": _NEXT + " SELECT * FROM nextw",
    "asof_first_within": _ASOF + " SELECT * FROM matched",
    "mission_checks": _ASOF + " SELECT mission_id, coalesce(verdict, 'beyond_forecast') AS outcome FROM matched",
    "mission_outcomes": _ASOF + """ , k AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 > 0) SELECT mission_id, k.user_id IS NOT NULL AS site_known, CASE WHEN k.user_id IS NULL THEN 'no_site' ELSE coalesce(verdict, 'beyond_forecast') END AS outcome FROM matched LEFT JOIN k ON k.user_id = site_id""",
    "conflicts_only": _ASOF + " SELECT mission_id, verdict FROM matched WHERE verdict <> 'green'",
    "suggested_move": _ASOF.replace("idx < 72 AND ", "") + """ SELECT mission_id, CAST(floor(epoch(min(start_ts))) AS BIGINT) AS start_s,
        CAST(floor(epoch(arg_min(end_ts, start_ts))) AS BIGINT) AS end_s FROM matched JOIN runs USING (site_id)
        WHERE verdict <> 'green' AND floor(epoch(start_ts)) > "at" GROUP BY mission_id""",
    "site_board": _BOARD + """ SELECT site_id, name, now_verdict, start_ts, hours_until,
        CAST(CASE WHEN now_verdict IS NULL THEN 2 WHEN active THEN 0 WHEN start_ts IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS k0,
        CAST(CASE WHEN now_verdict IS NULL THEN 0 WHEN active THEN (CASE now_verdict WHEN 'green' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END)
        WHEN start_ts IS NOT NULL THEN floor(epoch(start_ts)) ELSE 1 END AS BIGINT) AS k1 FROM board""",
    "board_summary": _BOARD + """ SELECT count(*) AS total, count(*) FILTER (now_verdict IS NOT NULL AND coalesce(active, false)) AS sprayable_now,
        count(*) FILTER (now_verdict IS NOT NULL AND NOT coalesce(active, false) AND coalesce(hours_until <= 24, false)) AS opening_soon,
        count(*) FILTER (now_verdict IS NOT NULL AND NOT coalesce(active, false) AND NOT coalesce(hours_until <= 24, false)) AS no_window,
        count(*) FILTER (now_verdict IS NULL) AS unavailable FROM board""",
    "condition_fallback": """WITH v AS (SELECT user_id, ts, CAST(value AS DECIMAL(12,2)) AS v FROM events WHERE event_type = 'view'),
        h AS (SELECT user_id, date_trunc('hour', ts) AS h, max(v) AS hv FROM v GROUP BY ALL), d AS (SELECT user_id, CAST(ts AS DATE) AS d, max(v) AS dv FROM v GROUP BY ALL),
        a AS (SELECT user_id, max(v) AS av FROM v GROUP BY ALL)
        SELECT event_id, CASE WHEN hv IS NOT NULL THEN 'hour' WHEN dv IS NOT NULL THEN 'day' WHEN av IS NOT NULL THEN 'current' END AS basis,
        CAST(coalesce(hv, dv, av) AS DOUBLE) AS reading FROM events e LEFT JOIN h ON h.user_id = e.user_id AND h.h = date_trunc('hour', e.ts)
        LEFT JOIN d ON d.user_id = e.user_id AND d.d = CAST(e.ts AS DATE) LEFT JOIN a ON a.user_id = e.user_id WHERE event_type = 'purchase'""",
}
