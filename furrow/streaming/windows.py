"""Streams of forecast hours (an extension): verdicts, sessions of green hours, rolling rain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.rules import SprayLimits, spray_verdict


def green_sessions(hours: DataFrame, gap: str = "90 minutes", late: str = "2 hours", limits: SprayLimits = SprayLimits()) -> DataFrame:
    """Sessions of green hours of a site, closed by the watermark; works on a stream and on a batch.

    Rain ahead must be a column already: a stream can't look at rows to come.
    """
    c = F.col
    v = spray_verdict(c("wind_kmh"), c("gust_kmh"), c("rain_next"), c("temp_c"), c("humidity"), limits)
    green = hours.withWatermark("time", late).filter(v == "green")
    s = green.groupBy("site_id", F.session_window("time", gap).alias("w")).agg(F.count("*").alias("hours"), F.max("time").alias("end_ts"))
    return s.select("site_id", F.col("w.start").alias("start_ts"), "end_ts", "hours")


def sliding_rain(hours: DataFrame, length: str = "6 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rain of each sliding window of event time."""
    w = F.window("time", length, step)
    rain = F.sum(F.col("precip_mm").cast("decimal(18,4)")).cast("double")
    return hours.withWatermark("time", late).groupBy("site_id", w.alias("w")).agg(rain.alias("rain_mm")).select("site_id", F.col("w.start").alias("start_ts"), "rain_mm")
