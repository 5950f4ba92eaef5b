"""Ordered hourly rows: rain ahead, verdicts, windows, as-of matching, site boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.rules import SprayLimits, spray_verdict, verdict_rank


def rain_ahead(hours: DataFrame, site: str, idx: str, precip: str, out: str = "rain_next", ahead: int = 6) -> DataFrame:
    """Sum of this and the next rows' rain; short at the tail, null counts as nothing."""
    frame = Window.partitionBy(site).orderBy(idx).rowsBetween(0, ahead - 1)
    return hours.withColumn(out, F.coalesce(F.sum(F.coalesce(F.col(precip), F.lit(0).cast(hours.schema[precip].dataType))).over(frame), F.lit(0)))


def hour_index(rows: DataFrame, site: str, *order: str) -> DataFrame:
    """Number each site's rows from 0: operators below go by position, not by time."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy(site).orderBy(*order)) - 1)


def judge_hours(hours: DataFrame, limits: SprayLimits = SprayLimits(), site: str = "site_id", idx: str = "idx") -> DataFrame:
    """Append rain_next and verdict to (site, idx, temp_c, humidity, wind_kmh, gust_kmh, precip_mm)."""
    rained = rain_ahead(hours, site, idx, "precip_mm")
    c = F.col
    return rained.withColumn("verdict", spray_verdict(c("wind_kmh"), c("gust_kmh"), c("rain_next"), c("temp_c"), c("humidity"), limits))


def spray_windows(judged: DataFrame, site: str = "site_id", idx: str = "idx", time: str = "time", min_hours: int = 2, horizon: int = 72) -> DataFrame:
    """Runs of green rows within the first `horizon` rows, of at least `min_hours`.

    A run is a set of rows whose index less their rank among green rows is the same: one sort a site
    serves both. A run that is open at the horizon counts.
    """
    green = judged.filter((F.col(idx) < horizon) & (F.col("verdict") == "green"))
    island = green.withColumn("island", F.col(idx) - F.row_number().over(Window.partitionBy(site).orderBy(idx)))
    runs = island.groupBy(site, "island").agg(F.min(time).alias("start_ts"), F.max(time).alias("end_ts"), F.count("*").alias("hours"))
    return runs.filter(F.col("hours") >= min_hours).drop("island")


def next_window(windows: DataFrame, now: Column, site: str = "site_id") -> DataFrame:
    """Per site the window that is open now, else the first that opens later, and the whole hours until then."""
    active = (F.col("start_ts") <= now) & (F.col("end_ts") >= now)
    near = windows.withColumn("active", active).filter(active | (F.col("start_ts") > now))
    first = near.groupBy(site).agg(F.min_by(F.struct("start_ts", "end_ts", "hours", "active"), F.struct(~F.col("active"), "start_ts")).alias("w"))
    until = F.greatest(F.lit(0), F.floor((F.unix_timestamp("w.start_ts") - F.unix_timestamp(now)) / 3600 + 0.5))
    return first.select(site, "w.start_ts", "w.end_ts", "w.hours", "w.active", until.alias("hours_until"))


def outlooks(sites: DataFrame, judged: DataFrame, windows: DataFrame, now: Column, site: str = "site_id") -> DataFrame:
    """One row a site: the verdict of its first hour and its next window, if there are any."""
    first = judged.filter(F.col("idx") == 0).select(site, F.col("verdict").alias("now_verdict"))
    return sites.join(first, site, "left").join(next_window(windows, now, site), site, "left")


def board_order(rows: DataFrame, name: str = "name", error: str | None = None) -> DataFrame:
    """What to act on first: open windows, then those opening soonest, then none, then failures."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    k0 = F.when(failed, 3).when(F.col("now_verdict").isNull(), 2).when(F.col("active"), 0).when(F.col("start_ts").isNotNull(), 1).otherwise(2)
    k1 = (
        F.when(failed | F.col("now_verdict").isNull(), F.lit(0))
        .when(F.col("active"), verdict_rank(F.col("now_verdict")))
        .when(F.col("start_ts").isNotNull(), F.unix_timestamp("start_ts"))
        .otherwise(F.lit(1))
    )
    return rows.withColumns({"k0": k0, "k1": k1.cast("long")}).orderBy("k0", "k1", name)


def board_summary(rows: DataFrame, soon_hours: int = 24, error: str | None = None) -> DataFrame:
    """Four exclusive counts in one row."""
    failed = (F.col(error).isNotNull() if error else F.lit(False)) | F.col("now_verdict").isNull()
    active = ~failed & F.coalesce("active", F.lit(False))
    soon = ~failed & ~active & F.coalesce(F.col("hours_until") <= soon_hours, F.lit(False))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(active).alias("sprayable_now"),
        F.count_if(soon).alias("opening_soon"),
        F.count_if(~failed & ~active & ~soon).alias("no_window"),
        F.count_if(failed).alias("unavailable"),
    )


def asof_first_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_idx: str, tolerance_s: int) -> DataFrame:
    """Left rows with the first right row, in array order, within the tolerance.

    The range condition becomes an equi-join on time buckets of twice the tolerance: a right row
    stands in each bucket it can match from, so the shuffle is on (key, bucket), not on key alone.
    Left rows must be unique; those without a match are kept with nulls.
    """
    width = 2 * tolerance_s + 1
    lt, rt = F.col(left_time).cast("double"), F.col(right_time).cast("double")
    l = left.withColumn("__b", F.floor(lt / width))
    reach = F.array_distinct(F.array(F.floor((rt - tolerance_s) / width), F.floor(rt / width), F.floor((rt + tolerance_s) / width)))
    r = right.withColumn("__rb", F.explode(reach)).select("__rb", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    rt2 = F.col(f"r_{right_time}").cast("double")
    hit = l.join(r, (l[key] == r[f"r_{key}"]) & (F.col("__b") == F.col("__rb")) & (F.abs(lt - rt2) <= tolerance_s))
    first = hit.groupBy(*left.columns).agg(F.min_by(F.struct(*[f"r_{c}" for c in right.columns]), F.col(f"r_{right_idx}")).alias("__m"))
    return left.join(first, left.columns, "left").select(*left.columns, *[F.col(f"__m.r_{c}").alias(f"r_{c}") for c in right.columns])


def conditions_at(missions: DataFrame, hourly: DataFrame, daily: DataFrame, current: DataFrame, site: str = "site_id", at: str = "at") -> DataFrame:
    """Missions with wind_ms, temp_c, sky and their basis: the first hour within half an hour, else the calendar day, else what it is now.

    `hourly` has (site, idx, time, temp_c, wind_kmh, desc) and `daily` (site, time, tmin_c, tmax_c, wind_kmh, desc), times in epoch seconds;
    a day's stamp is UTC midnight, a mission's day is the session's. `current` has one row a site. available is
    false where only current conditions or nothing matched.
    """
    near = asof_first_within(missions, hourly, site, at, "time", "idx", 1800)
    first = daily.groupBy(site, F.to_date(F.timestamp_seconds("time")).alias("_day")).agg(F.min_by(F.struct("tmin_c", "tmax_c", "wind_kmh", "desc"), "time").alias("_d"))
    now = current.select(site, F.struct("temp_c", "wind_kmh", "desc").alias("_c"))
    j = near.withColumn("_day", F.to_date(F.timestamp_seconds(at))).join(first, [site, "_day"], "left").join(now, site, "left")
    has = {"hour": F.col("r_time").isNotNull(), "day": F.col("_d").isNotNull(), "current": F.lit(True)}

    def pick(hour: Column, day: Column, cur: Column) -> Column:
        found = F.when(has["hour"], hour).when(has["day"], day).otherwise(cur)
        return F.when(F.col("_c").isNotNull(), found)

    wind = lambda c: F.coalesce(c, F.lit(0.0)) / 3.6
    basis = F.when(F.col("_c").isNull(), "none").when(has["hour"] | has["day"], "forecast").otherwise("current")
    return j.select(
        *missions.columns,
        basis.alias("basis"),
        (basis == "forecast").alias("available"),
        pick(wind(F.col("r_wind_kmh")), wind(F.col("_d.wind_kmh")), wind(F.col("_c.wind_kmh"))).alias("wind_ms"),
        pick(F.col("r_temp_c"), (F.col("_d.tmin_c") + F.col("_d.tmax_c")) / 2, F.col("_c.temp_c")).alias("temp_c"),
        pick(F.col("r_desc"), F.col("_d.desc"), F.col("_c.desc")).alias("sky"),
    )


def mission_outcomes(missions: DataFrame, sites: DataFrame, hours: DataFrame, site: str = "site_id", at: str = "at") -> DataFrame:
    """Missions with site_known, outcome (no_site, beyond_forecast or the hour's verdict): not knowing where, not knowing yet and
    knowing are three different things. A site without hours counts as unknown, as does a mission without a time."""
    known = hours.select(site).distinct().join(sites.select(site).distinct(), site, "left_semi").withColumn("__known", F.lit(True))
    near = asof_first_within(missions, hours, site, at, "t", "idx", 1800).join(known, site, "left")
    lost = F.col("__known").isNull() | F.col(at).isNull()
    outcome = F.when(lost, "no_site").when(F.col("r_idx").isNull(), "beyond_forecast").otherwise(F.col("r_verdict"))
    return near.select(*missions.columns, (~lost).alias("site_known"), outcome.alias("outcome"))


def first_after(probes: DataFrame, events: DataFrame, key: str, at: str, start: str, *carry: str) -> DataFrame:
    """Probes with the columns of the first event that starts strictly later; one sort of the union, no range join.

    Running backwards in time, the last event seen is the next one.
    """
    e = events.select(F.col(key), F.col(start).alias("__t"), F.lit(True).alias("__e"), F.struct(*carry).alias("__c"))
    p = probes.select(F.col(key), F.col(at).alias("__t"), F.lit(False).alias("__e"), F.struct(*probes.columns).alias("__p"))
    # At equal times the probe comes after the event in time, so that the event isn't later than it.
    w = Window.partitionBy(key).orderBy(F.col("__t").desc(), F.col("__e").asc()).rowsBetween(Window.unboundedPreceding, 0)
    found = e.unionByName(p, allowMissingColumns=True).withColumn("__f", F.last(F.when(F.col("__e"), F.col("__c")), ignorenulls=True).over(w))
    return found.filter(~F.col("__e")).select("__p.*", "__f.*")
