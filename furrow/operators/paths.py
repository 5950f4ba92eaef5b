"""Ordered rows: lengths, timelines, interpolation, intervals, splits, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import geo


def ordered(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order)


def running(key: str, *order: str):
    return ordered(key, *order).rowsBetween(Window.unboundedPreceding, 0)


def hop_lengths(points: DataFrame, key: str, order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Append hop: the planar distance from the row before, 0 for the first."""
    w = ordered(key, *order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return points.withColumn("hop", F.coalesce(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(0.0)))


def polyline_length(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    return hop_lengths(points, key, order).groupBy(key).agg(F.sum("hop").alias("length"), F.count("*").alias("points"))


def timeline(points: DataFrame, key: str, order: list[str], speed: float, spraying: Column, least_hop: float = 0.1) -> DataFrame:
    """Append t_start, t_end and distance of the leg that ends in each row; hops below `least_hop` take no time, and
    the sprayer is as the last switch before the row left it."""
    w = running(key, *order)
    hops = hop_lengths(points, key, order).withColumn("leg", F.when(F.col("hop") >= least_hop, F.col("hop")).otherwise(F.lit(0.0)))
    state = F.last(F.when(spraying.isNotNull(), spraying), ignorenulls=True).over(w)
    out = hops.withColumn("distance", F.sum("leg").over(w)).withColumn("spraying", F.coalesce(state, F.lit(False)))
    return out.withColumns({"t_end": F.col("distance") / speed, "t_start": (F.col("distance") - F.col("leg")) / speed})


def split_on_gaps(points: DataFrame, key: str, order: list[str], longest: float) -> DataFrame:
    """Append fragment: it goes up where the hop is longer than allowed."""
    hops = hop_lengths(points, key, order)
    return hops.withColumn("fragment", F.sum((F.col("hop") > longest).cast("int")).over(running(key, *order)))


def merge_intervals(rows: DataFrame, key: str, start: str, end: str, touch: Column | None = None) -> DataFrame:
    """(key, start, end, n): intervals that overlap or touch become one. A new one begins where the start lies
    beyond all ends so far (plus the tolerance)."""
    so_far = F.max(end).over(ordered(key, start, end).rowsBetween(Window.unboundedPreceding, -1))
    reach = so_far + touch if touch is not None else so_far
    begins = F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))
    island = rows.withColumn("__b", begins).withColumn("__i", F.sum("__b").over(running(key, start, end)))
    return island.groupBy(key, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__i")


def alternate(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append reversed: every second emitted row of a key."""
    return rows.withColumn("reversed", F.row_number().over(ordered(key, *order)) % 2 == 0)


def last_at_or_before(probes: DataFrame, segments: DataFrame, key: str, at: str, start: str, *carry: str, strictly_open_end: bool = True) -> DataFrame:
    """Probes with the columns of the last segment that has begun; one sort of the union, no range join.

    At equal times a segment counts as begun (t_start <= t); for closed ends (t <= t_end) the probe goes first.
    """
    s = segments.select(F.col(key), F.col(start).alias("__t"), F.lit(0 if strictly_open_end else 1).alias("__o"), F.lit(True).alias("__s"), F.struct(*carry).alias("__c"))
    p = probes.select(F.col(key), F.col(at).alias("__t"), F.lit(1 if strictly_open_end else 0).alias("__o"), F.lit(False).alias("__s"), F.struct(*probes.columns).alias("__p"))
    both = s.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__f", F.last(F.when(F.col("__s"), F.col("__c")), ignorenulls=True).over(w)).filter(~F.col("__s"))
    return found.select("__p.*", *[F.col(f"__f.{c}").alias(c) for c in carry])


def interpolate(samples: DataFrame, key: str, t: str, value: str, step: float) -> DataFrame:
    """Values at multiples of `step` between the samples of a key, linear in between; (key, t, value)."""
    w = ordered(key, t)
    seg = samples.select(key, F.col(t).alias("t0"), F.lead(t).over(w).alias("t1"), F.col(value).alias("v0"), F.lead(value).over(w).alias("v1")).filter("t1 > t0")
    first, last = F.ceil(F.col("t0") / step), F.ceil(F.col("t1") / step) - 1
    at = seg.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return at.select(key, (F.col("k") * step).alias("t"), (F.col("v0") + (F.col("v1") - F.col("v0")) * share).alias("value"))


def at_fractions(legs: DataFrame, key: str, order: list[str], length: str, fractions: list[float], bins: int = 256) -> DataFrame:
    """The row in which each fraction of a key's total length falls: (key, fraction, *order).

    Lengths are summed by bins of the first order column, which is a number, before the shuffle; only the rows of the bin in
    which a fraction falls are sorted, so a key with very many rows isn't sorted by one task.
    """
    first = F.col(order[0]).cast("double")
    ends = legs.groupBy(key).agg(F.min(first).alias("__lo"), F.max(first).alias("__hi"))
    wide = F.when(F.col("__hi") > F.col("__lo"), F.floor((first - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins)).otherwise(F.lit(0))
    binned = legs.join(ends, key).withColumn("__bin", F.least(F.lit(bins - 1), wide).cast("int")).drop("__lo", "__hi")
    sums = binned.groupBy(key, "__bin").agg(F.sum(length).alias("__sum"))  # at most `bins` rows a key
    total = F.sum("__sum").over(Window.partitionBy(key))
    s = sums.withColumns({"__to": F.sum("__sum").over(running(key, "__bin")), "__total": total}).withColumn("fraction", F.explode(F.array(*[F.lit(x) for x in fractions])))
    target = F.col("fraction") * F.col("__total")
    s = s.filter((F.col("__to") >= target) & (F.col("__to") - F.col("__sum") < target)).select(key, "__bin", "fraction", target.alias("__target"), (F.col("__to") - F.col("__sum")).alias("__before"))
    near = binned.join(s, [key, "__bin"])
    hi = F.col("__before") + F.sum(length).over(Window.partitionBy(key, "__bin", "fraction").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    hit = near.withColumn("__reached", hi).filter((F.col("__reached") >= F.col("__target")) & (F.col("__reached") - F.col(length) < F.col("__target")))
    return hit.groupBy(key, "fraction").agg(F.min(F.struct(*order)).alias("m")).select(key, "fraction", *[f"m.{c}" for c in order])


def depletion(rows: DataFrame, level: Column, drain: Column, recall_at: float = 25.0, minutes: int = 60) -> DataFrame:
    """Append recall_minute: the first minute at which the level, to one decimal, is at the recall level."""
    series = F.sequence(F.lit(0), F.lit(minutes))
    left = lambda m: F.floor(F.greatest(F.lit(0.0), level - drain * m) * 10 + 0.5) / 10
    return rows.withColumn("recall_minute", F.array_min(F.filter(series, lambda m: left(m) <= recall_at)))


def month_grid(day: Column, week_start: int = 0) -> Column:
    """The 42 days that the calendar of a day's month shows; week_start 0 is Sunday."""
    first = F.trunc(day, "month")
    start = F.date_sub(first, F.pmod(F.dayofweek(first) - 1 - week_start, F.lit(7)).cast("int"))
    return F.sequence(start, F.date_add(start, 41))


def crossfade(position: Column, n: int) -> Column:
    """The two layers around a position and their weights; clamped, no loop."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), position))
    a = F.floor(p)
    b = F.least(a + 1, F.lit(n - 1))
    return F.struct(a.alias("a"), b.alias("b"), (1 - (p - a)).alias("weight_a"), F.when(b > a, p - a).otherwise(F.lit(0.0)).alias("weight_b"))


def mission_rows(passes: DataFrame, mission: str, order: str, home: tuple[float, float], spray_alt: float = 3.0, transit_alt: float = 15.0, spray_ms: float = 5.0, transit_ms: float = 8.0, least_connector: float = 0.5) -> DataFrame:
    """(mission, seq, action, lat, lng, alt, speed) of ordered passes (lat1, lng1, lat2, lng2, spray).

    The sprayer's state after a pass is that pass's own flag, so the whole machine is a look at the row before: a gap of more
    than `least_connector` metres is flown high with the sprayer off. Each mission starts and ends at home. A mission without
    passes has no rows.
    """
    w = ordered(mission, order)
    point = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lng"))
    base = F.struct(F.lit(float(home[0])).alias("lat"), F.lit(float(home[1])).alias("lng"))
    rows = passes.withColumns({"_a": point("lat1", "lng1"), "_b": point("lat2", "lng2"), "_s": F.coalesce("spray", F.lit(False))})
    rows = rows.withColumns({"_p": F.coalesce(F.lag("_b").over(w), base), "_on": F.coalesce(F.lag("_s").over(w), F.lit(False)), "_first": F.lag("_b").over(w).isNull(), "_last": F.lead("_b").over(w).isNull()})
    far = geo.planar_distance(F.col("_p.lat"), F.col("_p.lng"), F.col("_a.lat"), F.col("_a.lng")) > least_connector
    step = lambda action, at, alt, speed: F.struct(F.lit(action).alias("action"), at["lat"].alias("lat"), at["lng"].alias("lng"), F.lit(float(alt)).alias("alt"), F.lit(float(speed)).alias("speed"))
    high = lambda action, at: step(action, at, transit_alt, transit_ms)
    low = lambda action, at: step(action, at, spray_alt, spray_ms)
    p, a, b, spray = F.col("_p"), F.col("_a"), F.col("_b"), F.col("_s")
    on = F.col("_on") & ~far
    parts = [
        (F.col("_first"), [high("TAKEOFF", base)]),
        (far & F.col("_on"), [low("SPRAY_OFF", p)]),
        (far, [high("ALTITUDE_CHANGE", p), high("SPEED_CHANGE", p), high("TRANSIT", a)]),
        (spray & ~on, [low("ALTITUDE_CHANGE", a), low("SPEED_CHANGE", a), low("SPRAY_ON", a)]),
        (spray, [low("SPRAY_WP", b)]),
        (~spray & on, [low("SPRAY_OFF", a)]),
        (~spray, [high("ALTITUDE_CHANGE", a), high("SPEED_CHANGE", a), high("TRANSIT", b)]),
        (F.col("_last") & spray, [low("SPRAY_OFF", b)]),
        (F.col("_last"), [high("ALTITUDE_CHANGE", b), high("RTH", base), step("LAND", base, 0.0, 1.0)]),
    ]
    steps = F.concat(*[F.when(c, F.array(*s)).otherwise(F.array().cast("array<struct<action:string,lat:double,lng:double,alt:double,speed:double>>")) for c, s in parts])
    exploded = rows.select(mission, order, F.posexplode(steps).alias("_k", "_w"))
    return exploded.select(mission, (F.row_number().over(ordered(mission, order, "_k")) - 1).alias("seq"), "_w.*")


def reduce_waypoints(rows: DataFrame, mission: str, least_m: float = 0.5, least_alt: float = 0.01) -> DataFrame:
    """(mission, seq, lat, lng, alt, speed) of a camera route: flown points only, without those that lie at the place and height
    of the last one kept. A fold over one flight's waypoints, which its format bounds."""
    flown = rows.filter(F.col("action").isin("TRANSIT", "SPRAY_WP", "RTH"))
    way = flown.groupBy(mission).agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lng", "alt", "speed"))).alias("way"))

    def add(kept, w):
        last = F.try_element_at(kept, F.lit(-1))
        same = (F.abs(last["alt"] - w["alt"]) < least_alt) & (geo.planar_distance(last["lat"], last["lng"], w["lat"], w["lng"]) < least_m)
        return F.when(F.coalesce(same, F.lit(False)), kept).otherwise(F.concat(kept, F.array(w)))

    kept = F.aggregate("way", F.slice("way", 1, 0), add)
    return way.select(mission, F.posexplode(kept).alias("seq", "w")).select(mission, "seq", "w.lat", "w.lng", "w.alt", "w.speed")
