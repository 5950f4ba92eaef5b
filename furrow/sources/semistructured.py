"""JSON columns with defaults: settings, stored grids, boundaries, forecasts, analysis zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.geo import point_in_ring, vertex_mean
from furrow.functions.rings import let
from furrow.functions.text import normalise_note, weather_icon, weather_text

POINT = "struct<lat: double, lng: double>"
RATE = "struct<state: string, source: string, rateLha: double, issue: string, note: string>"
ORIGIN = "struct<lat: double, lng: double>"
DEFINITION = f"struct<swathM: double, cellMultiple: double, headingRad: double, origin: {ORIGIN}, boundaryHash: string>"
DETECTION = "struct<modelVersion: string, scoredAt: string, cellIds: array<string>, scores: array<double>>"
SOURCES = ("default", "operator", "threshold")


def settings(raw: Column, defaults: dict[str, object]) -> Column:
    """Leaves of a settings blob over their defaults; unreadable blobs give the defaults. Nested names use dots."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return F.struct(*[
        F.coalesce(F.get_json_object(raw, f"$.{k}").try_cast(kinds[type(v)]), F.lit(v)).alias(k.replace(".", "_")) for k, v in defaults.items()
    ])


def stored_grid(raw: Column) -> Column:
    """A stored grid: definition, cell id -> rate, detection. Null without a sound definition.

    A malformed rate is dropped alone, hence each is read on its own; detection goes as a whole if its
    arrays differ in length, hold a null or lack their version. Blank issues and notes become null.
    """
    part = lambda text, name, kind: F.from_json(F.get_json_object(text, f"$.{name}"), kind)
    return let(raw, lambda text: let(part(text, "definition", DEFINITION), lambda d: let(part(text, "detection", DETECTION), lambda p: _grid(text, d, p))))


def _grid(raw: Column, d: Column, p: Column) -> Column:
    """The grid of a definition and a detection that were read once each."""
    sound = (d["swathM"] > 0) & d["cellMultiple"].isNotNull() & d["headingRad"].isNotNull() & d["boundaryHash"].isNotNull()
    sound = sound & d["origin"]["lat"].isNotNull() & d["origin"]["lng"].isNotNull()
    texts = F.from_json(F.get_json_object(raw, "$.rates"), "map<string, string>")
    read = F.transform_values(texts, lambda _, v: F.from_json(v, RATE))
    treated = lambda r: r["state"] == "treated"
    fit = lambda _, r: r["source"].isin(*SOURCES) & ((r["state"] == "untreated") | (treated(r) & (r["rateLha"] > 0)))
    rate = lambda _, r: F.struct(
        r["state"].alias("state"),
        r["source"].alias("source"),
        F.when(treated(r), r["rateLha"]).alias("rate_lha"),
        F.when(treated(r) & (F.trim(r["issue"]) != ""), r["issue"]).alias("issue"),
        F.when(treated(r), normalise_note(r["note"])).alias("note"),
    )
    rates = F.coalesce(F.transform_values(F.map_filter(read, fit), rate), F.create_map().cast("map<string, struct<state: string, source: string, rate_lha: double, issue: string, note: string>>"))
    ids, scores = p["cellIds"], p["scores"]
    whole = (F.size(ids) == F.size(scores)) & p["modelVersion"].isNotNull() & p["scoredAt"].isNotNull()
    whole = whole & ~F.exists(ids, lambda x: x.isNull()) & ~F.exists(scores, lambda x: x.isNull())
    detection = F.when(whole, F.struct(p["modelVersion"].alias("model_version"), p["scoredAt"].alias("scored_at"), ids.alias("cell_ids"), scores.alias("scores")))
    definition = F.struct(*[d[a].alias(b) for a, b in (("swathM", "swath_m"), ("cellMultiple", "cell_multiple"), ("headingRad", "heading_rad"), ("origin", "origin"), ("boundaryHash", "boundary_hash"))])
    return F.when(sound, F.struct(definition.alias("definition"), rates.alias("rates"), detection.alias("detection")))


def detection_rows(grids: DataFrame, grid: str, *keys: str) -> DataFrame:
    """(keys, cell_id, score) of the parallel detection arrays."""
    zipped = F.arrays_zip(F.col(f"{grid}.detection.cell_ids").alias("cell_id"), F.col(f"{grid}.detection.scores").alias("score"))
    return grids.select(*keys, F.inline(zipped))


def boundary(raw: Column) -> Column:
    """Rings of a boundary; one old-style ring becomes a list of one, and rings below three points go from lists."""
    many = F.from_json(raw, f"array<array<{POINT}>>")
    one = F.from_json(raw, f"array<{POINT}>")
    is_list = raw.rlike(r"^\s*\[\s*\[")
    return F.when(is_list, F.filter(many, lambda r: F.size(r) >= 3)).when(F.get(one, F.lit(0))["lat"].isNotNull(), F.array(one))


def pack_grid(cells: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """One map of decided cells a key; more than `most` are refused."""
    decided = cells.filter(~((F.col("rate.state") == "untreated") & (F.col("rate.source") == "default")))
    packed = decided.groupBy(key).agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("cell_id", "rate"))).alias("rates"))
    return packed.select(key, F.when(F.col("n") <= most, F.col("rates")).otherwise(F.raise_error(F.lit("too many grid records"))).alias("rates"))


_AT = "dt: bigint, humidity: double, wind_speed: double, wind_gust: double, wind_deg: double, pop: double, clouds: double, weather: array<struct<id: int, icon: string, description: string>>"
_FALL = "struct<`1h`: double>"
FEED = f"struct<hourly: array<struct<{_AT}, temp: double, rain: {_FALL}, snow: {_FALL}>>, daily: array<struct<{_AT}, temp: struct<min: double, max: double>, rain: double>>>"
_ARRAYS = "time: array<string>, wind_direction_10m: array<double>, weather_code: array<int>"
SPARE_FEED = (
    f"struct<hourly: struct<{_ARRAYS}, temperature_2m: array<double>, relative_humidity_2m: array<double>, wind_speed_10m: array<double>, wind_gusts_10m: array<double>, precipitation: array<double>, precipitation_probability: array<double>, cloud_cover: array<double>>, "
    "daily: struct<time: array<string>, temperature_2m_min: array<double>, temperature_2m_max: array<double>, wind_speed_10m_max: array<double>, wind_gusts_10m_max: array<double>, wind_direction_10m_dominant: array<double>, precipitation_sum: array<double>, precipitation_probability_max: array<double>, weather_code: array<int>>>"
)
HOURS, DAYS, KMH = 48, 7, 3.6


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _rows(n: Column, most: int, row) -> Column:
    """row(i) for the first of n places; none if n isn't positive."""
    last = F.least(F.coalesce(n, F.lit(0)), F.lit(most)) - 1
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), row)).otherwise(F.array())


def forecast(raw: Column) -> Column:
    """(hourly, daily) of the main feed: 48 hours and 7 days, wind from m/s to km/h, rain and snow of an hour summed, a missing amount is 0."""
    d = F.from_json(raw, FEED)

    def common(h: Column) -> list[Column]:
        sky = F.get(h["weather"], F.lit(0))
        return [
            (_or(h["wind_speed"], 0.0) * KMH).alias("wind_kmh"), (_or(h["wind_gust"], 0.0) * KMH).alias("gust_kmh"), _or(h["wind_deg"], 0.0).alias("wind_dir"),
            F.floor(_or(h["pop"], 0.0) * 100 + 0.5).cast("double").alias("precip_prob"), _or(h["clouds"], 0.0).alias("clouds"),
            _or(sky["id"], 800).alias("code"), _or(sky["icon"], "01d").alias("icon"), _or(sky["description"], "").alias("desc"),
        ]

    def hour(i: Column) -> Column:
        h = F.get(d["hourly"], i)
        fall = _or(h["rain"]["1h"], 0.0) + _or(h["snow"]["1h"], 0.0)
        return F.struct(i.alias("idx"), h["dt"].alias("time"), h["temp"].alias("temp_c"), h["humidity"].alias("humidity"), fall.alias("precip_mm"), *common(h))

    def day(i: Column) -> Column:
        h = F.get(d["daily"], i)
        return F.struct(i.alias("idx"), h["dt"].alias("time"), h["temp"]["min"].alias("tmin_c"), h["temp"]["max"].alias("tmax_c"), h["humidity"].alias("humidity"), _or(h["rain"], 0.0).alias("precip_mm"), *common(h))

    return F.struct(_rows(F.size(d["hourly"]), HOURS, hour).alias("hourly"), _rows(F.size(d["daily"]), DAYS, day).alias("daily"))


def forecast_spare(raw: Column) -> Column:
    """The same rows from the spare feed's parallel arrays, in km/h already: missing elements are 0 but for temperature and humidity.

    Times without a zone are read in the session's; days carry neither humidity nor clouds.
    """
    d = F.from_json(raw, SPARE_FEED)
    h, y = d["hourly"], d["daily"]
    when = lambda t: F.unix_timestamp(t.try_cast("timestamp"))

    def fields(src: Column, i: Column, names: dict[str, str]) -> list[Column]:
        code = _or(F.get(src["weather_code"], i), 0)
        return [*[_or(F.get(src[a], i), 0.0).alias(b) for b, a in names.items()], code.alias("code"), weather_icon(code).alias("icon"), weather_text(code).alias("desc")]

    def hour(i: Column) -> Column:
        names = {"precip_mm": "precipitation", "wind_kmh": "wind_speed_10m", "gust_kmh": "wind_gusts_10m", "wind_dir": "wind_direction_10m", "precip_prob": "precipitation_probability", "clouds": "cloud_cover"}
        return F.struct(i.alias("idx"), when(F.get(h["time"], i)).alias("time"), F.get(h["temperature_2m"], i).alias("temp_c"), F.get(h["relative_humidity_2m"], i).alias("humidity"), *fields(h, i, names))

    def day(i: Column) -> Column:
        names = {"precip_mm": "precipitation_sum", "wind_kmh": "wind_speed_10m_max", "gust_kmh": "wind_gusts_10m_max", "wind_dir": "wind_direction_10m_dominant", "precip_prob": "precipitation_probability_max"}
        nothing = [F.lit(None).cast("double").alias("humidity"), F.lit(0.0).alias("clouds")]
        return F.struct(i.alias("idx"), when(F.get(y["time"], i)).alias("time"), F.get(y["temperature_2m_min"], i).alias("tmin_c"), F.get(y["temperature_2m_max"], i).alias("tmax_c"), *nothing, *fields(y, i, names))

    return F.struct(_rows(F.size(h["time"]), HOURS, hour).alias("hourly"), _rows(F.size(y["time"]), DAYS, day).alias("daily"))


def radar_frames(past: Column, nowcast: Column) -> Column:
    """All frames in order, and where play starts: the last past frame."""
    return F.struct(F.concat(past, nowcast).alias("frames"), F.greatest(F.lit(0), F.size(past) - 1).alias("start"))


def repair_vertex(point: Column, box: Column) -> Column:
    """A vertex as given if the box holds it, else swapped, else taken as shares of the box; null if none fits."""
    slack = 1e-6
    holds = lambda lat, lng: lat.between(box["south"] - slack, box["north"] + slack) & lng.between(box["west"] - slack, box["east"] + slack)
    a, b = point[0], point[1]
    share = a.between(0, 1) & b.between(0, 1)
    made = F.struct((box["north"] - b * (box["north"] - box["south"])).alias("lat"), (box["west"] + a * (box["east"] - box["west"])).alias("lng"))
    return F.when(holds(a, b), F.struct(a.alias("lat"), b.alias("lng"))).when(holds(b, a), F.struct(b.alias("lat"), a.alias("lng"))).when(share, made)


#: Issues that an analysis may report, and confidences that are shown.
ISSUES = ("Bare soil", "Visible discoloration", "Waterlogging", "Row gap", "Boundary issue")
SHOWN = ("HIGH", "MEDIUM")
ANALYSIS = "struct<zones: array<struct<name: string, issue: string, what_you_see: string, confidence: string, severity: string, tier: string, coverage_pct: double, area_acres: double, recommendation: string, polygon: array<array<double>>>>>"


def analysis_zones(raw: Column, box: Column, rings: Column) -> Column:
    """Zones of a vision model's answer that may be shown; unreadable answers give none.

    Kept: an allowed issue, high or medium confidence, for tier 1 three sound vertices, and the vertex mean inside the
    field. Without a tier a zone with a polygon is tier 1, else it goes to the watch list, tier 2. Advice
    stays with high confidence only.
    """
    found = F.coalesce(F.from_json(raw, ANALYSIS)["zones"], F.array())

    def zone(z: Column, i: Column) -> Column:
        ring = F.filter(F.transform(F.coalesce(z["polygon"], F.array()), lambda p: F.when(F.size(p) == 2, repair_vertex(p, box))), lambda v: v.isNotNull())
        tier = F.when(z["tier"] == "2", 2).when(z["tier"] == "1", 1).when(F.size(z["polygon"]) >= 3, 1).otherwise(2)
        sure = F.upper(F.coalesce(z["confidence"], F.lit("")))
        return F.struct(
            F.concat(F.lit("ai-"), i.cast("string")).alias("id"), F.coalesce(z["name"], F.concat(F.lit("Zone "), (i + 1).cast("string"))).alias("name"), z["issue"].alias("issue"),
            _or(z["what_you_see"], "").alias("what_you_see"), sure.alias("confidence"), _or(z["severity"], "medium").alias("severity"), tier.alias("tier"),
            _or(z["coverage_pct"], 0.0).alias("coverage_pct"), _or(z["area_acres"], 0.0).alias("area_acres"), F.when(sure == "HIGH", z["recommendation"]).alias("recommendation"), ring.alias("ring"),
        )

    def keep(z: Column) -> Column:
        middle, drawn = vertex_mean(z["ring"]), F.size(z["ring"]) >= 3
        inside = F.exists(rings, lambda r: point_in_ring(middle["lat"], middle["lng"], r))
        return F.coalesce(z["issue"].isin(*ISSUES) & z["confidence"].isin(*SHOWN) & ((z["tier"] == 2) | drawn) & (~drawn | inside), F.lit(False))

    return F.filter(F.transform(found, zone), keep)


def classify_cell(rate: Column, issue: Column, has_issue: Column, note: Column, has_note: Column) -> Column:
    """A treated rate with issue and note patched: an absent field stays, a null or blank one is cleared. State, source and amount never change."""
    patched = rate.withField("issue", F.when(has_issue, F.nullif(F.trim(issue), F.lit(""))).otherwise(rate["issue"]))
    patched = patched.withField("note", F.when(has_note, normalise_note(note)).otherwise(rate["note"]))
    return F.when(rate["state"] == "treated", patched).otherwise(rate)


def fresh(rows: DataFrame, saved_at: str, now: Column, ttl_s: int) -> DataFrame:
    """Cache or checkpoint rows not older than the limit."""
    return rows.filter(F.unix_timestamp(now) - F.unix_timestamp(saved_at) <= ttl_s)


def one_or_none(rows: DataFrame, condition: Column) -> DataFrame:
    """At most one row; none is no error."""
    return rows.filter(condition).limit(1)
