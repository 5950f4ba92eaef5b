"""String, hash and formatting functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a, 32 bits. Fixed values.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def fnv1a(text: Column, start: Column | None = None) -> Column:
    """Hash of an ASCII text as a long below 2^32."""
    h0 = F.lit(FNV_OFFSET).cast("long") if start is None else start
    step = lambda h, i: ((h.bitwiseXOR(F.ascii(F.substring(text, i, F.lit(1))))) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.when(F.length(text) > 0, F.aggregate(F.sequence(F.lit(1), F.length(text)), h0, step)).otherwise(h0)


def base36(number: Column, width: int = 0) -> Column:
    text = F.lower(F.conv(number.cast("string"), 10, 36))
    return F.lpad(text, width, "0") if width else text


def grid_id(*parts: Column) -> Column:
    """Seven characters that stand for a grid's definition."""
    return base36(fnv1a(F.concat_ws("|", *parts)), 7)


def cell_id(grid: Column, col: Column, row: Column) -> Column:
    return F.concat_ws(":", grid, col, row)


def parse_cell_id(text: Column) -> Column:
    """(grid, col, row) of exactly three parts with whole numbers, else null."""
    p = F.split(text, ":")
    col, row = F.element_at(p, 2).try_cast("int"), F.element_at(p, 3).try_cast("int")
    return F.when((F.size(p) == 3) & col.isNotNull() & row.isNotNull(), F.struct(F.element_at(p, 1).alias("grid"), col.alias("col"), row.alias("row")))


def normalise_note(note: Column, longest: int = 200) -> Column:
    """Trimmed, then cut, then null if empty."""
    return F.nullif(F.substring(F.trim(note), 1, longest), F.lit(""))


def escape_markup(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def compass(degrees: Column) -> Column:
    at = F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), at + 1)


def currency(code: Column, default: str = "USD") -> Column:
    return F.when(code.rlike("^[A-Z]{3}$"), code).otherwise(F.lit(default))


def url_parts(url: Column) -> Column:
    """Scheme, host, path and query of a URL."""
    at = lambda i: F.nullif(F.regexp_extract(url, r"^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?", i), F.lit(""))
    return F.struct(at(1).alias("scheme"), at(2).alias("host"), at(3).alias("path"), at(4).alias("query"))


def growth_stage(crop: Column, planted: Column, now: Column) -> Column:
    """Weeks since planting and a coarse stage; null before planting or without a date."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(planted.cast("timestamp"))) / 86400)
    week = F.floor(days / 7 + 0.5)
    c = F.lower(crop)
    say = lambda stage: F.concat(F.lit("~"), week.cast("string"), F.lit(f" weeks ({stage})"))
    small = F.when(week < 4, say("emergence / tillering")).when(week < 10, say("tillering / stem extension")).when(week < 16, say("heading / flowering")).otherwise(say("grain fill / ripening"))
    maize = F.when(week < 4, say("V1–V4")).when(week < 10, say("V6–V12")).when(week < 14, say("tasseling / silking")).otherwise(say("grain fill / dent"))
    other = F.concat(F.lit("~"), week.cast("string"), F.lit(" weeks since planting"))
    return F.when(days >= 0, F.when(c.isin("wheat", "barley", "oats", "rye"), small).when(c == "corn", maize).otherwise(other))


def day_key(time: Column, tz: str = "UTC") -> Column:
    """The local day, not the UTC one."""
    return F.date_format(F.from_utc_timestamp(time, tz), "yyyy-MM-dd")


def file_key(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws(":", name, size, modified)


def cell_paint(state: Column, source: Column, rate: Column, low: Column, high: Column) -> Column:
    """(fill, stroke) of a cell. Treated ones go from yellow to red by rate, with the top colour where all rates are
    equal, and a stronger edge where an operator set them; others are undecided (default) or skipped, without colour."""
    t = F.when(high > low, (rate - low) / (high - low)).otherwise(F.lit(1.0))
    rgb = F.concat_ws(",", F.lit("250"), F.floor(204 - 150 * t + 0.5).cast("string"), F.floor(61 - 40 * t + 0.5).cast("string"))
    shade = lambda alpha: F.concat(F.lit("rgba("), rgb, F.lit(","), alpha, F.lit(")"))
    edge = shade(F.when(source == "operator", "0.95").otherwise(F.lit("0.55")))
    treated = state == "treated"
    kind = F.when(treated, "treated").when(source == "default", "undecided").otherwise(F.lit("skipped"))
    return F.struct(kind.alias("kind"), F.when(treated, shade(F.format_string("%.3f", 0.30 + 0.35 * t))).alias("fill"), F.when(treated, edge).alias("stroke"))


#: The largest code of each kind of weather, its text and its icon; beyond the last one it thunders.
WEATHER_CODES = (
    (0, "clear sky", "01d"), (2, "mainly clear", "02d"), (3, "overcast", "04d"), (48, "fog", "50d"), (57, "drizzle", "09d"),
    (67, "rain", "10d"), (77, "snow", "13d"), (82, "rain showers", "09d"), (86, "snow showers", "13d"),
)
STORM = ("thunderstorm", "11d")


def _by_code(code: Column, at: int) -> Column:
    out = F.lit(STORM[at - 1])
    for row in reversed(WEATHER_CODES):
        out = F.when(code <= row[0], row[at]).otherwise(out)
    return out


def weather_text(code: Column) -> Column:
    """Description of a weather code; the first upper bound that holds wins."""
    return _by_code(code, 1)


def weather_icon(code: Column) -> Column:
    return _by_code(code, 2)


def boundary_hash(rings: Column) -> Column:
    """Fingerprint of an outline at about a centimetre: each vertex to seven decimals, an underscore after each ring; not padded."""
    vertex = lambda p: F.format_string("%.7f,%.7f;", p["lat"], p["lng"])
    text = F.array_join(F.transform(rings, lambda r: F.concat(F.array_join(F.transform(r, vertex), ""), F.lit("_"))), "")
    return base36(fnv1a(text))


def money(amount: Column, code: Column, digits: int = 2) -> Column:
    """An amount with its currency's code; locales and symbols are left to the screen."""
    return F.concat(F.format_string(f"%.{digits}f", amount.cast("double")), F.lit(" "), code)


def place_key(kind: str, lat: Column, lng: Column) -> Column:
    """Key of what is stored for a place, to three decimals."""
    return F.concat(F.lit(kind + ":"), F.format_string("%.3f", lat), F.lit(","), F.format_string("%.3f", lng))


def reason_text(reason: Column) -> Column:
    """One reason against spraying as a sentence, in metric units (wind in km/h)."""
    v, limit, kind = reason["value"], reason["limit"], reason["kind"]
    n = lambda x, d: F.format_string(f"%.{d}f", x)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    whole = F.floor(v + 0.5).cast("string")
    return (
        F.when((kind == "wind") & (reason["severity"] == "hard"), say("Wind ", n(v, 1), " km/h, over the ", n(limit, 1), " km/h limit"))
        .when(kind == "wind", say("Wind ", n(v, 1), " km/h, close to the ", n(limit, 1), " km/h limit"))
        .when(kind == "gust", say("Gusts ", n(v, 1), " km/h, over the ", n(limit, 1), " km/h limit"))
        .when(kind == "rain", say(n(v, 1), " mm of rain due within 6 hours"))
        .when(kind == "cold", say("Too cold at ", n(v, 0), " \u00b0C, minimum ", n(limit, 0), " \u00b0C"))
        .when(kind == "hot", say("Warm at ", n(v, 0), " \u00b0C, evaporation and drift risk"))
        .when(kind == "humidity-low", say("Humidity ", whole, "%, below the ", n(limit, 0), "% target"))
        .when(kind == "humidity-high", say("Humidity ", whole, "%, above the ", n(limit, 0), "% target"))
    )
