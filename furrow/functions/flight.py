"""Flight planning rules as Column expressions: spacing, maneuvers, derating, turns, zoom and detail levels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions import geo

#: Bank angle and gravity of the turn rule, usable battery, tile budget, screen thresholds.
GRAVITY, BANK_TAN, USABLE_PCT, MAX_TILES = 9.81, math.tan(math.radians(25)), 80.0, 64
SPARSE_PX, OUTLINE_PX, MAX_STROKED = 3, 10, 4_000


def covered_swath(swath: Column, spread: Column, default_swath: float = 6.0, default_spread: float = 1.0) -> Column:
    """Swath times spread; values that are missing or not positive fall back."""
    positive = lambda c, d: F.when(c > 0, c).otherwise(F.lit(d))
    return positive(swath, default_swath) * positive(spread, default_spread)


def pass_spacing(swath: Column, spread: Column, overlap: Column, default_overlap: float = 0.1) -> Column:
    """Covered swath less the overlap, clamped to 0..0.5."""
    return covered_swath(swath, spread) * (1 - geo.clamp(F.coalesce(overlap, F.lit(default_overlap)), 0.0, 0.5))


def maneuver_checks(spacing: Column, transit_ms: Column, rise_m: Column, climb_ms: Column, turn_radius: Column) -> Column:
    """Whether bank and climb fit the row end; a tight turn is a note, not a failure."""
    bank = transit_ms * transit_ms / (GRAVITY * BANK_TAN)
    run = F.abs(rise_m) / F.greatest(F.lit(0.5), climb_ms) * transit_ms
    fails_bank, fails_climb = spacing / 2 < bank, run > spacing * 4
    return F.struct((~fails_bank & ~fails_climb).alias("ok"), fails_bank.alias("bank"), fails_climb.alias("climb"), (spacing / 2 < turn_radius).alias("tight"))


def auto_fix(spacing: Column, transit_ms: Column, transit_alt: Column, spray_alt: Column, climb_ms: Column) -> Column:
    """Transit speed and spray altitude that pass, in steps of a half; spacing is never touched."""
    most = F.sqrt(spacing / 2 * GRAVITY * BANK_TAN)
    speed = F.when(most < transit_ms, F.greatest(F.lit(3.0), F.floor(most * 2) / 2)).otherwise(transit_ms)
    run = F.abs(transit_alt - spray_alt) / F.greatest(F.lit(0.5), climb_ms) * speed
    allowed = spacing * 4 * climb_ms / F.greatest(F.lit(1.0), speed)
    alt = F.when(run > spacing * 4, F.greatest(F.lit(1.0), F.floor((transit_alt - allowed) * 2 + 0.5) / 2)).otherwise(spray_alt)
    return F.struct(speed.alias("transit_ms"), alt.alias("spray_alt"))


def derating(wind_ms: Column, wind_from: Column, bearing: Column, altitude_m: Column, tank_pct: Column, temp_c: Column) -> Column:
    """Factors on flight time: wind along the pass counts whole, across it half; altitude, load and cold follow."""
    off = F.abs(((wind_from + 180) % 360 - bearing + 540) % 360 - 180)
    along = F.abs(F.cos(F.radians(F.coalesce(off, F.lit(90.0)))))
    wind = F.when(wind_ms > 0.3, 1 + wind_ms * 0.02 * (0.5 + 0.5 * along)).otherwise(F.lit(1.0))
    kind = F.when(F.coalesce(wind_ms, F.lit(0.0)) <= 0.3, "calm").when(along > 0.7, "headwind").when(along > 0.3, "crosswind").otherwise("tailwind")
    load = 1 + geo.clamp(tank_pct, 0.0, 100.0) / 100 * 0.15
    t = F.coalesce(temp_c, F.lit(20.0))
    cold = F.when(t < 15, 1 + (15 - t) * 0.01).otherwise(F.lit(1.0))
    return F.struct(wind.alias("wind"), kind.alias("kind"), (1 + altitude_m * 0.001).alias("altitude"), load.alias("payload"), cold.alias("temperature"))


def batteries(minutes: Column, max_minutes: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(minutes / F.greatest(F.lit(1.0), max_minutes) * 100 / USABLE_PCT))


def turns(area: Column, swath: Column, row_length: Column) -> Column:
    """One less than the rows that cover the area; 0 where an input is not positive."""
    rows = F.ceil(area / (swath * row_length))
    return F.when((area > 0) & (swath > 0) & (row_length > 0), F.greatest(F.lit(0), rows - 1)).otherwise(F.lit(0))


def turn_seconds(n: Column, speed: Column, pivot_s: float = 2.0, slow_ms2: float = 2.5) -> Column:
    """Slowing, speeding up and pivoting in each turn."""
    return F.when((n > 0) & (speed > 0), n * (speed / max(0.5, slow_ms2) * 2 + pivot_s)).otherwise(F.lit(0.0))


def detail_level(cell_px: Column, visible: Column) -> Column:
    return F.when(cell_px < SPARSE_PX, "sparse").when((cell_px < OUTLINE_PX) | (visible > MAX_STROKED), "fill").otherwise("outline")


def tile_count(north: Column, south: Column, east: Column, west: Column, zoom: int) -> Column:
    wide = F.abs(geo.tile_x(east, zoom) - geo.tile_x(west, zoom)) + 1
    return wide * (F.abs(geo.tile_y(south, zoom) - geo.tile_y(north, zoom)) + 1)


def sampling_zoom(north: Column, south: Column, east: Column, west: Column, cell_m: Column, deepest: int, target_px: float = 10.0) -> Column:
    """The deepest zoom within the tile budget, then shallower while cells keep their pixels."""
    fits = F.lit(1)
    for z in range(2, deepest + 1):
        fits = F.when(tile_count(north, south, east, west, z) <= MAX_TILES, z).otherwise(fits)
    middle = (north + south) / 2
    # the shallowest zoom that meets the target
    meets = [F.when(cell_m / geo.metres_per_pixel(middle, z) >= target_px, z) for z in range(1, deepest + 1)]
    return F.least(fits, F.coalesce(*meets, F.lit(deepest)))


def health_band(mean: Column) -> Column:
    bands = ((0.1, "bare soil / no vegetation"), (0.3, "severely stressed"), (0.5, "moderately stressed"), (0.7, "moderate health"))
    out = F.lit("healthy canopy")
    for below, name in reversed(bands):
        out = F.when(mean < below, name).otherwise(out)
    return out


def ninth(y: Column, x: Column, north: Column, south: Column, east: Column, west: Column) -> Column:
    """The cell of a 3 x 3 grid that holds a point: NW .. SE, the middle one is Center."""
    part = lambda v, low, high: F.least(F.lit(2), F.floor((v - low) / (high - low) * 3)).cast("int")
    row = F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("N")), part(y, south, north) + 1)
    col = F.element_at(F.array(F.lit("W"), F.lit("C"), F.lit("E")), part(x, west, east) + 1)
    return F.when((row == "C") & (col == "C"), "Center").otherwise(F.concat(row, col))


def readiness(wanted: Column, unwanted: Column, least: int = 3) -> Column:
    more_w, more_u = F.greatest(F.lit(0), least - wanted), F.greatest(F.lit(0), least - unwanted)
    ask = F.concat_ws(" and ", F.when(more_w > 0, F.concat(more_w.cast("string"), F.lit(" more to treat"))), F.when(more_u > 0, F.concat(more_u.cast("string"), F.lit(" more to leave"))))
    ready = F.concat(wanted.cast("string"), F.lit(" wanted · "), unwanted.cast("string"), F.lit(" not wanted"))
    return F.when((more_w == 0) & (more_u == 0), ready).otherwise(F.concat(F.lit("Mark "), ask, F.lit(".")))


def logged_litres(area_done: Column, area_total: Column, estimate: Column, refills: Column) -> Column:
    """An estimate a load times loads times the share that was flown; whole where nothing was planned."""
    share = F.when(area_total > 0, F.least(F.lit(1.0), area_done / area_total)).otherwise(F.lit(1.0))
    return estimate * (refills + 1) * share


def refills(required_l: Column, tank_l: Column, load_pct: Column) -> Column:
    """(per_load, loads, refills, dry_fractions, leftover): each load runs dry after its own share of what is required.

    Nothing required is one load; something required with an empty tank is none.
    """
    per = F.greatest(F.lit(0.0), tank_l) * geo.clamp(load_pct, 0.0, 100.0) / 100
    need = F.greatest(F.lit(0.0), required_l)
    some = (per > 0) & (need > 0)
    loads = F.when(some, F.greatest(F.lit(1), F.ceil(need / per))).when(need > 0, 0).otherwise(1)
    dry = F.when(some & (loads > 1), F.transform(F.sequence(F.lit(1), (loads - 1).cast("int")), lambda i: per * i / need)).otherwise(F.array().cast("array<double>"))
    left = F.when(some, per * loads - need).otherwise(per)
    return F.struct(per.alias("per_load"), loads.alias("loads"), F.greatest(F.lit(0), loads - 1).alias("refills"), dry.alias("dry_fractions"), left.alias("leftover"))


def empty_at(fractions: Column, legs: Column) -> Column:
    """For each fraction of the sprayed distance the first leg (0-based) on which it falls; null beyond the last.

    `legs` is array<double> of leg lengths in order."""
    total = F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)
    sums = F.transform(legs, lambda _, i: F.aggregate(F.slice(legs, 1, i + 1), F.lit(0.0), lambda s, x: s + x))
    return F.transform(fractions, lambda f: F.nullif(F.size(F.filter(sums, lambda s: s < f * total)), F.size(legs)))


def cell_size(swath_m: Column, multiple: Column) -> Column:
    """Metres of a cell: whole swaths, at least one."""
    return swath_m * F.greatest(F.lit(1.0), multiple)
