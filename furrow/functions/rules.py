"""Domain rules as Column expressions: spray verdicts, drift, derating, air density, aircraft power."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SprayLimits:
    """Thresholds of the hourly verdict; every one may be overridden. Fixed values of the rules."""

    wind_max_kmh: float = 16
    wind_warn_kmh: float = 13
    gust_max_kmh: float = 24
    rain_next_max_mm: float = 0.5
    temp_min_c: float = 10
    temp_warn_c: float = 29
    humidity_min: float = 40
    humidity_max: float = 70


def _reason(when: Column, kind: str, severity: str, value: Column, limit: float) -> Column:
    named = F.struct(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit")
    )
    return F.when(when, named)


def spray_reasons(wind: Column, gust: Column, rain: Column, temp: Column, humidity: Column, limits: SprayLimits = SprayLimits()) -> Column:
    """Ordered reasons against spraying: hard ones, or, where there is none, soft ones."""
    hard = F.array(
        _reason(wind > limits.wind_max_kmh, "wind", "hard", wind, limits.wind_max_kmh),
        _reason(gust > limits.gust_max_kmh, "gust", "hard", gust, limits.gust_max_kmh),
        _reason(rain > limits.rain_next_max_mm, "rain", "hard", rain, limits.rain_next_max_mm),
        _reason(temp < limits.temp_min_c, "cold", "hard", temp, limits.temp_min_c),
    )
    soft = F.array(
        # the soft wind note names the hard limit it is close to
        _reason(wind > limits.wind_warn_kmh, "wind", "soft", wind, limits.wind_max_kmh),
        _reason(temp > limits.temp_warn_c, "hot", "soft", temp, limits.temp_warn_c),
        _reason(humidity < limits.humidity_min, "humidity-low", "soft", humidity, limits.humidity_min),
        _reason(humidity > limits.humidity_max, "humidity-high", "soft", humidity, limits.humidity_max),
    )
    keep = F.filter(hard, lambda r: r.isNotNull())
    return F.when(F.size(keep) > 0, keep).otherwise(F.filter(soft, lambda r: r.isNotNull()))


def spray_verdict(wind: Column, gust: Column, rain: Column, temp: Column, humidity: Column, limits: SprayLimits = SprayLimits()) -> Column:
    """red, yellow or green; the same tests as spray_reasons without building them."""
    hard = (wind > limits.wind_max_kmh) | (gust > limits.gust_max_kmh) | (rain > limits.rain_next_max_mm) | (temp < limits.temp_min_c)
    soft = (wind > limits.wind_warn_kmh) | (temp > limits.temp_warn_c) | (humidity < limits.humidity_min) | (humidity > limits.humidity_max)
    return F.when(F.coalesce(hard, F.lit(False)), "red").when(F.coalesce(soft, F.lit(False)), "yellow").otherwise("green")


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "green", 0).when(verdict == "yellow", 1).otherwise(2)


def air_density(temp_c: Column, elevation_m: Column, humidity: Column) -> Column:
    """kg/m3 of moist air from temperature, height and humidity (clamped to 0..1)."""
    kelvin = temp_c + 273.15
    pressure = 101_325 * F.pow(1 - 2.25577e-5 * F.greatest(F.lit(0.0), elevation_m), F.lit(5.25588))
    vapour = F.greatest(F.lit(0.0), F.least(F.lit(1.0), humidity)) * 610.78 * F.exp(17.27 * temp_c / (temp_c + 237.3))
    return (pressure - vapour) / (287.058 * kelvin) + vapour / (461.495 * kelvin)


def density_power_factor(rho: Column) -> Column:
    """How much more power thin air costs against sea level."""
    return F.sqrt(1.225 / F.greatest(F.lit(0.3), rho))


def hover_amps(mass_kg: Column, cog_cm: Column, rho: Column, efficiency: float, voltage: float, rotor_area_m2: float, amp_per_cm: float) -> Column:
    """Current from momentum theory, (m g)^1.5 over sqrt(2 rho A), plus what an off-centre load costs; floors on all inputs."""
    ideal = F.pow(F.greatest(F.lit(1.0), mass_kg) * 9.80665, F.lit(1.5)) / F.sqrt(2 * F.greatest(rho, F.lit(0.3)) * rotor_area_m2)
    return ideal / max(efficiency, 0.2) / max(voltage, 1.0) + amp_per_cm * F.abs(cog_cm)


def wind_components(speed: Column, from_deg: Column, heading_deg: Column) -> tuple[Column, Column]:
    """(headwind, crosswind); the direction is where the wind comes from."""
    angle = F.radians(from_deg - heading_deg)
    return speed * F.cos(angle), speed * F.sin(angle)


#: Drift advisories, 10 and 12 miles an hour in m/s, and what a gust may have above. Fixed values.
DRIFT_CAUTION, DRIFT_UNSAFE, GUST_ALLOWANCE = 10 * 0.44704, 12 * 0.44704, 2.0


def drift_level(speed: Column, gust: Column) -> Column:
    """ok, caution or unsafe; a missing gust is the wind."""
    worst = F.coalesce(gust, speed)
    return F.when((speed >= DRIFT_UNSAFE) | (worst >= DRIFT_UNSAFE + GUST_ALLOWANCE), "unsafe").when(speed >= DRIFT_CAUTION, "caution").otherwise("ok")


def usable_capacity(capacity_ah: Column, cycles: Column, reserve: Column) -> Column:
    """Capacity after fade (a fifth in a thousand cycles, never below 0.6) and the reserve, clamped to 0..0.5."""
    kept = F.greatest(F.lit(0.6), 1 - F.greatest(F.lit(0), cycles) / 1000 * 0.2)
    return capacity_ah * kept * (1 - F.greatest(F.lit(0.0), F.least(F.lit(0.5), reserve)))


def endurance_minutes(usable_ah: Column, amps: Column) -> Column:
    return F.when(amps > 0, usable_ah / amps * 60).otherwise(F.lit(0.0))


def separability(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.9, "clear").when(accuracy >= 0.7, "weak").otherwise("indistinguishable")


def zone_rate(override: Column, severity_rate: Column) -> Column:
    """A positive override, else the severity's rate."""
    return F.coalesce(F.when(override > 0, override), severity_rate)
