"""Unit conversions. Values are stored in SI units and converted on output only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit -> factor from the stored unit.
M2 = {"ha": 1 / 10_000, "ac": 1 / 4046.8564224, "m2": 1.0}
LITRES = {"l": 1.0, "gal": 1 / 3.785411784}
L_PER_HA = {"l/ha": 1.0, "gal/ac": 4046.8564224 / 10_000 / 3.785411784}
METRES = {"m": 1.0, "ft": 1 / 0.3048, "km": 1 / 1_000, "mi": 1 / 1609.344}
METRES_PER_SECOND = {"m/s": 1.0, "km/h": 3.6, "mph": 3600 / 1609.344}
CM = {"cm": 1.0, "in": 1 / 2.54}
KG = {"kg": 1.0, "lb": 1 / 0.45359237}
KINDS = {"area": M2, "volume": LITRES, "rate": L_PER_HA, "distance": METRES, "speed": METRES_PER_SECOND, "length": CM, "mass": KG}
#: As the weather screen rounds it; differs from the exact factor on purpose.
FORECAST_KMH_TO_MPH = 0.621371


def convert(value: Column, kind: str, unit: str) -> Column:
    return value * KINDS[kind][unit]


def back(value: Column, kind: str, unit: str) -> Column:
    return value / KINDS[kind][unit]


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def price_per_acre(price_per_ha: Column) -> Column:
    return price_per_ha * (4046.8564224 / 10_000)


def decimals(value: Column, most: int = 3) -> Column:
    """Digits after the point by magnitude; for display only."""
    size = F.abs(value)
    return F.when((size == 0) | (size >= 1000), 0).when(size >= 100, 1).when(size >= 1, min(2, most)).otherwise(most)


def half_up(value: Column) -> Column:
    """To whole numbers, halves toward plus infinity."""
    return F.floor(value + 0.5)


def mph_shown(kmh: Column) -> Column:
    """As the weather screen rounds it."""
    return kmh * FORECAST_KMH_TO_MPH


def inches(mm: Column) -> Column:
    return mm / 25.4
