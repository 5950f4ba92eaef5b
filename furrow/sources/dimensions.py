"""Constant dimension tables: aircraft models with aliases and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of a spec's numbers, and the models' values in that order. Fixed values.
FIELDS = (
    "tank_l", "payload_kg", "max_flight_min", "max_speed_ms", "spray_swath_m", "spray_rate_lpm", "spray_overlap", "spray_spread_factor",
    "min_turn_radius_m", "climb_rate_ms", "range_m", "weight_kg",
)
SPECS = {
    "DJI Agras T40": (40, 50, 18, 10, 9, 24, 0.1, 1, 4, 6, 1500, 65.5),
    "DJI Agras T30": (30, 40, 18, 10, 6.5, 8, 0.1, 1, 3.5, 6, 1500, 58),
    "DJI Agras T25": (20, 25, 18, 10, 7, 16, 0.1, 1, 3, 6, 1200, 42),
    "XAG P100 Pro": (50, 50, 18, 13.8, 10, 22, 0.1, 1, 4.5, 5, 1000, 75),
    "XAG V40": (16, 20, 18, 13.8, 5, 8, 0.1, 1, 3.5, 5, 1000, 40),
    "DJI Mavic 3M": (0, 0, 43, 21, 0, 0, 0.1, 1, 1, 8, 6000, 0.95),
    "Parrot Anafi USA": (0, 0, 32, 14.7, 0, 0, 0.1, 1, 1, 4, 4000, 0.5),
}
CUSTOM, DEFAULTS = "Custom", (30, 40, 20, 10, 6, 12, 0.1, 1, 3, 5, 1000, 50)
#: Names of old -> today's.
ALIASES = {
    "XAG P100": "XAG P100 Pro",
    "DJI Agras T-40": "DJI Agras T40",
    "DJI Agras T-30": "DJI Agras T30",
    "DJI Agras T-25": "DJI Agras T25",
    "DJI Mavic 3 Multispectral": "DJI Mavic 3M",
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def resolve_specs(rows: DataFrame, model: str, overrides: Column | None = None) -> DataFrame:
    """Append model_key, is_custom and a spec's numbers. Unknown models keep their name (null or empty: Custom) and get the owner's
    `overrides`, a struct of some of FIELDS, over the defaults; known models ignore them. The tables are constants of the
    program, so they are maps in the projection: no exchange, no broadcast."""
    name = F.coalesce(F.element_at(_map(ALIASES), F.col(model)), F.col(model))
    known = F.coalesce(name.isin(list(SPECS)), F.lit(False))
    given = rows.select(overrides.alias("o")).schema["o"].dataType.names if overrides is not None else []

    def number(i: int, field: str) -> Column:
        own = F.coalesce(overrides[field].cast("double"), F.lit(float(DEFAULTS[i]))) if field in given else F.lit(float(DEFAULTS[i]))
        return F.when(known, F.element_at(_map({k: float(v[i]) for k, v in SPECS.items()}), name)).otherwise(own)

    key = F.when(known, name).otherwise(F.coalesce(F.nullif(F.col(model), F.lit("")), F.lit(CUSTOM)))
    return rows.withColumns({"model_key": key, "is_custom": ~known, **{f: number(i, f) for i, f in enumerate(FIELDS)}})
