"""The query catalogue: name -> query, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.plans import fields, flight, learning, lookups, packages, paths, reports, routing, screens, simulation, spatial, weather, zones

MODULES = (weather, reports, learning, spatial, paths, simulation, flight, screens, zones, lookups, fields, packages, routing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}
