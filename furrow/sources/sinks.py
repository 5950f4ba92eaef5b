"""Writers: keyed tables on plain files and route texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the waypoint text: header, command codes, the pump's servo and its pulse widths.
HEADER, WAYPOINT = "QGC WPL 110", 16
COMMANDS = {"TAKEOFF": 22, "SPEED_CHANGE": 178, "SPRAY_ON": 183, "SPRAY_OFF": 183, "RTH": 20, "LAND": 21}
PUMP_SERVO, PUMP_ON, PUMP_OFF = 8.0, 2000.0, 1000.0


def upsert(existing: DataFrame, changes: DataFrame, *key: str) -> DataFrame:
    """Existing rows with changed ones in their place and new ones added; files have no update, so this is a rewrite."""
    return existing.join(changes.select(*key), list(key), "left_anti").unionByName(changes, allowMissingColumns=True)


def insert(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing rows and the fresh ones, of which only columns that the table has are written; those they lack are null."""
    known = [c for c in existing.columns if c in fresh.columns]
    return existing.unionByName(fresh.select(*known), allowMissingColumns=True)


def delete_by_key(existing: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return existing.join(keys.select(*key), list(key), "left_anti")


def set_json_key(raw: Column, key: str, value: Column) -> Column:
    """One key of a JSON object replaced, the others kept; the last writer wins."""
    others = F.map_filter(F.coalesce(F.from_json(raw, "map<string, string>"), F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("string"))))


def waypoint_text(points: DataFrame, mission: str) -> DataFrame:
    """(mission, line_no, line) of the waypoint text: a header, home as row 0 (the first waypoint's place), then a tab-separated row
    for each waypoint (seq, action, lat, lng, alt, speed). A writer sorts by line_no. Speed and pump commands have no place."""
    number = lambda c, digits=2: F.format_string(f"%.{digits}f", c.cast("double") if not isinstance(c, float) else F.lit(c))
    code = F.lit(WAYPOINT)
    for action, c in COMMANDS.items():
        code = F.when(F.col("action") == action, c).otherwise(code)
    speed, pump = F.col("action") == "SPEED_CHANGE", F.col("action").isin("SPRAY_ON", "SPRAY_OFF")
    p1 = F.when(speed, 1.0).when(pump, PUMP_SERVO).otherwise(0.0)
    p2 = F.when(speed, F.col("speed")).when(F.col("action") == "SPRAY_ON", PUMP_ON).when(F.col("action") == "SPRAY_OFF", PUMP_OFF).otherwise(0.0)
    p3 = F.when(speed, -1.0).otherwise(0.0)
    place = lambda c: F.when(speed | pump, 0.0).otherwise(F.col(c))
    row = lambda idx, current, frame, command, params, lat, lng, alt: F.concat_ws(
        "\t", idx.cast("string"), F.lit(current), F.lit(frame), command.cast("string"), *[number(x) for x in params], number(lat, 8), number(lng, 8), number(alt), F.lit("1")
    )
    own = row(F.col("seq") + 1, "0", "3", code, (p1, p2, p3, F.lit(0.0)), place("lat"), place("lng"), place("alt"))
    home = row(F.lit(0), "1", "0", F.lit(WAYPOINT), (F.lit(0.0),) * 4, F.col("lat"), F.col("lng"), F.col("alt"))
    at = lambda n, text: F.struct(n.cast("int").alias("line_no"), text.alias("line"))
    first = F.array(at(F.lit(0), F.lit(HEADER)), at(F.lit(1), home), at(F.lit(2), own))
    lines = F.when(F.col("seq") == 0, first).otherwise(F.array(at(F.col("seq") + 2, own)))
    return points.select(mission, F.inline(lines))
