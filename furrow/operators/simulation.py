"""Grouped simulations: tank profile, tours, sweeps, lattices, outlines. A group is one mission or field, which its
own ceilings bound; groups spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import clips, geo, rules
from furrow.functions import kernels as kn
from furrow.functions.flight import turn_seconds
from furrow.functions.rings import let
from furrow.operators import lattices
from furrow.session import shuffle_width

#: A selection never grows by more than this share, whatever is asked for. Fixed value.
MAX_GROWTH = 0.25


@dataclass(frozen=True)
class Craft:
    """An aircraft's physical parameters."""

    # Those of the one airframe that was worked out.
    dry_kg: float = 50.0
    tank_l: float = 40.0
    density: float = 1.0
    rotor_m2: float = 4 * np.pi * (1.27 / 2) ** 2
    max_pitch_deg: float = 25.0
    slosh_tau_s: float = 1.8
    slosh_max_cm: float = 12.0
    static_offset_cm: float = 4.0
    amp_per_cm: float = 0.9
    battery_ah: float = 30.0
    voltage: float = 52.22
    efficiency: float = 0.72
    pivot_s: float = 2.5


FIELDS = ("t", "litres", "mass_kg", "pitch_deg", "slosh_cm", "cog_cm", "amps", "amp_s", "spraying")
PROFILE = "t double, litres double, mass_kg double, pitch_deg double, slosh_cm double, cog_cm double, amps double, amp_s double, spraying boolean"


def tank_profile(start: np.ndarray, end: np.ndarray, speeds: np.ndarray, sprays: np.ndarray, start_litres: float, craft: Craft = Craft(), rho: float = 1.2, dt: float = 0.25) -> tuple[np.ndarray, ...]:
    """FIELDS every `dt` seconds of a mission's segments in order of time: litres, mass, slosh, amps.

    All is vector expressions of time; the slosh, which relaxes toward its target, is a linear recurrence.
    """
    n = len(start)
    total = float(end.max()) if n else 0.0
    t = np.minimum(total, np.arange(max(1, int(np.ceil(total / dt))) + 1) * dt)
    at = np.minimum(np.searchsorted(end, t, side="right"), max(0, n - 1))
    speed = speeds[at] if n else np.zeros(len(t))
    spray = sprays[at] if n else np.zeros(len(t), bool)
    spray_s = float((end - start)[sprays].sum()) if n else 0.0
    full = min(max(0.0, start_litres), craft.tank_l)
    flow = full / spray_s if spray_s > 0 else 0.0
    worked = np.concatenate([[0.0], np.cumsum(spray[1:] * dt)])
    litres = np.clip(full - flow * worked, 0.0, full)
    fill = litres / craft.tank_l if craft.tank_l > 0 else np.zeros(len(t))
    accel = np.concatenate([[0.0], np.diff(speed) / dt])
    pitch = np.clip(np.degrees(np.arctan2(accel, 9.80665)), -craft.max_pitch_deg, craft.max_pitch_deg)
    target = np.where(fill > 0, pitch / craft.max_pitch_deg * fill * craft.slosh_max_cm, 0.0)
    share = np.where(fill > 0, 1 - np.exp(-dt / np.maximum(0.15, craft.slosh_tau_s * (0.35 + 0.65 * fill))), 1.0)
    slosh = kn.recurrence(1 - share, target * share)
    cog = (fill - 1) * craft.static_offset_cm + slosh
    mass = craft.dry_kg + litres * craft.density
    hover = (np.maximum(1.0, mass) * 9.80665) ** 1.5 / np.sqrt(2 * max(rho, 0.3) * craft.rotor_m2)
    amps = hover / max(0.2, craft.efficiency) / max(1.0, craft.voltage) + craft.amp_per_cm * np.abs(cog)
    used = np.concatenate([[0.0], np.cumsum(amps[1:] * dt)])
    return t, litres, mass, pitch, slosh, cog, amps, used, spray


def tank_profiles(segments: DataFrame, mission: str, start_litres: float, craft: Craft = Craft()) -> DataFrame:
    """(mission, FIELDS) of missions of segments (t_start, t_end, speed, spray).

    Missions are dealt out by key and sorted within partitions; a task reads them one after the other in Arrow batches and
    holds the segments of one.
    """
    kind = segments.schema[mission].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the mission that is still open

        def profile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            columns = [np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(1, 5)]
            start, end, speed = (c.astype(float) for c in columns[:3])
            made = tank_profile(start, end, speed, columns[3].astype(bool), start_litres, craft)
            key = parts[0].column(0)[0].as_py()
            return pa.RecordBatch.from_arrays([pa.array([key] * len(made[0]), parts[0].column(0).type), *map(pa.array, made)], names=[mission, *FIELDS])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_pylist()
            borders = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            if held and held[0].column(0)[0].as_py() != keys[0]:
                yield profile(held)
                held = []
            out = []
            for a, b in zip([0, *borders], [*borders, len(keys)], strict=True):
                held.append(batch.slice(a, b - a))
                if b < len(keys):
                    out.append(profile(held))
                    held = []
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if held:
            yield profile(held)

    rows = segments.select(mission, F.col("t_start").cast("double"), F.col("t_end").cast("double"), F.col("speed").cast("double"), F.coalesce("spray", F.lit(False)).alias("spray"))
    dealt = rows.repartition(shuffle_width(segments.sparkSession, rows), mission).sortWithinPartitions(mission, "t_start", "t_end")
    return dealt.mapInArrow(run, f"{mission} {kind}, {PROFILE}")


def tours(stops: DataFrame, mission: str, stop: str, home: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(mission, stop, seq): the order of each mission's stops (x, y)."""
    kinds = {c: stops.schema[c].dataType.simpleString() for c in (mission, stop)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(stop)
        order = kn.order_stops(rows[["x", "y"]].to_numpy(float), np.array(home))
        out = rows.iloc[order][[mission, stop]].copy()
        out["seq"] = np.arange(len(out), dtype=np.int32)
        return out

    return stops.select(mission, stop, "x", "y").groupBy(mission).applyInPandas(run, f"{mission} {kinds[mission]}, {stop} {kinds[stop]}, seq int")


def fragment_ends(segments: DataFrame, *keys: str) -> DataFrame:
    """A row a fragment of (keys, lane, nth, a, b): the four ends where it can be entered and left, its sprayed metres and its centre."""
    down = F.struct(-F.col("lane"), F.col("nth"))
    d = geo.planar_distance(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    ends = {"fa": F.min_by("a", "nth"), "fb": F.max_by("b", down), "la": F.min_by("a", down), "lb": F.max_by("b", "nth")}
    middle = [F.avg((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(f"c_{c}") for c in ("lat", "lng")]
    s = segments.groupBy(*keys).agg(*[v.alias(k) for k, v in ends.items()], F.sum(d).alias("spray_m"), *middle)
    return s.select(*keys, *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ends for c in ("lat", "lng")], "spray_m", "c_lat", "c_lng")


def fragment_tours(ends: DataFrame, mission: str, fragment: str, home: tuple[float, float], pads: tuple = (), dry_at: tuple[float, ...] = ()) -> DataFrame:
    """(mission, fragment, seq, rev, flip, cost_m): the order of a mission's fragments and the way round each of them.

    A mission's fragments are as many as its route may hold; missions spread over the cluster. `dry_at` are shares of sprayed distance at
    which a load runs out: the trip from there to the nearest pad (home is one) counts for the order.
    """
    kinds = {c: ends.schema[c].dataType.simpleString() for c in (mission, fragment)}
    columns = [f"{e}_{c}" for e in ("fa", "fb", "la", "lb") for c in ("lat", "lng")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(fragment)
        corners = rows[columns].to_numpy(float).reshape(-1, 4, 2)
        stations = np.array([home, *pads], float)
        order, choice, cost = kn.order_fragments(corners, rows["spray_m"].to_numpy(float), rows[["c_lat", "c_lng"]].to_numpy(float), np.array(home, float), stations, dry_at)
        out = rows.iloc[order][[mission, fragment]].copy()
        out["seq"] = np.arange(len(out), dtype=np.int32)
        out["rev"], out["flip"] = np.array(choice) >= 2, np.array(choice) % 2 == 1
        out["cost_m"] = cost
        return out

    return ends.groupBy(mission).applyInPandas(run, f"{mission} {kinds[mission]}, {fragment} {kinds[fragment]}, seq int, rev boolean, flip boolean, cost_m double")


def lattice(fields: DataFrame, field: str, size: float) -> DataFrame:
    """(field, col, row, area, clipped) of a field's ring (array<array<double>> of x, y) cut into square cells.

    Rows of candidate cells are exploded from the ring's box and dealt out. Cells with all corners inside are whole; the others, about the ring, are clipped
    along their four sides, many at once. Slivers below a hundredth of a cell go.
    """
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    box = fields.select(field, "ring", *[F.floor(f(v) / size).cast("int").alias(n) for n, f, v in (("c0", F.array_min, xs), ("c1", F.array_max, xs), ("r0", F.array_min, ys), ("r1", F.array_max, ys))])
    n = (F.col("c1") - F.col("c0") + 1).cast("long") * (F.col("r1") - F.col("r0") + 1)
    checked = box.withColumn("r0", F.when(n <= lattices.MAX_CANDIDATES, F.col("r0")).otherwise(F.raise_error(F.lit("a field has too many cells")).cast("int")))
    as_ring = F.transform("ring", lambda p: F.struct(p[1].cast("double").alias("lat"), p[0].cast("double").alias("lng")))
    bands = checked.select(field, F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", F.array(as_ring).alias("flat"))
    kind = fields.schema[field].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in clips.cells(batch.column("flat"), batch.column("row"), batch.column("c0"), batch.column("c1"), float(size)):
                area = np.where(c.whole, float(size * size), clips.Rings(c.lat, c.lng, c.count).shoelace())
                made = {field: batch.column(field).take(pa.array(c.band)), "col": pa.array(c.col), "row": pa.array(c.row), "area": pa.array(area), "clipped": pa.array(~c.whole & (area < size * size * (1 - 1e-9)))}
                yield pa.RecordBatch.from_pydict(made).filter(pa.array(c.whole | (area >= lattices.SLIVER_SHARE * size * size)))

    dealt = bands.repartition(shuffle_width(fields.sparkSession, fields), field, "row")
    return dealt.mapInArrow(cut, f"{field} {kind}, col int, row int, area double, clipped boolean")


def sweep_lines(zones: DataFrame, zone: str, spacing: float) -> DataFrame:
    """(zone, pass, x1, x2): the parts of level lines, `spacing` apart and centred, inside a ring (array<struct<x,y>>).

    A pass's crossings are sorted and paired; all native.
    """
    ys = F.transform("ring", lambda p: p["y"])
    low, high = F.array_min(ys), F.array_max(ys)
    n = F.greatest(F.lit(1), F.floor((high - low) / spacing)).cast("int")
    lines = zones.withColumns({"__n": n, "__first": (low + high) / 2 - (n - 1) * spacing / 2}).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    y = F.col("__first") + F.col("pass") * spacing
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    cross = F.zip_with("ring", after, lambda p, q: F.when((p["y"] > y) != (q["y"] > y), p["x"] + (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"])))
    met = lines.withColumn("__x", F.array_sort(F.filter(cross, lambda v: v.isNotNull()))).filter(F.size("__x") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("__x") / 2).cast("int") - 1), lambda i: F.struct(F.get("__x", i * 2).alias("x1"), F.get("__x", i * 2 + 1).alias("x2")))
    return met.select(zone, "pass", F.explode(pairs).alias("s")).select(zone, "pass", "s.x1", "s.x2")


def best_heading(costs: DataFrame, zone: str, heading: str, cost: str, current: str, margin: float = 1e-6) -> DataFrame:
    """The cheapest heading of each zone; the current one stays unless the gain exceeds the margin."""
    best = costs.groupBy(zone).agg(F.min(F.struct(cost, heading)).alias("b"), F.min(F.when(F.col(current), F.col(cost))).alias("now"), F.min(F.when(F.col(current), F.col(heading))).alias("kept"))
    move = F.col("now").isNull() | (F.col(f"b.{cost}") < F.col("now") - margin)
    return best.select(zone, F.when(move, F.col(f"b.{heading}")).otherwise(F.col("kept")).alias(heading), F.when(move, F.col(f"b.{cost}")).otherwise(F.col("now")).alias(cost))


def regularise(cells: DataFrame, field: str, radius: int = 1, ceiling: float = 0.25) -> DataFrame:
    """(field, rate, col, row, added): same-rate selections closed on the lattice (grown and shrunk again by `radius`).

    Inferred contract: all marked cells stay, cells marked `skip` are never taken, radius 0 is the identity, and a field whose
    selection would grow by more than the ceiling stays as it is. Both steps are equi-joins on neighbour keys.
    """
    marked = cells.filter("NOT skip").select(field, "rate", "col", "row").distinct()
    if radius == 0:
        return marked.withColumn("added", F.lit(False))
    around = F.array(*[F.struct(F.lit(a).alias("dc"), F.lit(b).alias("dr")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)])
    side = (2 * radius + 1) ** 2
    near = lambda df: df.withColumn("d", F.explode(around)).select(field, "rate", (F.col("col") + F.col("d.dc")).alias("col"), (F.col("row") + F.col("d.dr")).alias("row"))
    grown = near(marked).distinct()
    # A cell survives shrinking if its whole neighbourhood was grown: count the grown cells that reach it.
    closed = near(grown).groupBy(field, "rate", "col", "row").agg(F.count("*").alias("n")).filter(F.col("n") == side).drop("n")
    taken = cells.select(field, "col", "row", F.lit(True).alias("__taken")).distinct()
    fresh = closed.join(taken, [field, "col", "row"], "left_anti")
    once = fresh.groupBy(field, "col", "row").agg(F.min("rate").alias("rate"), F.count("*").alias("k")).filter("k = 1").select(field, "rate", "col", "row")
    sizes = marked.groupBy(field).agg(F.count("*").alias("m")).join(once.groupBy(field).agg(F.count("*").alias("a")), field, "left")
    allowed = sizes.filter(F.coalesce("a", F.lit(0)) <= F.col("m") * min(ceiling, MAX_GROWTH)).select(field)
    return marked.withColumn("added", F.lit(False)).unionByName(once.join(allowed, field, "left_semi").withColumn("added", F.lit(True)))


def zonal_pixels(pixels: DataFrame, cell: Column, stride: Column) -> DataFrame:
    """Mean, deviation and count of a cell's usable pixels (alpha above 0, not black), strided by column and row."""
    ok = (F.col("a") > 0) & (F.col("r") + F.col("g") + F.col("b") > 0) & (F.col("x") % stride == 0) & (F.col("y") % stride == 0)
    light = F.col("r") + F.col("g") + F.col("b")
    return pixels.filter(ok).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(light).alias("s1"), F.sum(light * light).alias("s2"))


def burn(pixels: DataFrame, zones: DataFrame, default: float = 0.0) -> DataFrame:
    """(x, y, rate): the highest rate of the zones over each pixel, as 32-bit floats; others get the default."""
    best = zones.groupBy("x", "y").agg(F.max(F.col("rate").cast("float")).alias("rate"))
    return pixels.select("x", "y").join(best, ["x", "y"], "left").withColumn("rate", F.coalesce("rate", F.lit(default).cast("float")))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(value)


STEPS = 240


def integrate_flight(
    total_s: Column, spray_s: Column, litres: Column, rho: Column, head_ms: Column, turns: Column, craft: Craft = Craft(), cycles: Column | None = None, reserve: float = 0.2, turn_ms: float = 6.0
) -> Column:
    """Charge, peaks and batteries of a flight in STEPS equal steps: (mean_amps, peak_amps, peak_cog_cm, end_kg, usable_ah, minutes, batteries).

    Spraying comes first and drains the tank evenly; a headwind tilts the load, which swings toward its target step by step, so only
    the swing is folded. The peak offset is the one largest in size, with its sign. Turns cost time and 15 % more than the mean current.
    """
    number = lambda x: F.lit(float(x))
    start = F.greatest(number(0), F.least(number(craft.tank_l), litres))
    sprayed_steps = F.least(number(STEPS), F.ceil(F.when(total_s > 0, spray_s / total_s).otherwise(0.0) * STEPS))
    lean = F.degrees(F.atan2(head_ms * 0.15, number(9.80665)))
    pitch = F.greatest(number(-craft.max_pitch_deg), F.least(number(craft.max_pitch_deg), lean)) / craft.max_pitch_deg
    flow = lambda k: F.when(k["spray"] > 0, k["start"] / k["spray"]).otherwise(0.0)
    given = F.struct(total_s.alias("total"), spray_s.alias("spray"), start.alias("start"), (total_s / STEPS).alias("dt"), sprayed_steps.alias("steps"), pitch.alias("pitch"), rho.alias("rho"), turns.alias("turns"))
    usable = rules.usable_capacity(number(craft.battery_ah), cycles if cycles is not None else F.lit(0), number(reserve))

    # What a step uses more than once has a name, since a fold computes an expression anew wherever it stands.
    def flown(k: Column, used: Column) -> Column:
        left = lambda i: F.greatest(number(0), F.least(k["start"], k["start"] - used * F.least(i + 1, k["steps"])))

        def swung(state: Column, litres: Column) -> Column:
            fill = litres / craft.tank_l
            share = 1 - F.exp(-k["dt"] / F.greatest(number(0.15), craft.slosh_tau_s * (0.35 + 0.65 * fill)))
            return F.when(fill > 0, state["slosh"] + (k["pitch"] * fill * craft.slosh_max_cm - state["slosh"]) * share).otherwise(0.0)

        def costs(state: Column, litres: Column, swing: Column, cog: Column) -> Column:
            amps = rules.hover_amps(craft.dry_kg + litres * craft.density, cog, k["rho"], craft.efficiency, craft.voltage, craft.rotor_m2, craft.amp_per_cm)
            peak = F.when(F.abs(cog) > F.abs(state["cog"]), cog).otherwise(state["cog"])
            sums = lambda a: F.struct(swing.alias("slosh"), (state["sum"] + a).alias("sum"), F.greatest(state["peak"], a).alias("peak"), peak.alias("cog"))
            return let(amps, sums)

        def step(state: Column, i: Column) -> Column:
            offset = lambda litres, swing: (litres / craft.tank_l - 1) * craft.static_offset_cm + swing
            return let(left(i), lambda litres: let(swung(state, litres), lambda swing: let(offset(litres, swing), lambda cog: costs(state, litres, swing, cog))))

        def finish(state: Column) -> Column:
            mean = F.when(k["total"] > 0, state["sum"] / STEPS).otherwise(0.0)
            turning = turn_seconds(k["turns"], number(turn_ms), craft.pivot_s)
            used_ah = (state["sum"] * k["dt"] + turning * mean * 1.15) / 3600
            return F.struct(
                mean.alias("mean_amps"), state["peak"].alias("peak_amps"), state["cog"].alias("peak_cog_cm"), (craft.dry_kg + left(F.lit(STEPS - 1)) * craft.density).alias("end_kg"),
                usable.alias("usable_ah"), ((k["total"] + turning) / 60).alias("minutes"), F.when(usable > 0, F.greatest(F.lit(1), F.ceil(used_ah / usable))).otherwise(F.lit(1)).alias("batteries"),
            )

        zero = F.struct(*[number(0).alias(n) for n in ("slosh", "sum", "peak", "cog")])
        return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), zero, step, finish)

    return let(given, lambda k: let(flow(k) * k["dt"], lambda used: flown(k, used)))
