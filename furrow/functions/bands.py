"""Sensor bands and vegetation indices: a registry of names, needs and expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Index:
    needs: tuple[str, ...]
    build: Callable[..., Column]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(a + b != 0, (a - b) / (a + b))


#: Add an index by adding a row.
INDICES = {
    "NDVI": Index(("nir", "red"), _ratio),
    "NDRE": Index(("nir", "rededge"), _ratio),
    "VARI": Index(("green", "red", "blue"), lambda g, r, b: F.when(g + r - b != 0, (g - r) / (g + r - b))),
}
#: What a band's description must match for a role, tried in this order; red edge is neither red nor near infrared.
RED_EDGE = r"red\s*[-_]?\s*edge|^re$"
ROLE_PATTERNS = (
    ("rededge", RED_EDGE),
    ("nir", r"nir|near.?infra"),
    ("red", r"^r$|(^|[^a-z])red([^a-z]|$)"),
    ("green", r"^g$|(^|[^a-z])green([^a-z]|$)"),
    ("blue", r"^b$|(^|[^a-z])blue([^a-z]|$)"),
)
#: What a writer puts where nothing was labelled.
UNLABELLED = r"|b\d+|band[\s_]?\d+"
#: Sensor layouts as (camera pattern, roles of bands 1, 2, ..).
LAYOUTS = (
    ("", ("red", "nir")),
    (r"rgb.?nir|sentera", ("red", "green", "blue", "nir")),
    (r"mavic\s*3\s*m|m3m|p4\s*multi|p4m", ("green", "red", "rededge", "nir")),
    (r"micasense|rededge|altum", ("blue", "green", "red", "nir", "rededge")),
    (r"sequoia|parrot", ("green", "red", "rededge", "nir")),
)


@dataclass(frozen=True)
class Bands:
    """What is known of a raster: spectral bands, role -> band from 1, how roles were found, whether many bands stay nameless."""

    spectral: int
    roles: dict[str, int]
    method: str
    ambiguous: bool


@dataclass(frozen=True)
class Sheet:
    """A raster's metadata: what is said of each band, from band 1 on."""

    labels: tuple[str, ...]
    colours: tuple[str, ...]
    total: int
    camera: str

    @property
    def alphas(self) -> set[int]:
        return {b for b, c in enumerate(self.colours, 1) if c == "alpha"}

    @property
    def spectral(self) -> int:
        return max(0, self.total - len(self.alphas))


def roles_of_label(label: str) -> list[str]:
    """The roles that a label fits, in the order of ROLE_PATTERNS; what speaks of a red edge is neither red nor near infrared."""
    fits = [role for role, pattern in ROLE_PATTERNS if re.search(pattern, label)]
    return [r for r in fits if r not in ("red", "nir")] if "rededge" in fits else fits


def by_label(sheet: Sheet) -> dict[str, int]:
    """Each band takes the first role that its label fits and that no band before it has."""
    out: dict[str, int] = {}
    for band, label in enumerate(sheet.labels, 1):
        if band not in sheet.alphas:
            out |= {r: band for r in [r for r in roles_of_label(label) if r not in out][:1]}
    return out


def by_colour(sheet: Sheet) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(sheet.colours, 1))) if c in ("red", "green", "blue")}


def by_spare_band(sheet: Sheet) -> dict[str, int]:
    """Of four bands the one beside red, green and blue is near infrared."""
    known = by_colour(sheet) | by_label(sheet)
    free = sorted(set(range(1, sheet.total + 1)) - sheet.alphas - set(known.values()))
    fits = sheet.spectral == 4 and {"red", "green", "blue"} <= set(known) and "nir" not in known
    return {"nir": free[0]} if fits and free else {}


def by_layout(sheet: Sheet) -> dict[str, int]:
    """A sensor's layout: the one of that many bands that the camera names, else the only one of that size. Only for bands without
    labels whose red or near infrared nothing else gives."""
    known = by_colour(sheet) | by_label(sheet) | by_spare_band(sheet)
    if {"red", "nir"} <= set(known) or not all(re.fullmatch(UNLABELLED, label) for label in sheet.labels):
        return {}
    sized = [(pattern, roles) for pattern, roles in LAYOUTS if len(roles) == sheet.spectral]
    named = [x for x in sized if sheet.camera and x[0] and re.search(x[0], sheet.camera, re.I)]
    chosen = named if len(named) == 1 else sized
    return {r: b for b, r in enumerate(chosen[0][1], 1)} if len(chosen) == 1 else {}


#: Each looks at the sheet alone; of a role the first one that answers holds. The name of the rarest one that answered is the method.
RESOLVERS = {"profile": by_layout, "descriptions": by_label, "colorinterp": by_colour, "convention": by_spare_band}
RAREST = ("profile", "convention", "descriptions", "colorinterp")


def analyse(descriptions: list[str], colours: list[str], count: int | None = None, camera: str = "") -> Bands:
    """Roles of a raster's bands by all resolvers; alpha never gets a role."""
    read = lambda texts: tuple(t.strip().lower() for t in texts)
    sheet = Sheet(read(descriptions), read(colours), count or len(colours) or 3, camera.strip())
    answers = {name: resolve(sheet) for name, resolve in RESOLVERS.items()}
    roles = {r: b for answer in reversed(answers.values()) for r, b in answer.items()}
    can = available(roles)
    method = next((name for name in RAREST if answers[name]), "unresolved") if can else "unresolved"
    return Bands(sheet.spectral, roles, method, "NDVI" not in can and sheet.spectral >= 4)


def band_roles(descriptions: list[str], colours: list[str]) -> dict[str, int]:
    return analyse(descriptions, colours).roles


def choose(bands: Bands, prefer: str = "NDVI") -> tuple[str, dict[str, int]]:
    """The index to draw and the bands it reads: the preferred one, NDVI, VARI, else VARI over bands 1, 2, 3."""
    can = available(bands.roles)
    pick = next((n for n in (prefer, "NDVI", "VARI") if n in can), None)
    return (pick, bands.roles) if pick else ("VARI", {"red": 1, "green": 2, "blue": 3})


def preview(bands: Bands) -> tuple[int, int, int] | None:
    """Bands of a true-colour picture; none if one is missing."""
    rgb = [bands.roles.get(c) for c in ("red", "green", "blue")]
    return tuple(rgb) if all(rgb) else None


def options(bands: Bands | None) -> list[tuple[str, str | None]]:
    """Each index with the reason that it can't be had, if there is one; null bands are not known yet."""
    visible = "This scan does not carry the visible bands this index needs."

    def reason(name: str) -> str | None:
        if bands is None:
            return "Still checking what this scan's imagery contains."
        if name in available(bands.roles):
            return None
        if name == "VARI":
            return visible
        band = "near-infrared and red-edge" if name == "NDRE" else "near-infrared"
        if bands.ambiguous:
            return f"This scan has extra bands but nothing identifies which is {band}, so a true {name} cannot be computed from it."
        return f"This scan is ordinary RGB imagery. {name} needs a {band} band the camera did not record."

    return [(name, reason(name)) for name in INDICES]


def available(roles: dict[str, int]) -> list[str]:
    return [name for name, index in INDICES.items() if all(n in roles for n in index.needs)]


def expression(name: str, roles: dict[str, int], band: Callable[[int], Column]) -> Column | None:
    """The index over the given bands; null if a band is missing."""
    index = INDICES[name]
    return index.build(*[band(roles[n]) for n in index.needs]) if all(n in roles for n in index.needs) else None


def from_grey(grey: Column) -> Column:
    """An index from its 8-bit rendering over -1..1."""
    return -1 + grey / 255 * 2


def zone_value(index: Column) -> Column:
    """The screen's value: stretched, shifted and clamped; below 0.4 is stressed."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (index + 1) / 2 * 1.4 - 0.2))
