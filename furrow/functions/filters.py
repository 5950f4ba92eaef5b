"""Filter building: a small filter language, ownership, row validation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPERATORS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
}
_TERM = re.compile(r"([A-Za-z_]\w*)\.(\w+)\.(.*)\Z", re.S)


def _split(text: str) -> list[str]:
    """Parts between commas outside of parentheses."""
    parts, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    return [*parts, part] if part else parts


def parse_filter(text: str, any_of: bool = True) -> Column:
    """`a.eq.1,and(b.lt.2,c.in.(x,y))` as a Column: parts are alternatives, and(...) joins its parts, or(...) parts them.

    A null value satisfies no comparison; the column's own type decides how a value is read.
    """
    out = None
    for part in _split(text):
        if part.startswith(("and(", "or(")) and part.endswith(")"):
            name, inner = part.split("(", 1)
            term = parse_filter(inner[:-1], any_of=name == "or")
        else:
            m = _TERM.match(part.strip())
            if not m:
                raise ValueError(f"not a filter: {part!r}")
            column, op, value = F.col(m[1]), m[2], m[3]
            if op == "in":
                term = column.cast("string").isin(*_split(value.strip()[1:-1]))
            elif op == "is":
                term = column.isNull() if value == "null" else column == (value == "true")
            elif op in _OPERATORS:
                term = _OPERATORS[op](column, F.lit(value))
            else:
                raise ValueError(f"unknown operator {op!r}")
        out = term if out is None else (out | term if any_of else out & term)
    if out is None:
        raise ValueError("an empty filter")
    return out


def owned_by(rows: DataFrame, user: object, column: str = "user_id") -> DataFrame:
    """Only the user's rows; a null user sees none."""
    return rows.filter(F.col(column) == F.lit(user)) if user is not None else rows.filter(F.lit(False))


def comparable(status: Column, tiles: Column, uuid: Column) -> Column:
    """Finished, with tiles, with an id that isn't empty; null counts as no."""
    return F.coalesce((status == "completed") & tiles & (F.length(uuid) > 0), F.lit(False))


def why_not_comparable(status: Column, tiles: Column, uuid: Column) -> Column:
    """The first reason, null if there is none: no image, then the status, then the tiles."""
    waits = F.concat(F.lit("This scan is still "), F.coalesce(status, F.lit("null")), F.lit("."))
    return (
        F.when(~F.coalesce(F.length(uuid) > 0, F.lit(False)), "This scan has no orthomosaic.")
        .when(~status.eqNullSafe("completed"), waits)
        .when(~F.coalesce(tiles, F.lit(False)), "This scan's map tiles have not finished baking yet.")
    )


def validation_errors(rules: dict[str, Column]) -> Column:
    """field -> message of the rules that give one; later rules of a field stand in for earlier ones."""
    pairs = [x for k, v in rules.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


EMAIL = r"(?i)^[^@\s]+@[^@\s]+\.[^@\s]+$"


def valid_email(value: Column, longest: int = 320) -> Column:
    return F.coalesce((F.length(value).between(3, longest)) & value.rlike(EMAIL), F.lit(False))


def may_insert(needed: dict[str, int], optional: dict[str, int], email: str = "email") -> Column:
    """Whether a row may be added: needed columns hold 1 to so many characters, optional ones are null or no longer, the email fits.
    A null in a needed column refuses the row."""
    ok = valid_email(F.col(email))
    for name, longest in needed.items():
        ok = ok & F.length(name).between(1, longest)
    for name, longest in optional.items():
        ok = ok & (F.col(name).isNull() | (F.length(name) <= longest))
    return F.coalesce(ok, F.lit(False))


def form_errors(needed: dict[str, str], choices: dict[str, tuple[str, list[str], bool]], longest: dict[str, int], email: str = "email") -> Column:
    """field -> message over trimmed values. `needed` gives labels; `choices` label, options and whether an answer is needed;
    a text over its limit replaces what was said before of the field."""
    text = lambda k: F.trim(F.coalesce(F.col(k), F.lit("")))
    said: dict[str, Column] = {k: F.when(text(k) == "", f"{label} is required") for k, label in needed.items()}
    said[email] = F.when(text(email) == "", "Email is required").when(~text(email).rlike(EMAIL), "That doesn't look like an email address")
    for k, (label, options, must) in choices.items():
        odd = F.when(~text(k).isin(options) & (text(k) != ""), "Pick one of the listed options")
        said[k] = F.when(text(k) == "", f"{label} is required").otherwise(odd) if must else odd
    for k, n in longest.items():
        said[k] = F.when(F.length(text(k)) > n, f"Keep this under {n} characters").otherwise(said.get(k, F.lit(None).cast("string")))
    return validation_errors(said)


def normalised(value: Column, lower: bool = False) -> Column:
    """Trimmed, null if nothing is left."""
    trimmed = F.nullif(F.trim(value), F.lit(""))
    return F.lower(trimmed) if lower else trimmed


#: Most images of a scan. Fixed value.
MAX_IMAGES = 200
UNCLASSIFIED = "Unclassified"


def deny_all(rows: DataFrame) -> DataFrame:
    """No row, whoever asks: a table that only its owner's service may read."""
    return rows.filter(F.lit(False))


def check_row(status: Column, allowed: list[str], model: Column, only_with: str) -> Column:
    """Whether a row satisfies its table's checks: a listed status (null passes, as checks do), and a model with one status only."""
    return F.coalesce(status.isin(allowed), F.lit(True)) & (model.isNull() | F.coalesce(status == only_with, F.lit(True)))


def image_cap(reported: Column, most: int = MAX_IMAGES) -> Column:
    """The limit that holds now: a node's own where it reports a positive one, never above the general one."""
    return F.when(reported > 0, F.least(reported, F.lit(most))).otherwise(F.lit(most))


def class_label(issue: Column) -> Column:
    """What a treated zone without a class is called."""
    return F.coalesce(issue, F.lit(UNCLASSIFIED))
