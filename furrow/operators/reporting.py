"""Report and dashboard operators: rollups, latest rows, pages, cost mapping, history deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Acre in square metres as the report screens use it, and litres per acre by default. Fixed values.
HISTORY_ACRE_M2 = 4047.0
HA_TO_AC = 2.4710538147
DEFAULT_LITRES_PER_ACRE = 4.05
#: Issue -> priced input; waterlogging has none. Fixed values.
ISSUE_INPUT = {
    "nitrogen_deficiency": "nitrogen_fertilizer",
    "phosphorus_deficiency": "phosphorus_fertilizer",
    "potassium_deficiency": "potassium_fertilizer",
    "weed_pressure": "herbicide",
    "disease": "fungicide",
    "pest_damage": "insecticide",
    "bare_soil": "reseeding",
    "waterlogging": None,
}
#: Ordered tests of an issue's text: parts of words, a letter that stands alone before "def...", and the key; the first that
#: holds wins. Fixed values.
ISSUE_TESTS = [
    ("water drain saturat pond", None, "waterlogging"),
    ("bare reseed gap establish", None, "bare_soil"),
    ("nitrogen", "n", "nitrogen_deficiency"),
    ("phosphor", "p", "phosphorus_deficiency"),
    ("potass", "k", "potassium_deficiency"),
    ("weed herbicid", None, "weed_pressure"),
    ("disease fung blight rust mildew", None, "disease"),
    ("pest insect aphid worm beetle", None, "pest_damage"),
    ("fertili", None, "nitrogen_deficiency"),
]


def issue_cost_key(issue: Column, action: Column | None = None) -> Column:
    """The key of the first test that the lower-cased issue and action pass; null if none does.

    The text is lowered once, and words are looked for as plain text, which is several times faster than patterns.
    """
    text = F.concat_ws(" ", F.coalesce(issue, F.lit("")), F.coalesce(action, F.lit("")) if action is not None else F.lit(""))

    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for words, letter, key in reversed(ISSUE_TESTS):
            hit = F.lit(False)
            for w in words.split():
                hit = hit | F.contains(low, F.lit(w))
            if letter:
                hit = hit | (F.contains(low, F.lit("def")) & low.rlike(rf"\b{letter}\s+def"))
            out = F.when(hit, key).otherwise(out)
        return out

    return F.transform(F.array(F.lower(text)), first)[0]


def issue_input(key: Column) -> Column:
    """The priced input of an issue; a constant map, so no join."""
    pairs = [x for k, v in ISSUE_INPUT.items() if v for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, first in the given order; the rank limit is pushed below the shuffle."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") == 1).drop("__nth")


def counts_with_last(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, date: str) -> DataFrame:
    """Parents with their number of children (0 if none) and the last date; children are aggregated first."""
    per = children.groupBy(child_key).agg(F.count("*").alias("n"), F.max(date).alias("last_date"))
    joined = parents.join(per, parents[parent_key] == per[child_key], "left")
    return joined.select(*[parents[c] for c in parents.columns], F.coalesce("n", F.lit(0)).alias("n"), "last_date")


def page(rows: DataFrame, number: int, *order: Column, size: int = 24) -> DataFrame:
    """Offset page `number`, from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def append_page(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Existing rows and those of the fresh page whose key is new."""
    return existing.unionByName(fresh.join(existing.select(key), key, "left_anti"))


def exact_sum(value: Column, scale: int = 6) -> Column:
    """A sum that doesn't depend on the order of rows: exact decimals, then a double."""
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def litres_by_input(zones: DataFrame, input_col: str, volume: Column) -> DataFrame:
    """Litres by priced input; zones without one are skipped."""
    mapped = zones.filter(F.col(input_col).isNotNull())
    return mapped.groupBy(input_col).agg(exact_sum(volume).alias("litres"), F.count("*").alias("zones"))


def treated_volume(area: Column, rate: Column) -> Column:
    """Litres: hectares times litres a hectare where both are positive."""
    return F.when((area > 0) & (rate > 0), area * rate)


def percent_untreated(treated: Column, targeted: Column) -> Column:
    """Percent that stays unsprayed, clamped to 0..100; 0 without a target."""
    share = F.when(targeted > 0, (1 - treated / targeted) * 100).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))


def savings_percent(litres: Column, whole_litres: Column) -> Column:
    """Whole percent saved against treating everything, halves up."""
    return F.floor(percent_untreated(litres, whole_litres) + 0.5)


def change_percent(older: Column, newer: Column) -> Column:
    """Percent change; an older value of 0 gives 0."""
    return F.when(older > 0, (newer - older) / older * 100).otherwise(F.lit(0.0))


def ordinal(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Number the rows of a key from 1."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def union_tagged(**sources: DataFrame) -> DataFrame:
    """All rows of the sources with the source's name; missing columns are null."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def bucket_by_day(rows: DataFrame, time: str, item: str, tz: str = "UTC") -> DataFrame:
    """(day, place, item): items of each local day, numbered in the order of time. Rows and not a list a day, so a day may hold any number."""
    day = F.date_format(F.from_utc_timestamp(time, tz), "yyyy-MM-dd")
    w = Window.partitionBy("day").orderBy(time, item)
    return rows.select(day.alias("day"), time, item).withColumn("place", F.row_number().over(w)).select("day", "place", item)
