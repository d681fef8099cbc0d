"""Timetable strings: one slot or one warning for each part that is not empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgrid.functions.text import FULL_DIGITS, DIGITS, WEEKDAYS, utrim, weekday_index

#: Fixed values.
YEAR_LONG = "通年"
GRID_DAYS, GRID_PERIODS = 6, 6
WARNINGS = ("no weekday", "no period", "no weekday or period")


def parse_part(part: Column) -> Column:
    """struct<term, day, period, warning> of a trimmed part; a slot has no warning."""
    has_term = F.contains(part, F.lit(":"))
    term = F.when(has_term, utrim(F.substring_index(part, ":", 1))).otherwise("")
    rest = F.when(has_term, F.substring(part, F.instr(part, F.lit(":")) + 1, F.length(part))).otherwise(part)
    day = F.nullif(F.regexp_extract(rest, f"([{WEEKDAYS}])曜日", 1), F.lit(""))
    period = F.translate(F.nullif(F.regexp_extract(rest, "([１-８])時限", 1), F.lit("")), FULL_DIGITS, DIGITS).try_cast("int")
    warning = F.when(day.isNull() & period.isNull(), WARNINGS[2]).when(day.isNull(), WARNINGS[0]).when(period.isNull(), WARNINGS[1])
    return F.struct(term.alias("term"), day.alias("day"), period.alias("period"), warning.alias("warning"), part.alias("part"))


def parse_slots(timetable: Column) -> Column:
    """array<struct<term, day, period, warning, part>>, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(timetable, F.lit("")), ","), utrim), lambda p: p != "")
    return F.transform(parts, parse_part)


def good_slots(parsed: Column) -> Column:
    """array<struct<term, day, period>> without the warnings."""
    return F.transform(F.filter(parsed, lambda s: s["warning"].isNull()), lambda s: F.struct(s["term"].alias("term"), s["day"].alias("day"), s["period"].alias("period")))


def warnings_of(parsed: Column) -> Column:
    bad = F.filter(parsed, lambda s: s["warning"].isNotNull())
    return F.transform(bad, lambda s: F.concat(s["warning"], F.lit(": "), s["part"]))


def explode_slots(df: DataFrame, timetable: str, *keep: str) -> DataFrame:
    """One row for each part: kept columns, pos, term, day (0 Monday), period, warning."""
    rows = df.select(*keep, F.posexplode(parse_slots(F.col(timetable))).alias("pos", "slot"))
    return rows.select(*keep, "pos", "slot.term", weekday_index("slot.day").alias("day"), "slot.period", "slot.warning")


def on_grid(day: Column, period: Column) -> Column:
    """Sunday and periods 7 and 8 are no grid cells."""
    return day.between(0, GRID_DAYS - 1) & period.between(1, GRID_PERIODS)


def in_term(term: Column, wanted: str | None, year_long: str = YEAR_LONG) -> Column:
    """Whether a slot counts for a term; year-long slots count for every term."""
    return F.lit(True) if wanted is None else term.isin(wanted, year_long)
