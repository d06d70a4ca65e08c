"""Salary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many times a year each unit is paid, by the units that are known.
PER_YEAR = {"hour": 2080.0, "hr": 2080.0, "day": 260.0, "mo": 12.0, "month": 12.0, "yr": 1.0, "year": 1.0}
#: Fixed value: a number with the unit it is paid by.
_SPAN = r"(?i)(\$?\d+(?:\.\d+)?)(?:\s*/\s*(hour|hr|day|mo|month|yr|year))?"
#: Words of pay that isn't yearly or monthly.
NOT_YEARLY = ["hour", "/hr", "/hour", "per hour", "weekly", "per week", "a week", "daily", "per day"]


def money_span(text: Column) -> Column:
    """Struct of the smallest and largest number of a text, and the last unit that is named ("yr" if none). Null without numbers."""
    t = F.replace(text, F.lit(","), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(_SPAN), F.lit(1)), lambda v: F.replace(v, F.lit("$"), F.lit("")).cast("double"))
    units = F.filter(F.regexp_extract_all(t, F.lit(_SPAN), F.lit(2)), lambda u: u != "")
    span = F.struct(F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"), F.coalesce(F.lower(F.try_element_at(units, F.lit(-1))), F.lit("yr")).alias("unit"))
    return F.when(F.size(numbers) > 0, span)


def yearly(span: Column) -> Column:
    """The span's ends a year, to two decimals."""
    factor = F.coalesce(*[F.when(span["unit"] == u, F.lit(f)) for u, f in PER_YEAR.items()], F.lit(1.0))
    return F.struct(F.round(span["low"] * factor, 2).alias("low"), F.round(span["high"] * factor, 2).alias("high"))


def salary(text: Column) -> Column:
    """Struct of low and high a year, and the raw text."""
    year = yearly(money_span(text))
    return F.struct(year["low"].alias("low"), year["high"].alias("high"), text.alias("raw"))


def yearly_only(text: Column) -> Column:
    """Lower and upper yearly pay of a comment; hourly, daily and weekly pay is passed over, monthly counts twelve times.

    Numbers from 1,000 to 1,000,000 count; a single one has no upper end.
    """
    s = F.lower(text)
    other = F.exists(F.array(*[F.lit(w) for w in NOT_YEARLY]), lambda w: s.contains(w))
    times = F.when(s.contains("per month") | s.contains("monthly"), 12.0).otherwise(1.0)
    raw = F.regexp_extract_all(s, F.lit(r"\$?\d[\d,.]*"), F.lit(0))
    values = F.transform(raw, lambda v: F.translate(v, "$,", "").try_cast("double") * times)
    found = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.between(1000, 1000000))))
    found = F.when(other, F.array().cast("array<double>")).otherwise(found)
    return F.struct(F.try_element_at(found, F.lit(1)).alias("lower"), F.when(F.size(found) > 1, F.element_at(found, -1)).alias("upper"))
