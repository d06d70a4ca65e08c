"""Date expressions. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postworks.functions.text import strip


def parse_date(text: Column, anchor: Column) -> Column:
    """ISO date of a posting's date text: ISO dates and times, y-m-d or y/m/d, "n days ago", "yesterday"; else null.

    Dates written with dashes or slashes are not held against the calendar.
    """
    s = strip(text)
    token = F.regexp_extract(s, r"^([^\sT]+)", 1)
    iso = F.coalesce(F.when(token.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(token, "yyyy-MM-dd")), F.when(token.rlike(r"^\d{8}$"), F.try_to_date(token, "yyyyMMdd")))
    y, m, d = (F.regexp_extract(s, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})", n) for n in (1, 2, 3))
    loose = F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    # Fixed value: the words for days and their order.
    ago = F.regexp_extract(s, r"(?i)^(\d+)\s*(day|days|d)\s*ago$", 1)
    before = F.when(F.length(ago).between(1, 6), F.date_sub(anchor, ago.try_cast("int")))
    return F.coalesce(iso.cast("string"), loose, before.cast("string"), F.when(F.lower(s) == "yesterday", F.date_sub(anchor, 1).cast("string")))


def since_preset(name: str, anchor: Column) -> Column:
    """First day of a preset: last_7, last_30, this_year; null for all."""
    presets = {"last_7": F.date_sub(anchor, 7), "last_30": F.date_sub(anchor, 30), "this_year": F.trunc(anchor, "year"), "all": F.lit(None).cast("date")}
    return presets[name]
