"""Keys of postings, and coercions of stored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which sources give a posting's id, URL and title.
ID_NAMES = ["Posting ID", "posting_id", "jobId", "job_id", "id"]
URL_NAMES = ["Detail URL", "detail_url", "url", "loc"]
TITLE_NAMES = ["Position Title", "title", "name"]


def dedupe_key(posting_id: Column, url: Column, title: Column) -> Column:
    """The id, else the URL, else the title; "" for a row without any."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in (posting_id, url, title)], F.lit(""))


def provisional_key(fields: Column) -> Column:
    """dedupe_key from a map with any of the known names."""
    first = lambda names: F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names])
    return dedupe_key(first(ID_NAMES), first(URL_NAMES), first(TITLE_NAMES))


def as_text(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def as_number(c: Column) -> Column:
    """A double; null for blank and for what is no number."""
    return F.nullif(c.cast("string"), F.lit("")).try_cast("double")


def unknown_as_json(fields: Column, known: list[str]) -> Column:
    """Fields of a map that have no column of their own, as JSON; null if there are none."""
    rest = F.map_filter(fields, lambda k, v: ~k.isin(known))
    return F.when(F.size(rest) > 0, F.to_json(rest))
