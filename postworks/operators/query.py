"""What users ask of stored postings: search, counts, pages, single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postworks.functions.dates import since_preset

SORT_FIELDS = {"post_date", "position_title", "vendor", "posting_id", "salary_min", "salary_max"}


def whole(text: str | int | None, default: int) -> int:
    """A number from a request, or the default."""
    try:
        return max(0, int(text))
    except (TypeError, ValueError):
        return default


def vendor_counts(df: DataFrame, vendor: str = "vendor") -> DataFrame:
    """(vendor, count), most first."""
    return df.groupBy(vendor).count().orderBy(F.desc("count"), vendor)


def vendor_names(df: DataFrame, vendor: str = "vendor") -> DataFrame:
    return df.where(F.trim(vendor) != "").select(vendor).distinct().orderBy(vendor)


def matches(q: str, *columns: str) -> Column:
    """Whether any column has the text, in any case; "%" and "_" stand for any text and character."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).like(f"%{q.lower()}%"), F.lit(False))
    return out


def search(
    df: DataFrame, vendor: str | None = None, q: str | None = None, since: str | None = None, sort_field: str = "post_date", sort_dir: str = "desc",
    limit: str | int | None = 50, offset: str | int | None = 0, key: str = "dedupe_key", text: tuple[str, ...] = ("position_title", "description", "raw_location"),
) -> DataFrame:
    """A page of postings. Unknown fields sort by date, unknown directions downwards; the key breaks ties."""
    rows = df
    if vendor:
        rows = rows.where(F.col("vendor") == vendor)
    if since:
        rows = rows.where(F.col("post_date") >= since)
    if q:
        rows = rows.where(matches(q, *text))
    field = F.col(sort_field if sort_field in SORT_FIELDS else "post_date")
    order = field.asc() if sort_dir == "asc" else field.desc()
    return rows.orderBy(order, F.col(key)).offset(whole(offset, 0)).limit(whole(limit, 50))


def after(df: DataFrame, field: str, last_value, key: str, last_key, limit: int) -> DataFrame:
    """The page after a row, by ascending field and key: deep pages without counting rows off."""
    later = (F.col(field) > last_value) | ((F.col(field) == last_value) & (F.col(key) > last_key))
    return df.where(later).orderBy(field, key).limit(limit)


def lookup(df: DataFrame, vendor: str, key: str) -> DataFrame:
    return df.where((F.col("vendor") == vendor) & (F.col("dedupe_key") == key))


def preset(df: DataFrame, name: str, anchor: Column, column: str = "post_date") -> DataFrame:
    """Postings of last_7, last_30, this_year or all, as of a day."""
    return df if name == "all" else df.where(F.to_date(column) >= since_preset(name, anchor))


def contains(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.lower(column).contains(text.lower()))


def display(df: DataFrame) -> DataFrame:
    """Fields of a posting's page, with what stands in where one is blank."""
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs], F.lit("—"))
    place = F.nullif(F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("state", F.lit(""))), F.lit(""))
    return df.select(filled("position_title").alias("title"), filled("vendor").alias("vendor"), F.coalesce(F.nullif("raw_location", F.lit("")), place, F.lit("—")).alias("location"), filled("post_date").alias("posted"), filled("clearance_level_must_possess", "clearance_level_must_obtain").alias("clearance"), filled("salary_raw").alias("salary"))
