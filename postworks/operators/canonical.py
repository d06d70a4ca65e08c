"""The canonical posting: schema, canonicalisation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postworks.functions.dates import parse_date
from postworks.functions.keys import as_number, as_text
from postworks.functions.money import salary
from postworks.functions.sections import education_and_skills
from postworks.functions.text import description_text
from postworks.functions.urls import normalize_url

#: Columns of a canonical posting, in order, as exports name them.
DISPLAY_NAMES = [
    "Vendor", "Position Title", "Detail URL", "Description", "Post Date", "Posting ID", "US Person Required",
    "Clearance Level Must Possess", "Clearance Level Must Obtain", "Relocation Available", "Salary Raw",
    "Salary Min (USD/yr)", "Salary Max (USD/yr)", "Bonus", "Remote Status", "Full Time Status", "Hours Per Week",
    "Travel Percentage", "Job Category", "Business Sector", "Business Area", "Industry", "Shift",
    "Required Education", "Preferred Education", "Career Level", "Required Skills", "Preferred Skills",
    "Raw Location", "Country", "State", "City", "Postal Code", "Latitude", "Longitude",
]
NUMBERS = {"salary_min", "salary_max", "bonus", "latitude", "longitude"}
REQUIRED = {"vendor": "Vendor", "position_title": "Position Title", "detail_url": "Detail URL"}


def column_name(display: str) -> str:
    return display.lower().replace(" (usd/yr)", "").replace(" ", "_")


COLUMNS = [column_name(d) for d in DISPLAY_NAMES]
SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if c in NUMBERS else T.StringType()) for c in COLUMNS])


def canonicalize(raw: DataFrame, vendor: Column, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical postings of raw rows, which may lack any of the columns; what they have beyond them and `keep` is dropped.

    as_of: the day that relative dates count from.
    """
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    out = {c: as_number(have(c)) if c in NUMBERS else as_text(have(c)) for c in COLUMNS}
    out["vendor"] = vendor
    out["detail_url"] = normalize_url(out["detail_url"])
    out["post_date"] = parse_date(out["post_date"], as_of)
    # The raw text counts only where neither end is given.
    none = out["salary_min"].isNull() & out["salary_max"].isNull()
    parsed = salary(out["salary_raw"])
    low, high = out["salary_min"], out["salary_max"]
    out["salary_min"], out["salary_max"] = F.when(none, parsed["low"]).otherwise(low), F.when(none, parsed["high"]).otherwise(high)
    out["bonus"] = F.coalesce(out["bonus"], F.lit(0.0))
    # Neither is worth working out where there is no text.
    out["description"] = F.when(out["description"].isNull(), "").otherwise(description_text(out["description"]))
    # The text is a column by now, so that the sections read it and don't make it anew.
    made = raw.select(*[out[c].alias(c) for c in COLUMNS], *keep)
    found = education_and_skills(F.col("description"))
    filled = ("required_education", "preferred_education", "required_skills", "preferred_skills")
    return made.select(*[F.coalesce(F.col(c), F.when(F.col("description") != "", found[c])).alias(c) if c in filled else F.col(c) for c in COLUMNS], *keep)


def to_display(df: DataFrame) -> DataFrame:
    """Columns under the names that exports have."""
    return df.select(*[F.col(c).alias(d) for c, d in zip(COLUMNS, DISPLAY_NAMES, strict=True)])


def errors(df: DataFrame) -> Column:
    """Codes of what is wrong with a posting; an empty array if nothing is."""
    missing = [F.when(F.col(c).isNull() | (F.col(c) == ""), f"missing_required:{d}") for c, d in REQUIRED.items()]
    url, date = F.col("detail_url"), F.col("post_date")
    low, high = F.col("salary_min").cast("string"), F.col("salary_max").cast("string")
    both = low.isNotNull() & high.isNotNull()
    numeric = low.try_cast("double").isNotNull() & high.try_cast("double").isNotNull()
    return F.array_compact(
        F.array(
            *missing,
            F.when((url != "") & ~url.rlike("^https?://"), "bad_detail_url"),
            F.when((date != "") & ~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "bad_post_date_format"),
            F.when(both & numeric & (low.try_cast("double") > high.try_cast("double")), "salary_min_gt_max"),
            F.when(both & ~numeric, "salary_non_numeric"),
        )
    )


def error_summary(df: DataFrame) -> DataFrame:
    """(code, n) of the rows that have errors."""
    return df.select(F.explode(errors(df)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the others with a column of their codes."""
    marked = df.withColumn("errors", errors(df))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def since(df: DataFrame, day: Column, as_of: Column, column: str = "post_date") -> DataFrame:
    """Postings from a day on; those without a date that is understood are dropped."""
    return df.where(F.try_to_date(parse_date(F.col(column).cast("string"), as_of), "yyyy-MM-dd") >= day)


def with_url(df: DataFrame, column: str = "detail_url") -> tuple[DataFrame, DataFrame]:
    """Listing rows with a URL, and those without one."""
    good = F.col(column).isNotNull() & (F.col(column) != "")
    return df.where(good), df.where(~good)


def strict_postings(df: DataFrame, *required: str) -> tuple[DataFrame, DataFrame]:
    """Rows that have all of the columns, and the others with the reason."""
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    marked = df.withColumn("lacks", lacks)
    return marked.where(F.size("lacks") == 0).drop("lacks"), marked.where(F.size("lacks") > 0)


def parsed_only(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Rows that were parsed, and counts of the others by status."""
    return df.where(F.col(status) == "ok"), df.where(F.col(status) != "ok").groupBy(status).agg(F.count("*").alias("n"))
