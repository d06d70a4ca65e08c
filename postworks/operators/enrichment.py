"""Columns from other tables: places, registry states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postworks.functions.names import free
from postworks.functions.text import strip


def places(rows: DataFrame, column: str = "raw_location") -> DataFrame:
    """Distinct places of the rows, stripped."""
    return rows.select(strip(F.col(column)).alias("query")).where("query != ''").distinct()


def to_resolve(rows: DataFrame, cache: DataFrame, column: str = "raw_location") -> DataFrame:
    """Places that the cache doesn't have, not even as unresolvable."""
    return places(rows, column).join(cache.select("query"), "query", "left_anti")


def with_places(rows: DataFrame, cache: DataFrame, column: str = "raw_location") -> DataFrame:
    """Rows with their place's fields from a cache (query, geo struct or null): coordinates where known, names where not blank."""
    query, geo = free("query", rows.columns), free("geo", rows.columns)
    joined = rows.withColumn(query, strip(F.col(column))).join(cache.select(F.col("query").alias(query), F.col("geo").alias(geo)), query, "left")
    known = {c: F.coalesce(F.col(geo)[c], F.col(c)) for c in ("latitude", "longitude")}
    named = {c: F.coalesce(F.nullif(F.col(geo)[c], F.lit("")), F.col(c)) for c in ("country", "state", "city", "postal_code")}
    return joined.withColumns(known | named).select(*rows.columns)


def place_coverage(rows: DataFrame, cache: DataFrame, column: str = "raw_location") -> DataFrame:
    """(n_rows, n_with_place, n_places, n_matched)."""
    place = F.nullif(strip(F.col(column)), F.lit(""))
    joined = rows.select(place.alias("query")).join(cache.where("geo IS NOT NULL").select("query", F.lit(True).alias("hit")), "query", "left")
    return joined.agg(F.count("*").alias("n_rows"), F.count("query").alias("n_with_place"), F.countDistinct("query").alias("n_places"), F.count_if("hit").alias("n_matched"))


def new_columns(maps: DataFrame, column: str) -> DataFrame:
    """Distinct keys of a map column: the columns that enrichment adds."""
    return maps.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def with_status(companies: DataFrame, status: DataFrame) -> DataFrame:
    """Companies with the fields of their latest status, where there is one."""
    latest = free("status", companies.columns)
    new = status.select("company_id", F.struct(*[c for c in status.columns if c != "company_id"]).alias(latest))
    joined = companies.join(new, "company_id", "left")
    fields = [c for c in status.columns if c != "company_id"]
    old = lambda c: F.col(c) if c in companies.columns else F.lit(None)
    return joined.withColumns({c: F.coalesce(F.col(latest)[c], old(c)) for c in fields}).drop(latest)
