"""First rows, dropped rows and caps, by explicit order.

A key that many rows share is not gathered: minima are pre-aggregated, and
ranks are limited map-side (Spark's window group limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _free(df: DataFrame, name: str) -> str:
    """A name that no column has yet."""
    while name in df.columns:
        name += "_"
    return name


def keep_first(df: DataFrame, key: Column, *order: str, within: str | None = None) -> DataFrame:
    """The first row of each key (of each vendor, if `within` names it); rows with a blank key all stay."""
    k, n = _free(df, "_key"), _free(df, "_n")
    keyed = df.withColumn(k, F.coalesce(key, F.lit("")))
    parts = [k, *([within] if within else [])]
    first = keyed.where(F.col(k) != "").withColumn(n, F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(F.col(n) == 1)
    return first.drop(n, k).unionByName(keyed.where(F.col(k) == "").drop(k))


def dropped_pairs(df: DataFrame, key: Column, order: str, *shown: str, within: str | None = None) -> DataFrame:
    """(key, kept_…, dropped_…) of each row that keep_first drops. Ties of the order keep one row each."""
    fields = F.struct(order, *[c for c in shown if c != order])
    keyed = df.select(F.coalesce(key, F.lit("")).alias("key"), *([F.col(within).alias("within")] if within else []), fields.alias("own")).where("key != ''")
    parts = ["key", *(["within"] if within else [])]
    first = keyed.groupBy(*parts).agg(F.min("own").alias("first"))
    pairs = keyed.join(first, parts).where("own != first")
    return pairs.select("key", *[F.col(f"first.{c}").alias(f"kept_{c}") for c in shown], *[F.col(f"own.{c}").alias(f"dropped_{c}") for c in shown])


def richest(df: DataFrame, *keys: str, value: str, order: str) -> DataFrame:
    """The longest value of each key, the earliest of equally long ones."""
    best = F.max_by(F.col(value), F.struct(F.length(value), -F.col(order)))
    return df.groupBy(*keys).agg(best.alias(value))


def cap_each(df: DataFrame, group: str, most: int, *order: str | Column) -> DataFrame:
    """The first rows of each group, at most so many."""
    n = _free(df, "_n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(n) <= most).drop(n)


def global_budget(df: DataFrame, group: str, budget: int, *order: str) -> DataFrame:
    """The first rows of the groups, in order of their names, until the budget is spent.

    Groups (vendors) are few; only their counts are ordered in one window. No
    group gives more than the budget, which limits ranks before they are shuffled.
    """
    n, share = _free(df, "_n"), _free(df, "_share")
    counts = df.groupBy(group).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.select(group, F.least(F.col(n), F.greatest(F.lit(0), F.lit(budget) - before)).alias(share)).where(F.col(share) > 0)
    ranked = df.withColumn(n, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(n) <= budget)
    return ranked.join(F.broadcast(shares), group).where(F.col(n) <= F.col(share)).select(*df.columns)


def best_each(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The best row of each group."""
    return cap_each(df, group, 1, *order)


def first_values(df: DataFrame, group: str, value: str, order: str, most: int) -> DataFrame:
    """(group, values): the first values of each group, in order, at most so many."""
    ranked = cap_each(df.select(group, value, order), group, most, order)
    return ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def until_dry(pages: DataFrame, group: str, order: str, got: str = "got", added: str = "added") -> DataFrame:
    """Pages of a listing before it stopped: at a page without rows, or at the second in a row without new ones."""
    w = Window.partitionBy(group).orderBy(order)
    stop = (F.col(got) == 0) | ((F.col(added) == 0) & (F.coalesce(F.lag(added).over(w), F.lit(1)) == 0))
    stops, stopped = _free(pages, "_stop"), _free(pages, "_stopped")
    marked = pages.withColumn(stops, F.when(stop, 1).otherwise(0))
    return marked.withColumn(stopped, F.sum(stops).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(stopped) == 0).drop(stops, stopped)
