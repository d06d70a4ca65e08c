"""Runs: states of companies, metrics, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_fold(outcomes: DataFrame, company: str = "company_id", ts: str = "ts", ok: str = "ok", kind: str = "type") -> DataFrame:
    """(company, last_success, last_failure, last_failure_type, failure_count) from a log of outcomes.

    A success clears the failures before it; a failure without a type is "unknown".
    """
    success = F.max(F.when(F.col(ok), F.col(ts)))
    wins = outcomes.groupBy(company).agg(success.alias("last_success"))
    failed = outcomes.where(~F.col(ok)).join(wins, company).where(F.col("last_success").isNull() | (F.col(ts) > F.col("last_success")))
    fails = failed.groupBy(company).agg(F.max(ts).alias("last_failure"), F.max_by(F.coalesce(kind, F.lit("unknown")), F.struct(ts, F.coalesce(kind, F.lit("unknown")))).alias("last_failure_type"), F.count("*").alias("failure_count"))
    return wins.join(fails, company, "left").withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))


def eligible(companies: DataFrame, now: Column) -> DataFrame:
    """Companies that may run: not disabled, and not in the cool-down after a failure. A time that isn't understood doesn't count."""
    last = F.try_to_timestamp(F.col("last_failure").cast("string"))
    waited = F.unix_timestamp(now) - F.unix_timestamp(last) >= F.col("cooldown_minutes") * 60
    return companies.where(~F.col("disabled") & ((F.col("cooldown_minutes") == 0) | last.isNull() | waited))


def metrics(events: DataFrame) -> DataFrame:
    """Counters summed, gauges at their last value, histograms as count, sum, min, max and mean, from (scraper, kind, name, value, ts)."""
    counter, gauge, histogram = (F.col("kind") == k for k in ("counter", "gauge", "histogram"))
    v = F.col("value")
    return events.groupBy("scraper", "kind", "name").agg(
        F.sum(F.when(counter, v)).alias("total"),
        F.max_by(F.when(gauge, v), F.when(gauge, F.struct("ts", "value"))).alias("last"),
        F.count(F.when(histogram, v)).alias("count"),
        F.sum(F.when(histogram, v)).alias("sum"),
        F.min(F.when(histogram, v)).alias("min"),
        F.max(F.when(histogram, v)).alias("max"),
        F.avg(F.when(histogram, v)).alias("mean"),
    )


def total_of(measured: DataFrame, name: str) -> DataFrame:
    """One counter over all scrapers."""
    return measured.where((F.col("kind") == "counter") & (F.col("name") == name)).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))


def prometheus_lines(measured: DataFrame, prefix: str = "postworks") -> DataFrame:
    """Text lines of metrics; a histogram gives its count, sum, min and max."""
    name = F.regexp_replace("name", "[^A-Za-z0-9_]", "_")
    line = lambda metric, value: F.format_string(f'{prefix}_{metric}{{scraper="%s",name="%s"}} %s', "scraper", name, value.cast("string"))
    lines = F.when(F.col("kind") == "counter", F.array(line("counter", F.col("total")))).when(F.col("kind") == "gauge", F.array(line("gauge", F.col("last")))).otherwise(F.array(*[line(f"histogram_{c}", F.col(c)) for c in ("count", "sum", "min", "max")]))
    return measured.select(F.explode(lines).alias("line"))


def snapshot_json(measured: DataFrame, generated_at: Column, jobs: DataFrame | None = None) -> DataFrame:
    """A run's metrics as one JSON text: each scraper's, the number of its jobs, and when it was made.

    A metric is a row of the report, so there are few; jobs (one a row) are counted only.
    """
    metric = F.struct("kind", "name", "total", "last", "count", "sum", "min", "max", "mean")
    own = measured.groupBy("scraper").agg(F.array_sort(F.collect_list(metric)).alias("metrics"))
    whole = own.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scraper", "metrics")))).alias("scrapers"))
    total = jobs.agg(F.count("*").alias("total_jobs")) if jobs is not None else measured.sparkSession.range(1).select(F.lit(0).cast("long").alias("total_jobs"))
    # One row beside one row.
    return whole.join(total).select(F.to_json(F.struct("scrapers", generated_at.alias("generated_at"), "total_jobs")).alias("json"))


def run_log(runs: DataFrame) -> DataFrame:
    """Runs, newest first, without their output."""
    return runs.drop("stdout").orderBy(F.desc("id"))
