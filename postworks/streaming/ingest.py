"""Continuous forms: ingest of captured batches, first-seen rows, states, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postworks.functions.keys import dedupe_key
from postworks.operators.canonical import canonicalize
from postworks.operators.dedupe import keep_first
from postworks.operators.incremental import SnapshotTable
from postworks.sources.pages import spread


def ingest_batch(rows: DataFrame, number: int, table: SnapshotTable, stream: str, vendor: Column, as_of: Column, order: str = "ordinal") -> None:
    """One batch of a stream: canonical postings, first of each key, upserted, once."""
    # Written first, so that keys are taken of columns and not of the whole mapping.
    canonical = table.stage(canonicalize(spread(rows), vendor, as_of, keep=(order,)))
    keyed = canonical.withColumn("dedupe_key", dedupe_key(F.col("posting_id"), F.col("detail_url"), F.col("position_title")))
    table.upsert(keep_first(keyed, F.col("dedupe_key"), order, within="vendor"), as_of.cast("timestamp"), order, batch=(stream, number))


def ingest(spark: SparkSession, source: str, schema: T.StructType, table: SnapshotTable, checkpoint: str, vendor: Column, as_of: Column, order: str = "ordinal", files_each: int | None = None) -> StreamingQuery:
    """Every batch of files: canonical postings, first of each key, upserted.

    The table's manifest records the batch with its rows, under the checkpoint's
    place, in one commit. A batch that Spark repeats after a failure is found there
    and changes nothing, whoever has written in between.
    """

    def batch(rows: DataFrame, number: int) -> None:
        ingest_batch(rows, number, table, checkpoint, vendor, as_of, order)

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, ts: str, delay: str, *keys: str) -> DataFrame:
    """Rows whose key wasn't seen within the watermark.

    A key is remembered from the row that was let through until the watermark
    passes that row's time and the delay; later it counts as new. So state holds
    the keys of two delays at most. Rows behind the watermark are dropped.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


_STATE = "last_success long, failures array<long>, types array<string>"


def status_changes(stream: DataFrame, company: str = "company_id", ts: str = "ts", ok: str = "ok", kind: str = "type") -> DataFrame:
    """The state of each company that has outcomes in a batch: (company, last_success, last_failure, last_failure_type, failure_count).

    Spark keeps a small state for each company: its last success, and the
    failures after that, which an earlier success that comes late doesn't clear and
    a later one does. So outcomes may come in any order, nothing is read again,
    and the result is that of `runs.status_fold` over all outcomes so far. ts is a
    whole number or a timestamp; rows without it, or without `ok`, don't count.
    """
    timed = dict(stream.dtypes)[ts] == "timestamp"
    when = F.unix_micros(ts) if timed else F.col(ts).cast("long")
    rows = stream.select(F.col(company).alias("company"), when.alias("ts"), F.col(ok).alias("ok"), F.coalesce(kind, F.lit("unknown")).alias("type")).where("ts IS NOT NULL AND ok IS NOT NULL AND company IS NOT NULL")

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, failures, types = state.get if state.exists else (None, [], [])
        failed = list(zip(failures, types, strict=True))
        for part in parts:
            wins = part.loc[part["ok"], "ts"]
            if len(wins):
                last = max(int(wins.max()), last if last is not None else int(wins.max()))
            lost = part.loc[~part["ok"]]
            failed += zip(map(int, lost["ts"]), lost["type"], strict=True)
            failed = [f for f in failed if last is None or f[0] > last]
        failed.sort()
        state.update((last, [f[0] for f in failed], [f[1] for f in failed]))
        worst = failed[-1] if failed else (None, None)
        yield pd.DataFrame({"company": [key[0]], "last_success": pd.array([last], "Int64"), "last_failure": pd.array([worst[0]], "Int64"), "last_failure_type": [worst[1]], "failure_count": [len(failed)]})

    kind_of = dict(rows.dtypes)["company"]
    found = rows.groupBy("company").applyInPandasWithState(fold, f"company {kind_of}, last_success long, last_failure long, last_failure_type string, failure_count long", _STATE, "update", GroupStateTimeout.NoTimeout)
    back = lambda c: (F.timestamp_micros(c) if timed else F.col(c).cast(dict(stream.dtypes)[ts])).alias(c)
    return found.select(F.col("company").alias(company), back("last_success"), back("last_failure"), "last_failure_type", "failure_count")


def running_status(stream: DataFrame, states: SnapshotTable, checkpoint: str, company: str = "company_id", **columns: str) -> StreamingQuery:
    """After each batch the states of its companies are in the table, by company (the table's key), once for each batch.

    What a batch needs to know of earlier ones is in Spark's state; no log is read.
    """
    part = F.lit("all")  # the table's buckets divide companies

    def batch(rows: DataFrame, number: int) -> None:
        made = rows.select("*", part.alias(states.vendor), F.col(company).cast("string").alias(states.key), F.lit(number).alias("batch_number"))
        states.upsert(made, F.lit(None).cast("timestamp"), "batch_number", batch=(checkpoint, number))

    changes = status_changes(stream, company, **columns)
    return changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(stream: DataFrame, ts: str = "ts", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count, sum, smallest and largest value of each scraper and name in each window.

    In append mode a window comes out once, when the watermark has passed its end,
    and its state goes; rows for a window that has come out are dropped.
    """
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, size), "scraper", "name")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")).select(F.col("window.start").alias("start"), "scraper", "name", "n", "sum", "min", "max")
