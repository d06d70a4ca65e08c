"""Continuous forms: real watermarks, keyed state, batches that count once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from postworks.operators import runs
from postworks.operators.incremental import SnapshotTable
from postworks.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


class Files:
    """Files that a stream takes one after another."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, *made):
        self.spark.createDataFrame(made, self.schema).coalesce(1).write.mode("append").json(self.path)

    def stream(self):
        kinds = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(self.path)


def finish(writer, checkpoint):
    q = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_ingest_is_the_batch_result(spark, tmp_path):
    schema = "posting_id string, detail_url string, position_title string, post_date string, ordinal int"
    batches = [[("1", "https://a/1", "x", "2024-01-01", 1), ("1", "https://a/1", "later", "2024-01-01", 2)], [("2", "https://a/2", "y", None, 3), ("1", "https://a/1", "new", "2024-01-02", 4)]]
    files, table = Files(spark, tmp_path / "in", schema), SnapshotTable(spark, str(tmp_path / "t"), buckets=2)
    kinds = spark.createDataFrame([], schema).schema
    day = lambda d: F.lit(f"2024-03-0{d}").cast("date")
    take = lambda d: ingest.ingest(spark, files.path, kinds, table, str(tmp_path / "cp"), F.lit("v"), day(d), files_each=1).awaitTermination()
    for i, b in enumerate(batches):
        files.add(*b)
        take(i + 1)
        assert table.read().count() == i + 1
    take(3)
    kept = rows(table.read(), "dedupe_key", "position_title", "first_seen", "updated_at")
    assert [(k, t, f.day, u.day) for k, t, f, u in kept] == [("1", "new", 1, 2), ("2", "y", 2, 2)]
    # A batch is given again, after another writer's upsert.
    other = table.read().where("dedupe_key = '1'").drop("first_seen", "updated_at").withColumns({"position_title": F.lit("theirs"), "o": F.lit(1)})
    table.upsert(other, day(4).cast("timestamp"), "o")
    kept = rows(table.read(), "dedupe_key", "position_title", "first_seen", "updated_at")
    for number, b in enumerate(batches):
        ingest.ingest_batch(spark.createDataFrame(b, schema), number, table, str(tmp_path / "cp"), F.lit("v"), day(5))
    assert rows(table.read(), "dedupe_key", "position_title", "first_seen", "updated_at") == kept


def test_a_key_is_new_again_once_it_is_forgotten(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "ts timestamp, key string")
    hour = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)

    def take():
        return finish(ingest.first_seen(files.stream(), "ts", "2 hours", "key").writeStream.format("json").option("path", str(tmp_path / "out")), tmp_path / "cp")

    files.add((hour(0), "a"), (hour(0), "a"), (hour(0), "b"))
    files.add((hour(1), "a"), (hour(1), "c"))
    take()
    seen = lambda: rows(spark.read.schema("ts timestamp, key string").json(str(tmp_path / "out")), "key", "ts")
    assert seen() == [("a", hour(0)), ("b", hour(0)), ("c", hour(1))]
    # After a restart the keys are still known; then the watermark passes them, and a row behind it is dropped.
    files.add((hour(3), "a"), (hour(3), "d"))
    files.add((hour(10), "e"))
    files.add((hour(10), "g"))
    files.add((hour(10), "b"), (hour(1), "f"))
    q = take()
    assert ("a", hour(3)) not in seen() and ("b", hour(10)) in seen() and "f" not in {k for k, _ in seen()}
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert dropped == 1
    # What is forgotten takes no room.
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 3


def test_a_window_comes_out_once_it_is_closed(spark, tmp_path):
    files = Files(spark, tmp_path / "in", "ts timestamp, scraper string, name string, value double")
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)

    def take():
        return finish(ingest.windowed_metrics(files.stream()).writeStream.outputMode("append").format("json").option("path", str(tmp_path / "out")), tmp_path / "cp")

    out = lambda: rows(spark.read.schema("start timestamp, scraper string, name string, n long, sum double, min double, max double").json(str(tmp_path / "out")))
    files.add((at(0, 1), "s", "n", 1.0), (at(0, 59), "s", "n", 3.0), (at(0, 2), "t", "n", 5.0))
    files.add((at(1, 5), "s", "n", 7.0))  # the watermark is at 0:55 then
    take()
    assert out() == []
    files.add((at(0, 58), "s", "n", 2.0), (at(1, 15), "s", "n", 1.0))  # late, but its window is open
    take()
    closed = [(at(0), "s", "n", 3, 6.0, 1.0, 3.0), (at(0), "t", "n", 1, 5.0, 5.0, 5.0)]
    assert out() == closed
    files.add((at(0, 59), "s", "n", 100.0), (at(2, 30), "s", "n", 4.0))  # its window has come out
    q = take()
    assert out() == [*closed, (at(1), "s", "n", 2, 8.0, 1.0, 7.0)]
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


@pytest.mark.parametrize("kind", ["int", "timestamp"])
def test_states_are_those_of_the_whole_log(spark, tmp_path, kind):
    rng = random.Random(7)
    when = (lambda t: t) if kind == "int" else (lambda t: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t))
    outcomes = [(rng.choice("xyzw"), when(t), rng.random() < 0.2, rng.choice(["e", "f", None])) for t in range(80)]
    outcomes += [("never", when(t), False, None) for t in range(5)] + [(None, when(1), True, None), ("x", None, False, "e"), ("y", when(3), None, "e")]
    rng.shuffle(outcomes)  # late ones too
    schema = f"company_id string, ts {kind}, ok boolean, type string"
    files = Files(spark, tmp_path / "in", schema)
    states = SnapshotTable(spark, str(tmp_path / "states"), vendor="part", buckets=2)
    columns = ("company_id", "last_success", "last_failure", "last_failure_type", "failure_count")
    for lo, hi in ((0, 20), (20, 21), (21, 88)):
        files.add(*outcomes[lo:hi])
        ingest.running_status(files.stream(), states, str(tmp_path / "cp")).awaitTermination()
        so_far = [o for o in outcomes[:hi] if None not in o[:3]]
        assert rows(states.read(), *columns) == rows(runs.status_fold(spark.createDataFrame(so_far, schema)), *columns)
    # The state is all that is kept: files of earlier batches aren't needed.
    kept = rows(states.read(), *columns)
    ingest.running_status(files.stream(), states, str(tmp_path / "cp")).awaitTermination()
    assert rows(states.read(), *columns) == kept
