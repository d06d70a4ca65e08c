"""The stored table: upserts by bucket, lookups by key range, joins that leave it where it is."""

import datetime

import pytest
from pyspark.sql import functions as F

from postworks.operators import incremental
from postworks.operators.incremental import SnapshotTable

KIND = "vendor string, dedupe_key string, title string, ordinal int"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def now(day):
    return F.lit(f"2024-01-0{day}").cast("timestamp")


def at(day):
    return datetime.datetime(2024, 1, day)


ALL = ("vendor", "dedupe_key", "title", "first_seen", "updated_at")


def test_upsert(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "table"))
    assert table.read() is None and table.lookup("a", "1") is None
    rejected = table.upsert(spark.createDataFrame([("a", "1", "x", 1), ("a", "1", "y", 2), ("b", "2", "z", 1), ("b", "", "lost", 1), ("b", None, "lost", 2)], KIND), now(1), "ordinal")
    assert rejected.count() == 2
    table.upsert(spark.createDataFrame([("a", "1", None, 1), ("c", "3", "n", 1)], KIND), now(2), "ordinal")
    expected = [("a", "1", None, at(1), at(2)), ("b", "2", "z", at(1), at(1)), ("c", "3", "n", at(2), at(2))]
    assert rows(table.read(), *ALL) == expected
    table.upsert(spark.createDataFrame([("c", "3", "n", 1)], KIND), now(2), "ordinal")
    assert rows(table.read(), *ALL) == expected


def big(spark, tmp_path, buckets=8, n=400):
    table = SnapshotTable(spark, str(tmp_path / "big"), buckets=buckets)
    made = spark.range(n).select(F.when(F.col("id") % 3 == 0, "b/ü %").otherwise("a").alias("vendor"), F.lpad(F.col("id").cast("string"), 5, "0").alias("dedupe_key"), F.lit("old").alias("title"), F.lit(1).alias("ordinal"))
    table.upsert(made, now(1), "ordinal")
    return table, made


def test_an_upsert_rewrites_the_buckets_it_falls_into(spark, tmp_path):
    table, _ = big(spark, tmp_path)
    before = table.manifest()
    assert len(before.files) == 16 and sum(f.rows for f in before.files) == 400
    table.upsert(spark.createDataFrame([("a", "00001", "new", 1), ("b/ü %", "00003", "new", 1), ("d", "x", "new", 1)], KIND), now(2), "ordinal")
    after = table.manifest()
    stay, new = set(before.files) & set(after.files), set(after.files) - set(before.files)
    assert len(stay) == 14 and len(new) == 3
    assert rows(table.read().where("title = 'new'"), *ALL) == [("a", "00001", "new", at(1), at(2)), ("b/ü %", "00003", "new", at(1), at(2)), ("d", "x", "new", at(2), at(2))]
    assert table.read().count() == 401 and table.read(vendors=["d"]).count() == 1 and table.read(version=1).count() == 400
    # Another object of the same table keeps to its buckets.
    assert SnapshotTable(spark, table.path, buckets=3).buckets == 8
    kept = rows(table.read(), *ALL)
    assert table.vacuum() >= 2 and table.versions() == [2] and rows(table.read(), *ALL) == kept


def test_a_lookup_reads_one_file(spark, tmp_path):
    table, _ = big(spark, tmp_path)
    found = table.lookup("b/ü %", "00003")
    assert len(found.inputFiles()) == 1 and rows(found, "dedupe_key") == [("00003",)]
    assert table.lookup("b/ü %", "00004").count() == 0 and table.lookup("nobody", "00003").inputFiles() == []
    # A key beyond the range of its bucket's file needs no file.
    assert table.lookup("a", "zzz").inputFiles() == []




def test_joins_leave_the_store_where_it_is(spark, tmp_path, monkeypatch):
    table, made = big(spark, tmp_path)
    incoming = spark.createDataFrame([("a", "00001", "n", 1), ("a", "00001", "n", 2), ("a", "00003", "n", 3), ("b/ü %", "00003", "n", 4), ("a", "", "n", 5), ("z", "00001", "n", 6), ("a", None, "n", 7)], KIND)
    plain = table.read()
    for vendor in ("vendor", None):
        assert rows(incremental.known_keys(incoming, table, vendor)) == rows(incremental.known_keys(incoming, plain, vendor))
        assert rows(incremental.skip_known(incoming, table, vendor)) == rows(incremental.skip_known(incoming, plain, vendor))
    known = incremental.known_keys(incoming, table)
    assert known.count() == 2 and "BroadcastHashJoin" in known._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in known._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert all("Broadcast" in line for line in scans)
    # Only files of the buckets that keys fall into are read.
    assert len(known.inputFiles()) < len(table.manifest().files) + 4
    # With blocks of one bucket each, and with buckets too large for a broadcast, the result is the same.
    for most in (60, 1):
        monkeypatch.setattr(incremental, "BROADCAST_BYTES", most)
        assert rows(incremental.known_keys(incoming, table)) == rows(known)
        assert rows(incremental.skip_known(incoming, table, key="title")) == rows(incremental.skip_known(incoming, plain, key="title"))
    empty = SnapshotTable(spark, str(tmp_path / "none"))
    assert rows(incremental.skip_known(incoming, empty)) == rows(incoming) and incremental.known_keys(incoming, empty).count() == 0
    assert incremental.known_keys(incoming.limit(0), table).count() == 0


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    row = lambda v, k, x, n: spark.createDataFrame([(v, k, x, n)], "vendor string, dedupe_key string, x string, n int")
    table.upsert(row("a/b", "1", "old", 1).union(row("c", "1", "c", 1)), now(1), "n")
    other = SnapshotTable(spark, str(tmp_path / "t"))
    write = SnapshotTable._write
    came = []

    def late(self, df):
        if self is table and not came:  # the other writer commits between this one's read and its commit
            came.append(other.upsert(row("a/b", "2", "theirs", 1), now(2), "n"))
        return write(self, df)

    monkeypatch.setattr(SnapshotTable, "_write", late)
    table.upsert(row("a/b", "1", "ours", 1), now(3), "n")
    assert rows(table.read(), "vendor", "dedupe_key", "x") == [("a/b", "1", "ours"), ("a/b", "2", "theirs"), ("c", "1", "c")]
    assert sorted(table.versions()) == [1, 2, 3]
    of_c = lambda v: [f for f in table.manifest(v).files if f.vendor == "c"]
    assert of_c(1) == of_c(3) and table.read(vendors=["a/b"]).count() == 2
    with pytest.raises(incremental.Conflict):
        table.write(row("z", "1", "x", 1), read=1)
    before = rows(table.read(), "dedupe_key", "x", "first_seen", "updated_at")
    table.upsert(row(None, "1", "x", 1).union(row("a/b", "", "x", 1)), now(4), "n")
    assert table.vacuum() > 0 and table.versions() == [3] and rows(table.read(), "dedupe_key", "x", "first_seen", "updated_at") == before


def test_a_batch_counts_once(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    first, second = (spark.createDataFrame([("a", "1", x, 1), ("a", k, x, 1)], KIND) for x, k in (("first", "2"), ("second", "3")))
    table.upsert(first, now(1), "ordinal", batch=("s", 0))
    table.upsert(second, now(2), "ordinal", batch=("s", 1))
    kept = rows(table.read(), *ALL)
    table.upsert(first, now(3), "ordinal", batch=("s", 0))
    table.upsert(second, now(4), "ordinal", batch=("s", 1))
    assert rows(table.read(), *ALL) == kept and len(table.versions()) == 2
    # Another stream's batches are its own, and a batch without rows is recorded too.
    table.upsert(first.limit(0), now(5), "ordinal", batch=("other", 7))
    table.upsert(first, now(6), "ordinal", batch=("other", 7))
    assert rows(table.read(), *ALL) == kept and table.manifest().batches == {"s": 1, "other": 7}
    table.upsert(first, now(6), "ordinal", batch=("other", 8))
    assert rows(table.read(), *ALL) != kept
