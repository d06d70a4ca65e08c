"""Operator 6: exact round trips, versions, compaction."""

import pytest
from pyspark.sql import functions as F

from postworks.llm import shard_store


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_appends_compaction_and_versions(spark, tmp_path):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/s", tier_bytes=10, target_bytes=20_000)
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.repeat(F.col("id").cast("string"), 50)).alias("text"), F.lit(7).alias("_arrival_"))
    parts = [df.where(F.col("doc_id") % 6 == k).coalesce(1) for k in range(6)]
    assert [store.append(p) for p in parts] == list(range(1, 7))
    assert same(store.read(), df) and same(store.read(2), parts[0].union(parts[1]))
    before = len(store.manifest()[2])
    while store.compact():
        pass
    assert len(store.manifest()[2]) < before
    assert same(store.read(), df) and same(store.read(3), parts[0].union(parts[1]).union(parts[2]))
    assert store.vacuum() >= 6
    assert same(store.read(), df) and store.compact() is None
    store.append(parts[0])
    assert store.read().count() == 100 + parts[0].count()


def test_arrivals_from_one_scan(spark, tmp_path):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b")], "doc_id long, text string")
    versions = store.append_arrivals(df.withColumn("_arrival", shard_store.arrival_of("doc_id", 3)), "_arrival")
    assert versions == list(range(1, len(versions) + 1)) and same(store.read(), df)


def test_empty_and_wrong_columns(spark, tmp_path):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store.append(df.limit(0))
    assert store.read().count() == 0 and store.read().columns == ["doc_id", "text"]
    with pytest.raises(ValueError, match="columns"):
        store.append(df.withColumn("more", F.lit(1)))


def test_a_version_is_committed_once(spark, tmp_path):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store.append(df)
    with pytest.raises(shard_store.Conflict):
        store._commit(1, None, [])
    store.append(df)
    assert store.read().count() == 2


def test_a_second_writer_is_told_and_strays_go(spark, tmp_path, monkeypatch):
    a, b = (shard_store.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = spark.createDataFrame([(1, "x" * 2_000_000), (2, None)], "id long, text string")
    a.append(rows)
    came, commit = [], shard_store.ShardStore._commit

    def late(self, version, schema, shards):
        if self is a and not came:  # the other writer commits between this one's read and its commit
            came.append(b.append(rows.where("id = 2")))
        return commit(self, version, schema, shards)

    monkeypatch.setattr(shard_store.ShardStore, "_commit", late)
    assert a.append(rows.where("id = 1")) == 3 and sorted(r.id for r in a.read().collect()) == [1, 1, 2, 2]
    with pytest.raises(shard_store.Conflict):
        commit(a, 2, None, [])
    b._write(rows, "lost")
    before = len(b._list("data"))
    b.vacuum(stray=True)
    assert len(b._list("data")) == before - 1 and b.read().count() == 4
