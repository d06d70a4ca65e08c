"""Tables that cut lineage."""

import os

import pytest

from postworks.llm import scratch


def local(path):
    return path.removeprefix("file:").replace("//", "/")


def test_written_and_cleared(spark):
    table = scratch.written(spark.range(5), "t")
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4] and table.dtypes == [("id", "bigint")]
    path = local(scratch.shared_path(spark, "t").rpartition("/")[0])
    assert os.path.isdir(path)
    scratch.clear(spark)
    assert not os.path.isdir(path)


def test_passing_tables_go_and_kept_ones_stay(spark):
    def files():
        path = local(scratch.shared_path(spark, "t").rpartition("/")[0])
        return sorted(x.split("-")[0] for x in os.listdir(path)) if os.path.isdir(path) else []

    before = files()
    with scratch.passing_tables(spark):
        a = scratch.written(spark.range(3), "outer")
        with scratch.passing_tables(spark):
            scratch.written(a, "inner")
            b = scratch.keep(scratch.written(a, "result"))
        assert files() == sorted([*before, "outer", "result"])
        c = scratch.keep(scratch.written(b, "last"))
    assert files() == sorted([*before, "last"]) and c.count() == 3
    with pytest.raises(ZeroDivisionError), scratch.passing_tables(spark):
        scratch.written(c, "failed")
        raise ZeroDivisionError
    assert files() == sorted([*before, "last"])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    def session(setting, directory, master="yarn"):
        known = Fake(isDefined=lambda: directory is not None, get=lambda: directory)
        context = Fake(master=master, applicationId="a", _jsc=Fake(sc=lambda: Fake(getCheckpointDir=lambda: known)))
        return Fake(conf=Fake(get=lambda name, default: setting), sparkContext=context)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_path(session(None, None), "t")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_path(session(None, None, "local-cluster[2,1,1024]"), "t")
    assert scratch.shared_path(session("hdfs://x/y/", None), "t").startswith("hdfs://x/y/postworks/a/t-")
    assert scratch.shared_path(session(None, "hdfs://z"), "t").startswith("hdfs://z/postworks/a/t-")
    assert scratch.shared_path(session(None, None, "local[4]"), "t").startswith("file:///")


def test_what_was_shuffled_for_a_table_goes_at_once(spark):
    import time

    name = scratch._SHUFFLES_GO
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, setting = held(), spark.conf.get(name, None)
    table = scratch.written(spark.range(1000).repartition(3, "id").groupBy("id").count(), "t")
    end = time.time() + 20  # they are deleted beside the query's end
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before
    assert table.count() == 1000 and spark.conf.get(name, None) == setting
    scratch.clear(spark)
