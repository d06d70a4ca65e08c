"""Rows of compact tables are dealt to all cores before documents are made of them."""

import pytest

from postworks.plans import catalogue
from postworks.plans import captured as _  # noqa: F401 registers its queries


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dealing")
    spark.sql("SELECT id + 1 AS p_partkey, concat('n ', id) AS p_name, 'Brand#1' AS p_brand, 'TIN' AS p_type, CAST(id AS INT) AS p_size, 1.0D AS p_retailprice FROM range(40)").coalesce(1).write.parquet(str(path / "part.parquet"))
    return str(path)


@pytest.mark.parametrize("name", ["posting_parts", "encoded_mapped", "usajobs_mapped"])
def test_work_is_shared(spark, parts, name):
    assert catalogue.QUERIES[name](spark, parts).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_batch_of_one_file_is_shared(spark, tmp_path):
    from pyspark.sql import functions as F

    from postworks.operators.incremental import SnapshotTable
    from postworks.streaming import ingest

    spark.sql("SELECT CAST(id AS STRING) AS posting_id, 't' AS position_title, id AS ordinal FROM range(40)").coalesce(1).write.parquet(str(tmp_path / "batch"))
    table = SnapshotTable(spark, str(tmp_path / "table"), buckets=2)
    ingest.ingest_batch(spark.read.parquet(str(tmp_path / "batch")), 0, table, "s", F.lit("v"), F.lit("2024-02-01").cast("date"))
    staged = [p for p in (tmp_path / "table" / "data").glob("incoming-*") if "dedupe_key" not in spark.read.parquet(str(p)).columns]
    assert len(staged) == 1 and len(list(staged[0].glob("*.parquet"))) >= spark.sparkContext.defaultParallelism
    assert table.read().count() == 40
