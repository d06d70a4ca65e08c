"""Plain inputs and outputs: URL lists, wide CSV, posting tables, exports."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.functions.text import strip


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url != ''")


def wide_csv(spark: SparkSession, path: str, columns: list[str] | dict[str, str]) -> DataFrame:
    """Some columns of a CSV file whose names may hold dots and brackets, under new names if a dict gives them."""
    names = columns if isinstance(columns, dict) else dict.fromkeys(columns)
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select(*[F.col(f"`{c}`").alias(n or c) for c, n in names.items()])


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all vendors; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, in a fixed order of columns."""
    (df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df).write.csv(path, header=True, escape='"', mode="overwrite")


def write_full_csv(df: DataFrame, path: str, extra: str = "extra") -> None:
    """CSV of all columns, with what a map column holds as JSON beside them."""
    df.withColumn(extra, F.to_json(extra)).write.csv(path, header=True, escape='"', mode="overwrite")


def write_report(pairs: DataFrame, source: str, path: str) -> bool:
    """A dedupe report with its source; nothing is written for an empty one."""
    if not pairs.limit(1).count():
        return False
    write_csv(pairs.withColumn("source", F.lit(source)), path)
    return True


def pivoted(long: DataFrame, id_column: str) -> DataFrame:
    """A column for each path of a long table (id, path, value), in order of name; the paths are few, unlike the ids."""
    paths = [r.path for r in long.select("path").distinct().orderBy("path").collect()]
    return long.groupBy(id_column).pivot("path", paths).agg(F.max("value"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def clear_work(spark: SparkSession) -> None:
    """Delete the application's tables below that folder; results that still read them must have been saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_path(spark, "x").rpartition("/")[0])
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share: below spark.checkpoint.dir, else below the warehouse.

    A warehouse is a local folder unless it is set otherwise; that will do on one
    machine only, so elsewhere it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base, master = spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")) and (":" not in base or base.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir, or spark.sql.warehouse.dir, to a folder that all machines of the cluster share")
    return f"{base.rstrip('/')}/postings/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
