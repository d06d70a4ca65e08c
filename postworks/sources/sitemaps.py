"""Sitemaps and robots files that were captured as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postworks.functions.markup import repair_bom
from postworks.functions.names import free
from postworks.functions.text import strip


def _entries(documents: DataFrame, root: str, xml: str, *ids: str) -> DataFrame:
    parsed = F.from_xml(repair_bom(F.col(xml)), f"{root} ARRAY<STRUCT<loc: STRING, lastmod: STRING>>")
    rows = documents.select(*ids, F.posexplode(parsed[root]).alias("ordinal", "e"))
    loc = strip(F.col("e.loc"))
    return rows.where(loc != "").select(*ids, "ordinal", loc.alias("loc"), F.coalesce(strip(F.col("e.lastmod")), F.lit("")).alias("lastmod"))


def sitemap_urls(documents: DataFrame, *ids: str, xml: str = "xml") -> DataFrame:
    """(ids, ordinal, loc, lastmod) of a sitemap's URLs; blank ones are dropped, a missing date is ""."""
    return _entries(documents, "url", xml, *ids)


def sitemap_index(documents: DataFrame, *ids: str, xml: str = "xml") -> DataFrame:
    """The same of a sitemap index's children."""
    return _entries(documents, "sitemap", xml, *ids)


def sitemap_files(spark: SparkSession, paths: str | list[str], tag: str = "url") -> DataFrame:
    """(file, block, place, loc, lastmod) of captured sitemap files, or with tag "sitemap" of index files; order by block and place within a file.

    Files are read element by element: the end of an element ends a record, so a
    large file is shared among tasks and no sitemap has to fit a row. A compressed
    file is read by one task, still record by record. An end tag inside a comment or
    a CDATA section, or one with a namespace prefix, is not told apart.
    """
    read = spark.read.option("lineSep", f"</{tag}>").text(paths)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    inside = F.regexp_extract("value", rf"(?s)^.*<{tag}(?:\s[^>]*)?>(.*)$", 1)
    entry = F.from_xml(F.concat(F.lit(f"<{tag}>"), inside, F.lit(f"</{tag}>")), "loc STRING, lastmod STRING")
    found = rows.where(inside != "").withColumn("e", entry)
    return found.select("file", "block", "place", strip(F.col("e.loc")).alias("loc"), F.coalesce(strip(F.col("e.lastmod")), F.lit("")).alias("lastmod")).where("loc != ''")


def first_of(rows: DataFrame, key: str | Column | list, *order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key if isinstance(key, list) else [key]).orderBy(*order)
    turn = free("turn", rows.columns)
    return rows.withColumn(turn, F.row_number().over(w)).where(F.col(turn) == 1).drop(turn)


def expand(index_documents: DataFrame, child_documents: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Two levels: an index (url, xml) to its children (url, xml) to unique posting URLs, in order of first occurrence."""
    children = sitemap_index(index_documents, "url").select(F.col("url").alias("index_url"), F.col("ordinal").alias("child"), F.col("loc").alias("sitemap"))
    return expand_urls(children, sitemap_urls(child_documents.withColumnRenamed("url", "sitemap"), "sitemap"), wanted)


def expand_urls(children: DataFrame, urls: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The same from children (index_url, child, sitemap) and URLs (sitemap, ordinal, loc, lastmod), wherever these were read."""
    joined = children.join(urls, "sitemap")
    kept = joined if wanted is None else joined.where(wanted)
    return first_of(kept, "loc", "index_url", "child", "ordinal").select("loc", "lastmod", "sitemap", "child", "ordinal")


def posting_filter(loc: Column, prefixes: list[str] | None = None, needle: str = "/job/") -> Column:
    """URLs that start with one of the prefixes; without prefixes those that contain the needle."""
    if prefixes:
        return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: loc.startswith(p))
    return loc.contains(needle)


def posting_urls(documents: DataFrame, prefixes: list[str] | None = None, needle: str = "/job/") -> DataFrame:
    """Unique posting URLs of single sitemaps (url, xml)."""
    return first_of(sitemap_urls(documents, "url").where(posting_filter(F.col("loc"), prefixes, needle)), "loc", "url", "ordinal")


def robots_sitemaps(documents: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """(ids, ordinal, sitemap): what robots files name as sitemaps, each once."""
    lines = documents.select(*ids, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("ordinal", "line"))
    named = lines.where(F.col("line").rlike(r"(?i)^\s*sitemap:")).select(*ids, "ordinal", strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("sitemap"))
    return first_of(named.where("sitemap != ''"), [*ids, "sitemap"], "ordinal")
