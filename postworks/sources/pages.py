"""Listing rows and posting details from captured HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postworks.functions import json_paths, markup
from postworks.functions.names import free
from postworks.functions.text import html_to_text, strip
from postworks.functions.urls import resolve_link
from postworks.sources.sitemaps import first_of

_ANCHOR = r"(?is)(<a\b[^>]*>.*?</a>)"
ID_PATTERN = r"(?:jobId=|/job/)([A-Za-z0-9_-]+)"


def page_links(pages: DataFrame, page_id: str, url: str = "url", html: str = "html", needle: str = "/job/", id_pattern: str = ID_PATTERN) -> DataFrame:
    """(page_id, ordinal, detail_url, posting_id, title) of anchors whose link has the needle; the first of a page's URL counts."""
    rows = pages.select(page_id, F.col(url).alias(free("base", [page_id])), F.posexplode(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1))).alias("ordinal", "a"))
    href = markup.attribute(F.regexp_extract("a", r"(?is)^(<a\b[^>]*>)", 1), "href")
    found = rows.select(page_id, "ordinal", resolve_link(F.col(free("base", [page_id])), href).alias("detail_url"), F.nullif(html_to_text(F.col("a")), F.lit("")).alias("title")).where(F.col("detail_url").contains(needle))
    first = first_of(found, [page_id, "detail_url"], "ordinal")
    return first.withColumn("posting_id", F.nullif(F.regexp_extract("detail_url", id_pattern, 1), F.lit("")))


def link_counts(links: DataFrame, order: str) -> DataFrame:
    """(order, got, added): links of each page, and those that no earlier page had.

    Which page has a link first is counted before anything is shuffled, so that a link of all pages is no task's burden.
    """
    got = links.groupBy(order).agg(F.count("*").alias("got"))
    added = links.groupBy("detail_url").agg(F.min(order).alias(order)).groupBy(order).agg(F.count("*").alias("added"))
    return got.join(added, order, "left").select(order, "got", F.coalesce("added", F.lit(0)).cast("long").alias("added"))


def table_rows(pages: DataFrame, page_id: str, url: str = "url", html: str = "html") -> DataFrame:
    """Rows of a results table: link, title, location, date; unique by posting id, rows without a link are dropped."""
    parts = F.regexp_extract_all(html, F.lit(r"""(?is)(<tr[^>]*class\s*=\s*["'][^"']*data-row[^"']*["'][^>]*>.*?</tr>)"""), F.lit(1))
    rows = pages.select(page_id, F.col(url).alias(free("base", [page_id])), F.posexplode(parts).alias("ordinal", "r"))
    cell = lambda name: F.nullif(html_to_text(F.regexp_extract("r", rf"""(?is)<(?:td|span)[^>]*class\s*=\s*["'][^"']*{name}[^"']*["'][^>]*>(.*?)</(?:td|span)>""", 1)), F.lit(""))
    link = F.regexp_extract("r", r"(?is)(<a\b[^>]*>)", 1)
    found = rows.where(link != "").select(page_id, "ordinal", resolve_link(F.col(free("base", [page_id])), markup.attribute(link, "href")).alias("detail_url"), html_to_text(F.regexp_extract("r", r"(?is)<a\b[^>]*>(.*?)</a>", 1)).alias("title"), cell("jobLocation").alias("raw_location"), cell("jobDate").alias("post_date"))
    keyed = found.withColumn("posting_id", F.nullif(F.regexp_extract("detail_url", r"/(\d+)/?$", 1), F.lit("")))
    return first_of(keyed, [page_id, F.coalesce("posting_id", "detail_url")], "ordinal")


def cards(pages: DataFrame, page_id: str, labels: list[str], url: str = "url", html: str = "html", host: str = "") -> DataFrame:
    """Cards with a titled link and label/value lines; title and a link to the host are required."""
    rows = pages.select(page_id, F.col(url).alias(free("base", [page_id])), F.posexplode(F.split(html, r"""(?i)<div[^>]*class\s*=\s*["'][^"']*job-card[^"']*["'][^>]*>""")).alias("ordinal", "c")).where("ordinal > 0")
    lines = F.transform(F.split(html_to_text(F.col("c")), r"\n"), strip)
    after = lambda label: F.when(F.array_position(lines, label) > 0, F.try_element_at(lines, (F.array_position(lines, label) + 1).cast("int")))
    link = markup.attribute(F.regexp_extract("c", r"(?is)(<a\b[^>]*>)", 1), "href")
    found = rows.select(page_id, "ordinal", F.nullif(html_to_text(F.regexp_extract("c", r"(?is)<a\b[^>]*>(.*?)</a>", 1)), F.lit("")).alias("title"), resolve_link(F.col(free("base", [page_id])), link).alias("detail_url"), *[after(x).alias(x.strip(":").lower().replace(" ", "_")) for x in labels])
    return found.where(F.col("title").isNotNull() & F.col("detail_url").contains(host))


def job_id_anchors(pages: DataFrame, page_id: str, url: str = "url", html: str = "html") -> DataFrame:
    """Anchors that carry data-job-id, unique by it."""
    rows = pages.select(page_id, F.col(url).alias(free("base", [page_id])), F.posexplode(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(1))).alias("ordinal", "a"))
    tag = F.regexp_extract("a", r"(?is)^(<a\b[^>]*>)", 1)
    found = rows.select(page_id, "ordinal", markup.attribute(tag, "data-job-id").alias("posting_id"), resolve_link(F.col(free("base", [page_id])), markup.attribute(tag, "href")).alias("detail_url"), html_to_text(F.col("a")).alias("title")).where("posting_id != ''")
    first = F.min_by(F.struct(page_id, "ordinal", "detail_url", "title"), F.struct(page_id, "ordinal"))
    return found.groupBy("posting_id").agg(first.alias("f")).select(f"f.{page_id}", "f.ordinal", "posting_id", "f.detail_url", "f.title")


def spread(pages: DataFrame) -> DataFrame:
    """Pages in at least as many partitions as there are cores; only a table of fewer, hence a small one, is shuffled for it."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a compact table, dealt to all cores whatever its files are: documents that are made of them take far longer than the shuffle of the rows."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


PARTS = ("html", "vendor_blob", "vendor_fields", "job_fields", "jsonld", "meta", "datalayer", "canonical_url", "h1", "smart_apply", "bold")


def detail_artifacts(pages: DataFrame, url: str = "url", html: str = "html", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """What a posting's page holds, part by part (those that are named); a part that is missing or broken is null or empty.

    Documents, however deep, are flattened to maps of dotted paths.
    """
    h = F.col(html)
    documents = {
        "vendor_fields": lambda: json_paths.unwrap(markup.page_state(h)),
        "job_fields": lambda: json_paths.unwrap_job(json_paths.unwrap(markup.page_state(h))),
        "jsonld": lambda: markup.job_posting_ld(h),
        "smart_apply": lambda: markup.smart_apply(h),
    }
    # Only the expressions that are asked for are made.
    found = {
        "html": lambda: h,
        "vendor_blob": documents["vendor_fields"],
        "meta": lambda: markup.meta_tags(h),
        "datalayer": lambda: markup.data_layer(h),
        "canonical_url": lambda: markup.canonical_link(h),
        "h1": lambda: markup.h1_text(h),
        "bold": lambda: markup.bold_blocks(h),
    }
    plain = [found[p]().alias(p) for p in parts if p in found]
    made = json_paths.with_fields(pages, {p: documents[p]() for p in parts if p in documents}, F.col(url).alias("detail_url"), *plain)
    return made.select("detail_url", *parts)
