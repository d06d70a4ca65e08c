"""What captured sites tell about where postings are: sitemaps, pages, responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postworks.functions.markup import search_source
from postworks.functions.names import free
from postworks.functions.urls import is_posting_url
from postworks.operators.dedupe import best_each, first_values


def sitemap_totals(urls: DataFrame, sitemap: str = "sitemap", loc: str = "loc", order: str = "ordinal", samples: int = 10) -> DataFrame:
    """(sitemap, n_urls, n_matched, n_unique, samples): URLs, posting URLs, distinct ones, and the first of them."""
    wanted = is_posting_url(F.col(loc))
    totals = urls.groupBy(sitemap).agg(F.count("*").alias("n_urls"), F.count_if(wanted).alias("n_matched"), F.countDistinct(F.when(wanted, F.col(loc))).alias("n_unique"))
    first = urls.where(wanted).groupBy(sitemap, loc).agg(F.min(order).alias(order))
    return totals.join(first_values(first, sitemap, loc, order, samples).withColumnRenamed("values", "samples"), sitemap, "left")


#: Children of an index that are scanned, URLs after which no further child is, URLs that are stored of an index and of a child.
MOST_CHILDREN, MOST_URLS, STORED, STORED_EACH = 200, 500_000, 5_000, 500


def scanned_children(children: DataFrame, urls: DataFrame, most_children: int = MOST_CHILDREN, most_urls: int = MOST_URLS) -> DataFrame:
    """(index, child, sitemap, n_urls) of the children that a scan with a budget reads.

    children: (index, child, sitemap) with child as the order; urls: (sitemap,
    ordinal, loc) of those that were captured. The first children of an index are
    taken in turn; the budget is looked at after each one, so the child in which it
    is used up is read to its end. A child that wasn't captured has a null number of
    URLs and uses nothing.
    """
    # Each task keeps the first children of its own before rows are shuffled, so a window holds most_children rows.
    turn = free("turn", children.columns)
    first = children.withColumn(turn, F.row_number().over(Window.partitionBy("index").orderBy("child"))).where(F.col(turn) <= most_children)
    counted = first.join(urls.groupBy("sitemap").agg(F.count("*").alias("n_urls")), "sitemap", "left")
    before = F.sum("n_urls").over(Window.partitionBy("index").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1))
    passed = free("passed", counted.columns)
    return counted.withColumn(passed, F.coalesce(before, F.lit(0))).where(F.col(passed) < most_urls).select("index", "child", "sitemap", "n_urls")


def scan_totals(scanned: DataFrame, urls: DataFrame, each: bool = False, samples: int = 10, stored: int | None = None) -> DataFrame:
    """Per index (or each child of it): n_children, n_urls, n_matched, n_unique, the first postings (samples) and those that are stored (kept)."""
    group = ["index", "child"] if each else ["index"]
    most = stored if stored is not None else STORED_EACH if each else STORED
    rows = scanned.select("index", "child", "sitemap").join(urls, "sitemap")
    found = rows.where(is_posting_url(F.col("loc"))).groupBy(*group, "loc").agg(F.count("*").alias("n"), F.min(F.struct("child", "ordinal")).alias("at"))
    matched = found.groupBy(*group).agg(F.sum("n").alias("n_matched"), F.count("*").alias("n_unique"))
    # As many of a group as are stored are left before they are gathered.
    first = found.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy("at", "loc"))).where(F.col("turn") <= most)
    lists = first.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "loc"))), lambda x: x["loc"]).alias("kept"))
    totals = scanned.groupBy(*group).agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_urls"), F.lit(0)).alias("n_urls"))
    joined = totals.join(matched, group, "left").join(lists, group, "left")
    none = F.array().cast("array<string>")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_matched", "n_unique")]
    return joined.select(*group, "n_children", "n_urls", *counts, F.slice(F.coalesce("kept", none), 1, samples).alias("samples"), F.coalesce("kept", none).alias("kept"))


def best_sitemap(totals: DataFrame, company: str = "company") -> DataFrame:
    """Each company's best sitemap: most unique postings, then most matches, files before indexes, then the first."""
    return best_each(totals, company, F.desc("n_unique"), F.desc("n_matched"), F.asc("is_index"), F.asc("ordinal"))


def probe_plan(best: DataFrame, pages: DataFrame) -> DataFrame:
    """The next step for each company: its sample page if that was captured, the search page if it has one, or none."""
    sample = best.withColumn("sample", F.try_element_at("samples", F.lit(1)))
    joined = sample.join(pages.select(F.col("url").alias("sample"), F.lit(True).alias("captured")), "sample", "left")
    return joined.withColumn("step", F.when(F.col("captured"), "detail").when(F.col("search").isNotNull(), "search").otherwise("none"))


def responses_with_tokens(responses: DataFrame, tokens: DataFrame, page: str = "page", most_hits: int = 10) -> DataFrame:
    """Text responses of each page that hold one of its tokens, in any case, with the first tokens found; a blank content type may be text."""
    kind = F.col("content_type")
    texts = responses.where(kind.isNull() | (F.trim(kind) == "") | kind.rlike("(?i)json|html|javascript|text|xml"))
    body = F.lower("body")
    joined = texts.join(tokens, page).withColumn("hits", F.slice(F.filter("tokens", lambda t: body.contains(F.lower(t))), 1, most_hits))
    return joined.where(F.size("hits") > 0).drop("tokens")


def search_sources(pages: DataFrame, responses: DataFrame, page: str = "page", order: str = "ordinal") -> DataFrame:
    """Where each page's search gets its results: the first service that its responses tell, else what kind of hits it had.

    pages: with `dom_hits`, whether tokens were found in the page itself;
    responses: those that held tokens, with `url` and `body`.
    """
    known = search_source(F.col("url"), F.col("body"))
    first = responses.groupBy(page).agg(F.min_by(known, F.when(known.isNotNull(), F.col(order))).alias("service"), F.lit(True).alias("answered"))
    joined = pages.join(first, page, "left")
    other = F.when(F.col("answered"), "GENERIC_XHR_JSON").when(F.col("dom_hits"), "DOM_ONLY").otherwise("UNKNOWN")
    return joined.select(page, F.coalesce("service", other).alias("source"))
