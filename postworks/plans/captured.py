"""Registered queries of captured documents, exports, streams and whole runs, and their SQL.

Payloads, pages and sitemaps are built by Spark from rows of the given tables,
one document a row; the SQL states what must be read out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postworks.functions import json_paths, markup, sections, text, urls
from postworks.operators import canonical, dedupe, enrichment, incremental, mapping, probe, runs
from postworks.plans import run as runs_of_postings
from postworks.plans.catalogue import _measured, _query
from postworks.sources import pages as page_sources
from postworks.sources import payloads, registry, sitemaps, tables
from postworks.streaming import ingest


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: str | Column) -> Column:
    """Text of literals and columns, one after another."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else _s(p) for p in parts])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _key() -> Column:
    return F.col("p_partkey")


def _size() -> Column:
    return F.col("p_size")


# Registry, sites, sitemaps


@_query("""SELECT 'c' || s_suppkey AS company_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE 2.0 END AS max_rps, CASE WHEN s_suppkey % 3 = 0 THEN 30 ELSE 0 END AS cooldown_minutes,
  s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AS disabled, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_tags FROM supplier""")
def registry_companies(table):
    """SRC1, D8: companies of registry documents, with defaults for what they leave out."""
    full = F.col("s_suppkey") % 3 == 0
    company = F.struct(F.col("s_name").alias("name"), F.when(full, 0.5).alias("max_rps"), F.when(full, 30).alias("cooldown_minutes"), F.when(full, F.col("s_suppkey") % 2 == 0).alias("disabled"), F.when(full, F.array(F.lit("a"), F.lit("b"))).alias("tags"))
    documents = table("supplier").select(F.to_json(F.struct(F.create_map(_cat("c", F.col("s_suppkey")), company).alias("companies"))).alias("doc"))
    return registry.companies(documents).select("company_id", "name", "max_rps", "cooldown_minutes", "disabled", F.size("tags").alias("n_tags"))


@_query("""WITH b AS (SELECT 'c' || s_suppkey AS company_id, s_suppkey AS k FROM supplier),
m AS (SELECT CASE WHEN k % 5 = 1 THEN 'C ' || k ELSE company_id END AS company_id, unnest(list_filter([CASE WHEN k % 5 = 1 THEN 'company_id must be lower-case letters, digits, - or _' END, CASE WHEN k % 5 = 2 THEN 'name is required' END,
  CASE WHEN k % 5 = 3 THEN 'domain is not a host name' END, CASE WHEN k % 5 = 4 THEN 'platform is not known' END, CASE WHEN k % 10 = 4 THEN 'max_rps must be above 0' END, CASE WHEN k % 10 = 9 THEN 'cooldown_minutes must not be below 0' END], lambda x: x IS NOT NULL)) AS message FROM b)
SELECT company_id, message FROM m ORDER BY company_id, message LIMIT 50""")
def registry_violations(table):
    """SRC2: the first 50 messages."""
    k = F.col("s_suppkey")
    rows = table("supplier").select(
        F.when(k % 5 == 1, _cat("C ", k)).otherwise(_cat("c", k)).alias("company_id"), F.when(k % 5 != 2, F.col("s_name")).alias("name"), F.when(k % 5 == 3, "no host").otherwise("a.com").alias("domain"),
        F.when(k % 5 == 4, "other").otherwise("sitemap").alias("platform"), F.when(k % 10 == 4, 0.0).otherwise(2.0).alias("max_rps"), F.when(k % 10 == 9, -1).otherwise(0).alias("cooldown_minutes"),
    )
    return registry.violations(rows)


@_query("""SELECT s_name AS name, 'https://w' || s_suppkey AS website, 'https://c' || s_suppkey AS careers, CASE WHEN s_suppkey % 2 = 0 THEN 'https://s' END AS search FROM supplier WHERE s_suppkey % 5 <> 0""")
def site_list(table):
    """SRC24: two names for each field; values that are no objects are skipped."""
    k, even = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    site = F.to_json(F.struct(F.when(even, _cat("https://w", k)).alias("website"), F.when(~even, _cat("https://w", k)).alias("site"), F.when(even, _cat("https://c", k)).alias("career"), F.when(~even, _cat("https://c", k)).alias("careers"), F.when(even, "https://s").alias("search")))
    return registry.sites(table("supplier").select(_cat('{"', F.col("s_name"), '":', F.when(k % 5 == 0, F.lit('"text"')).otherwise(site), "}").alias("doc")))


@_query("""SELECT page_id, CAST(0 AS INTEGER) AS ordinal, 'https://x/s/' || page_id AS loc, '' AS lastmod FROM pages UNION ALL SELECT page_id, 1, 'https://x/s/' || page_id % 7, '2024-02-02' FROM pages""")
def sitemap_children(table):
    """SRC5, XML1: children of indexes, with and without a byte order mark."""
    mark = F.when(F.col("page_id") % 3 == 0, "﻿").when(F.col("page_id") % 3 == 1, "ï»¿").otherwise("")
    xml = _cat(mark, "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc> https://x/s/", F.col("page_id"), " </loc></sitemap><sitemap><loc>https://x/s/", F.col("page_id") % 7, "</loc><lastmod>2024-02-02</lastmod></sitemap></sitemapindex>")
    return sitemaps.sitemap_index(table("pages").select("page_id", xml.alias("xml")), "page_id")


def _child_sitemaps(table) -> DataFrame:
    entry = lambda u: _cat("<url><loc>", u, "</loc></url>")
    k = F.col("page_id")
    return table("pages").select(_cat("https://x/s/", k).alias("url"), _cat("<urlset>", entry(_cat("https://x/job/", k)), entry(_cat("https://x/job/", k % 40)), entry(_cat("https://x/about/", k)), "</urlset>").alias("xml"))


@_query("""SELECT p_partkey % 2 = 1 AS packed, 'https://h.com/job/' || p_partkey || '?a=1&b=2' AS loc, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-0' || p_partkey % 9 + 1 ELSE '' END AS lastmod FROM part WHERE p_partkey % 5 > 0""")
def sitemap_elements(table):
    """SRC4, SRC5: sitemap files read element by element, compressed ones too; blank URLs are dropped."""
    k = _key()
    loc = F.when(k % 5 > 0, _cat("https://h.com/job/", k, "?a=1&amp;b=2")).otherwise(F.lit(""))
    rows = table("part").select((k % 2 == 1).alias("packed"), _cat("<url><loc> ", loc, "\n</loc>", F.when(k % 3 == 0, _cat("<lastmod>2024-01-0", k % 9 + 1, "</lastmod>")).otherwise(F.lit("<image:loc>i</image:loc>")), "</url>").alias("value"))
    spark, path = rows.sparkSession, tables.work_path(rows.sparkSession, "sitemaps")
    for packed in (False, True):
        rows.where(F.col("packed") == packed).select("value").write.option("compression", "gzip" if packed else "none").text(f"{path}/{packed}")
    found = sitemaps.sitemap_files(spark, [f"{path}/False", f"{path}/True"])
    return found.select(F.col("file").endswith(".gz").alias("packed"), "loc", "lastmod")


@_query("""WITH i AS (SELECT page_id AS index_url, page_id * 10 AS child, page_id AS c FROM pages UNION ALL SELECT page_id, page_id * 10 + 1, page_id % 7 FROM pages),
u AS (SELECT page_id AS c, 0 AS o, page_id AS j FROM pages UNION ALL SELECT page_id, 1, page_id % 40 FROM pages)
SELECT DISTINCT 'https://x/job/' || j AS loc FROM i JOIN u USING (c)""")
def sitemap_expanded(table):
    """SRC6: indexes to children to postings, each once."""
    index = table("pages").select(F.lpad(_s("page_id"), 10, "0").alias("url"), _cat("<sitemapindex><sitemap><loc>https://x/s/", F.col("page_id"), "</loc></sitemap><sitemap><loc>https://x/s/", F.col("page_id") % 7, "</loc></sitemap></sitemapindex>").alias("xml"))
    return sitemaps.expand(index, _child_sitemaps(table), sitemaps.posting_filter(F.col("loc"))).select("loc")


@_query("""WITH u AS (SELECT page_id AS j FROM pages UNION SELECT page_id % 40 FROM pages) SELECT 'https://x/job/' || j AS loc FROM u WHERE starts_with('https://x/job/' || j, 'https://x/job/1') OR starts_with('https://x/job/' || j, 'https://x/job/2')""")
def sitemap_postings(table):
    """SRC7, FLT7: postings of single sitemaps by prefixes."""
    return sitemaps.posting_urls(_child_sitemaps(table), ["https://x/job/1", "https://x/job/2"]).select("loc")


@_query("""SELECT page_id, CAST(1 AS INTEGER) AS ordinal, 'https://x/' || page_id AS sitemap FROM pages UNION ALL SELECT page_id, 3, 'b:c' FROM pages""")
def robots_entries(table):
    """SRC8: what robots files name, each once."""
    body = _cat("User-agent: *\nSitemap: https://x/", F.col("page_id"), " \r\n  SITEMAP:https://x/", F.col("page_id"), "\nsitemap: b:c\nSitemap:\nDisallow: /sitemap:")
    return sitemaps.robots_sitemaps(table("pages").select("page_id", body.alias("text")), "page_id")


# Payloads


@_query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS posting_id, p_name AS title, p_brand AS raw_location, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS department, 'https://x/' || p_partkey AS detail_url FROM part WHERE p_partkey % 5 <> 0""")
def apply_v2_rows(table):
    """SRC9."""
    position = F.struct(F.when(_key() % 3 != 0, _s(_key())).alias("id"), _cat("a", _key()).alias("ats_job_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("location"), F.when(_key() % 2 == 0, F.col("p_type")).alias("department"), F.when(_key() % 5 != 0, _cat("https://x/", _key())).alias("canonicalPositionUrl"))
    return payloads.apply_v2(table("part").select(_json(positions=F.array(position)).alias("body"))).drop("ordinal")


def _usajobs_payloads(table) -> DataFrame:
    pay = F.struct(_s(_size()).alias("MinimumRange"), F.when(_key() % 3 != 0, _s(_size() + 10)).alias("MaximumRange"), F.when(_key() % 3 != 0, "Per Hour").alias("RateIntervalCode"))
    name = lambda c: F.array(F.struct(F.col(c).alias("Name")))
    job = F.struct(_s(_key()).alias("PositionID"), F.col("p_name").alias("PositionTitle"), F.col("p_brand").alias("PositionLocationDisplay"), F.when(_key() % 2 == 0, F.array(_cat("https://p/", _key()), F.lit("z"))).alias("PositionURI"), _cat("https://a/", _key()).alias("ApplyURI"), F.lit("2024-01-02T03:04:05").alias("PublicationStartDate"), F.array(pay).alias("PositionRemuneration"), name("p_type").alias("PositionSchedule"), name("p_brand").alias("JobCategory"))
    return table("part").select(_json(SearchResult=F.struct(F.array(F.struct(job.alias("MatchedObjectDescriptor"))).alias("SearchResultItems"))).alias("body"))


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS posting_id, p_name AS title, p_brand AS raw_location, CASE WHEN p_partkey % 2 = 0 THEN 'https://p/' ELSE 'https://a/' END || p_partkey AS detail_url, '2024-01-02' AS post_date,
  CAST(p_size AS DOUBLE) AS salary_min, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size + 10 AS DOUBLE) END AS salary_max, CASE WHEN p_partkey % 3 <> 0 THEN p_size || '–' || (p_size + 10) || ' Per Hour' ELSE CAST(p_size AS VARCHAR) END AS salary_raw, p_type AS full_time_status, p_brand AS job_category FROM part""")
def usajobs_rows(table):
    """SRC10."""
    return payloads.usajobs(_usajobs_payloads(table)).drop("ordinal")


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS posting_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'first' END AS raw_location, 'https://h.com/job/' || p_partkey AS detail_url, p_type AS full_time_status, CASE WHEN p_partkey % 3 = 0 THEN 'On, Off' ELSE '' END AS remote_status, CASE WHEN p_partkey % 2 = 0 THEN 1.5 END AS latitude FROM part""")
def encoded_rows(table):
    """SRC11: the first place counts, lists are joined."""
    places = F.when(_key() % 2 == 0, F.array(F.struct(F.lit("first").alias("Name"), F.lit(1.5).alias("Latitude")), F.struct(F.lit("second").alias("Name"), F.lit(2.5).alias("Latitude"))))
    result = F.struct(_s(_key()).alias("ReferenceCode"), F.col("p_name").alias("Title"), F.struct(_cat("/job/", _key()).alias("Url")).alias("Link"), F.array("p_type").alias("EmploymentTypes"), F.when(_key() % 3 == 0, F.array(F.lit("On"), F.lit("Off"))).otherwise(F.array()).alias("WorkplaceOptions"), places.alias("Locations"))
    rows = payloads.encoded_search(table("part").select(_json(Results=F.array(result)).alias("body")), "https://h.com/careers/")
    return rows.select("posting_id", "title", "raw_location", "detail_url", "full_time_status", "remote_status", "latitude")


@_query("""SELECT DISTINCT CAST(p_partkey % 500 AS VARCHAR) AS posting_id, 'https://h.com/global/en/job/' || p_partkey % 500 || '/' AS detail_url, 't' || p_partkey % 500 AS title FROM part""")
def page_state_rows(table):
    """SRC12: jobs in known shapes and in another one; repeated ids count once, blank ones don't."""
    job = _cat('{"jobId":" ', _key() % 500, '","title":"t', _key() % 500, '"},{"jobId":" ","title":"none"}')
    shape = F.when(_key() % 500 % 3 == 0, _cat('{"eagerLoadRefineSearch":{"data":{"jobs":[', job, "]}}}")).when(_key() % 500 % 3 == 1, _cat('{"refineSearch":{"data":{"jobs":[', job, "]}}}")).otherwise(_cat('{"widget":{"parts":[1,{"results":[', job, "]}]}}"))
    rows = payloads.page_state_jobs(table("part").select(F.try_parse_json(shape).alias("state")), "https://h.com/")
    return rows.select("posting_id", "detail_url", "title")


def _contexts(table) -> DataFrame:
    script = lambda body: _cat('<html><script id="vike_pageContext" type="application/json">', body, "</script></html>")
    listed = script(_cat('{"data":{"data":{"data":[{"url":"https://c/', _key(), '"},{"jobUrl":"https://d/', _key(), '"},{"none":1}]}}}'))
    return table("part").select("p_partkey", _cat("https://c/", _key()).alias("url"), F.when(_key() % 4 == 0, "<html></html>").when(_key() % 4 == 1, script(F.lit("{broken"))).otherwise(listed).alias("html"))


@_query("""SELECT 'https://c/' || p_partkey AS detail_url FROM part WHERE p_partkey % 4 > 1 UNION ALL SELECT 'https://d/' || p_partkey FROM part WHERE p_partkey % 4 > 1""")
def context_urls(table):
    """SRC13: a page without a context, or with a broken one, gives none."""
    return payloads.page_context_urls(_contexts(table)).select("detail_url")


@_query("""SELECT 'https://c/' || p_partkey AS job_url, 'About ' || p_partkey || chr(10) || 'end' AS description_text, p_brand AS place, 'https://c/' || p_partkey AS own_url, CAST(4 AS INTEGER) AS n_fields FROM part""")
def context_details(table):
    """SRC14, JSN2: the embedded job as flat fields, and its description as text."""
    job = _cat('{"data":{"data":{"description":"<p>About <b>', _key(), '</b></p>end","at":[{"city":"', F.col("p_brand"), '"}],"none":null,"empty":[]}}}')
    pages = table("part").select(_cat("https://c/", _key()).alias("url"), _cat('<script id="vike_pageContext">', job, "</script>").alias("html"))
    rows = payloads.page_context_detail(pages)
    return rows.select("job_url", "description_text", F.try_element_at("fields", F.lit("at[0].city")).alias("place"), F.try_element_at("fields", F.lit("jobUrl")).alias("own_url"), F.size("fields").alias("n_fields"))


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS deep, CAST(3 AS INTEGER) AS n_fields FROM part WHERE p_partkey % 3 <> 0""")
def api_fields(table):
    """SRC15, JSN2: records ten levels deep; a page that doesn't parse is skipped."""
    deep = _cat('{"a":' * 9, '"', F.col("p_name"), '"', "}" * 9)
    body = F.when(_key() % 3 == 0, "{").otherwise(_cat('{"data":[{"id":', _key(), ',"x":', deep, ',"y":[1]}]}'))
    rows = payloads.api_records(table("part").select(body.alias("body")))
    return rows.select(F.try_element_at("fields", F.lit("id")).alias("id"), F.try_element_at("fields", F.lit("x" + ".a" * 9)).alias("deep"), F.size("fields").alias("n_fields"))


# Listings in HTML


@_query("""SELECT p_partkey, 'https://h.com/job/' || p_partkey AS detail_url, p_name AS title, p_brand AS raw_location, 'May 1, 2024' AS post_date, CAST(p_partkey AS VARCHAR) AS posting_id FROM part""")
def table_listing(table):
    """SRC18: rows without a link are dropped, repeated ones count once."""
    row = _cat('<tr class="x data-row"><td><a class="t" href="/job/', _key(), '">', F.col("p_name"), '</a></td><td class="jobLocation"> ', F.col("p_brand"), '</td><td class="jobDate">May 1, 2024</td></tr>')
    pages = table("part").select("p_partkey", F.lit("https://h.com/list").alias("url"), _cat("<table>", row, row, '<tr class="data-row"><td>none</td></tr></table>').alias("html"))
    return page_sources.table_rows(pages, "p_partkey").drop("ordinal")


@_query("""SELECT p_partkey, p_name AS title, 'https://h.com/j/' || p_partkey AS detail_url, p_brand AS location, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS shift FROM part""")
def card_listing(table):
    """SRC19: labels and the values after them; title and host are required."""
    card = _cat('<div class="job-card"><a href="/j/', _key(), '">', F.col("p_name"), "</a><br><p>Location:</p><p>", F.col("p_brand"), "</p>", F.when(_key() % 2 == 0, _cat("<p>Shift:</p><p>", F.col("p_type"), "</p>")).otherwise(F.lit("")), "</div>")
    pages = table("part").select("p_partkey", F.lit("https://h.com/list").alias("url"), _cat(card, '<div class="job-card"><a href="https://other.com/1">no</a></div><div class="job-card"><a href="/j/2"> </a></div>').alias("html"))
    return page_sources.cards(pages, "p_partkey", ["Location:", "Shift:"], host="h.com").drop("ordinal")


@_query("""SELECT CAST(k AS VARCHAR) AS posting_id, min(p_partkey) AS p_partkey, 'https://h.com/j/' || k AS detail_url FROM (SELECT p_partkey, p_partkey % 300 AS k FROM part) GROUP BY k""")
def anchor_listing(table):
    """SRC20: anchors that carry a job's id, unique by it."""
    pages = table("part").select("p_partkey", F.lit("https://h.com/list").alias("url"), _cat("<a href='/x'>no</a><a data-job-id=\"", _key() % 300, '" href="/j/', _key() % 300, '">T</a>').alias("html"))
    return page_sources.job_id_anchors(pages, "p_partkey").select("posting_id", "p_partkey", "detail_url")


# What is written and read again


@_query("SELECT 'https://x/' || p_partkey AS url FROM part")
def url_lines(table):
    """SNK6, SRC21."""
    rows = table("part").select(_cat(" https://x/", _key(), " ").alias("u"))
    path = tables.work_path(rows.sparkSession, "lines")
    tables.write_lines(rows.union(rows.limit(1).select(F.lit("  "))), "u", path)
    return tables.url_list(rows.sparkSession, path)


@_query("""SELECT 'v' AS vendor, p_name AS title, p_retailprice AS salary, p_type || ', "q"' || chr(10) || 'next' AS text FROM part""")
def csv_back(table):
    """SNK1, SRC22, PRJ15: canonical rows as CSV, and some columns of it under new names."""
    rows = table("part").select(*[{"vendor": F.lit("v"), "position_title": F.col("p_name"), "description": _cat(F.col("p_type"), ', "q"\nnext'), "salary_min": F.col("p_retailprice")}.get(c, F.lit(None).cast("string")).alias(c) for c in canonical.COLUMNS])
    path = tables.work_path(rows.sparkSession, "csv")
    tables.write_csv(canonical.to_display(rows), path, canonical.DISPLAY_NAMES)
    back = tables.wide_csv(rows.sparkSession, path, {"Vendor": "vendor", "Position Title": "title", "Salary Min (USD/yr)": "salary", "Description": "text"})
    return back.withColumn("salary", F.col("salary").cast("double"))


@_query("""SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS kind FROM part""")
def full_csv_back(table):
    """SNK2: all columns, what a map holds beside them as JSON."""
    extra = F.when(_key() % 2 == 0, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand")))
    rows = table("part").select("p_partkey", extra.alias("extra"))
    path = tables.work_path(rows.sparkSession, "full")
    tables.write_full_csv(rows, path)
    back = tables.wide_csv(rows.sparkSession, path, ["p_partkey", "extra"])
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), *[F.get_json_object("extra", f"$.{c}").alias(c) for c in ("brand", "kind")])


@_query("""SELECT 'orders' AS vendor, o_orderkey AS id, o_orderstatus AS state, NULL AS name FROM orders UNION ALL SELECT 'parts', p_partkey, NULL, p_name FROM part""")
def combined_csv(table):
    """SNK3, SET1: rows of all vendors in one export; a column that one lacks is empty there."""
    orders = table("orders").select(F.lit("orders").alias("vendor"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    both = tables.union_all(orders, table("part").select(F.lit("parts").alias("vendor"), _key().alias("id"), F.col("p_name").alias("name")))
    path = tables.work_path(both.sparkSession, "combined")
    tables.write_csv(both, path, ["vendor", "id", "state", "name"])
    return tables.wide_csv(both.sparkSession, path, ["vendor", "id", "state", "name"]).withColumn("id", F.col("id").cast("long"))


@_query("""SELECT CAST(o.o_custkey AS VARCHAR) AS key, f.k AS kept_o_orderkey, o.o_orderkey AS dropped_o_orderkey, 'orders' AS source FROM orders o
JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) f ON o.o_custkey = f.o_custkey WHERE o.o_orderkey <> f.k""")
def report_back(table):
    """SNK4, WIN2: the dedupe report; an empty one isn't written."""
    pairs = dedupe.dropped_pairs(table("orders"), F.col("o_custkey").cast("string"), "o_orderkey", "o_orderkey")
    spark = pairs.sparkSession
    path, none = tables.work_path(spark, "report"), tables.work_path(spark, "report")
    if not tables.write_report(pairs, "orders", path) or tables.write_report(pairs.limit(0), "orders", none):
        raise RuntimeError("only a report with rows is written")
    back = tables.wide_csv(spark, path, ["key", "kept_o_orderkey", "dropped_o_orderkey", "source"])
    return back.withColumns({c: F.col(c).cast("long") for c in ("kept_o_orderkey", "dropped_o_orderkey")})


@_query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS "a[0].n", p_brand AS b, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS c FROM part""")
def pivoted_fields(table):
    """SNK5, JSN2: a column for each path, in order of name."""
    doc = F.try_parse_json(F.to_json(F.struct(F.array(F.struct(_size().alias("n"))).alias("a"), F.col("p_brand").alias("b"), F.when(_key() % 2 == 0, F.col("p_type")).alias("c"))))
    long = json_paths.flatten(table("part").select("p_partkey", doc.alias("doc")), F.col("doc"), "p_partkey", indexed=True)
    return tables.pivoted(long, "p_partkey")


@_query("""SELECT count(DISTINCT user_id % 7) AS n_scrapers, (SELECT count(*) FROM orders) AS total_jobs, '2024-03-01' AS generated_at FROM events""")
def metrics_json(table):
    """SNK8: a run's metrics as one JSON text, read again."""
    made = runs.snapshot_json(_measured(table), F.lit("2024-03-01"), table("orders"))
    path = tables.work_path(made.sparkSession, "metrics")
    tables.write_lines(made, "json", path)
    back = F.from_json("value", "scrapers map<string,string>, total_jobs long, generated_at string")
    return made.sparkSession.read.text(path).select(back.alias("j")).select(F.size("j.scrapers").cast("long").alias("n_scrapers"), "j.total_jobs", "j.generated_at")


@_query("SELECT s_suppkey AS company, 'https://x/' || s_suppkey AS sitemap, [s_name, 'b'] AS samples FROM supplier")
def probe_json_back(table):
    """SNK10, D14."""
    rows = table("supplier").select(F.col("s_suppkey").alias("company"), _cat("https://x/", F.col("s_suppkey")).alias("sitemap"), F.array(F.col("s_name"), F.lit("b")).alias("samples"))
    path = tables.work_path(rows.sparkSession, "probe")
    tables.write_json(rows, path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


@_query("""SELECT o_orderkey AS id, o_orderstatus AS state FROM orders ORDER BY o_orderkey DESC""")
def run_log_rows(table):
    """SRT5."""
    return runs.run_log(table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.lit("long text").alias("stdout")))


# Mappings


def _mapped(table, platform: str, maps: dict[str, dict[str, Column]], *columns: str) -> DataFrame:
    """Rows of parts, mapped by a platform's table from maps that are given by letter."""
    made = {letter: F.map_from_entries(F.array(*[F.struct(F.lit(k), _s(v)) for k, v in fields.items()])).alias(f"map_{letter}") for letter, fields in maps.items()}
    rows = table("part").select("p_partkey", *made.values())
    return mapping.normalize(rows, platform, {letter: f"map_{letter}" for letter in made}).select("p_partkey", *columns)


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'V' ELSE 'J' END || p_partkey AS posting_id, 'n' || p_size AS position_title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS raw_location, CASE WHEN p_partkey % 2 = 0 THEN 'R' END AS req_number FROM part""")
def phenom_sitemap_rows(table):
    """PRJ5: listing first, then the vendor's document, then JSON-LD; keys of the listing are passed on."""
    even = _key() % 2 == 0
    maps = {
        "L": {"posting_id": F.when(_key() % 3 == 0, _cat("L", _key())), "Req Number": F.when(even, "R"), "other": F.lit("x")},
        "V": {"jobId": F.when(_key() % 3 == 1, _cat("V", _key())), "jobTitle": _cat("n", _size()), "location": F.when(even, F.col("p_brand")).otherwise(" ")},
        "J": {"identifier.value": _cat("J", _key()), "title": F.lit("no")},
        "M": {"gtm_tbcn_location": F.col("p_type")},
    }
    rows = _mapped(table, "phenom_sitemap", maps, "posting_id", "position_title", "raw_location", "passed")
    return rows.withColumn("req_number", F.try_element_at("passed", F.lit("Req Number"))).drop("passed")


@_query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS posting_id, p_name AS position_title, p_brand AS raw_location FROM part""")
def phenom_search_rows(table):
    """PRJ6, EXT6, JSN5: the job is unwrapped from the page state before it is mapped."""
    doc = F.to_json(F.struct(F.struct(F.struct(_s(_key()).alias("reqId"), F.col("p_name").alias("title"), F.col("p_brand").alias("location")).alias("posting")).alias("position")))
    pages = table("part").select("p_partkey", _s(_key()).alias("url"), _cat("<script>phApp.ddo = ", F.when(_key() % 2 == 0, _cat('{"jobDetail":{"data":{"job":', doc, "}}}")).otherwise(doc), "; phApp.x = {};</script>").alias("html"))
    found = page_sources.detail_artifacts(pages, parts=("job_fields",))
    rows = found.select(F.col("detail_url").cast("long").alias("p_partkey"), "job_fields")
    return mapping.normalize(rows, "phenom_search", {"V": "job_fields"}).select("p_partkey", "posting_id", "position_title", "raw_location")


@_query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS posting_id, p_name AS position_title, p_brand AS raw_location, '2024-01-01' AS post_date, 'Full' AS full_time_status FROM part""")
def apply_v2_mapped(table):
    """PRJ7: the place is the listing's alone."""
    maps = {"L": {"posting_id": _key(), "raw_location": F.col("p_brand"), "title": F.lit("no")}, "J": {"title": F.col("p_name"), "datePosted": F.lit("2024-01-01"), "employmentType": F.lit("Full")}, "M": {"gtm_tbcn_location": F.lit("no")}}
    return _mapped(table, "apply_v2", maps, "posting_id", "position_title", "raw_location", "post_date", "full_time_status")


@_query("""SELECT p_partkey, 'paged_html' AS platform, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS position_title, 'M' AS raw_location FROM part
UNION ALL SELECT p_partkey, 'browser_paged_html', CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END, 'L' FROM part""")
def paged_rows(table):
    """PRJ8, PRJ9: JSON-LD's title first, or the page's heading, else the listing's."""
    even = _key() % 2 == 0
    paged = _mapped(table, "paged_html", {"L": {"title": F.col("p_type"), "raw_location": F.lit("L")}, "J": {"title": F.when(even, F.col("p_name"))}, "M": {"gtm_tbcn_location": F.lit("M"), "gtm_tbcn_division": F.lit("D")}}, "position_title", "raw_location")
    browser = _mapped(table, "browser_paged_html", {"L": {"title": F.col("p_type"), "h1": F.when(even, F.col("p_brand")).otherwise(""), "raw_location": F.lit("L")}}, "position_title", "raw_location")
    return paged.withColumn("platform", F.lit("paged_html")).unionByName(browser.withColumn("platform", F.lit("browser_paged_html")))


@_query("""SELECT p_partkey, p_name AS position_title, 'Mid' AS career_level, p_brand || chr(10) || 'two' AS description, 'Secret' AS clearance_level_must_possess FROM part""")
def encoded_mapped(table):
    """PRJ10, EXT10: bold blocks of the page beside the listing."""
    html = _cat("<h1>T</h1><p><b>Career Level:</b> Mid</p><b>description</b><ul><li>", F.col("p_brand"), "</li><li>two</li></ul>")
    pages = table("part").select("p_partkey", F.create_map(F.lit("title"), F.col("p_name"), F.lit("clearance"), F.lit("Secret")).alias("listing"), html.alias("html"))
    rows = pages.select("p_partkey", "listing", markup.bold_blocks(F.col("html")).alias("bold"))
    return mapping.normalize(rows, "encoded_api", {"L": "listing", "B": "bold"}).select("p_partkey", "position_title", "career_level", "description", "clearance_level_must_possess")


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS posting_id, p_name AS position_title, CASE WHEN p_partkey % 2 = 0 THEN 'https://p/' ELSE 'https://a/' END || p_partkey AS detail_url, p_type AS full_time_status, p_brand AS job_category, p_brand AS raw_location FROM part""")
def usajobs_mapped(table):
    """PRJ11: fields of the flattened document; of a list its first element."""
    item = F.try_variant_get(F.try_parse_json("body"), "$.SearchResult.SearchResultItems[0].MatchedObjectDescriptor", "variant")
    rows = _usajobs_payloads(table).select(json_paths.flat_fields(item, 3).alias("v"), F.try_variant_get(item, "$.PositionURI[0]", "string").alias("first"))
    rows = rows.select(F.when(F.col("first").isNotNull(), F.map_concat("v", F.create_map(F.lit("PositionURI.0"), F.col("first")))).otherwise(F.col("v")).alias("v"))
    return mapping.normalize(rows, "usajobs_api", {"V": "v"}).select("posting_id", "position_title", "detail_url", "full_time_status", "job_category", "raw_location")


_VENDORS = ["bae", "boeing", "booz_allen", "encoded_api", "hii", "l3harris", "leidos", "lockheed", "northrop", "rtx", "thales", "usajobs_api"]


@_query("""WITH v(vendor, posting_id, position_title, description, raw_location) AS (VALUES
('bae', 'L.posting_id', 'V.title', 'V.description', 'V.location'), ('boeing', 'L.posting_id', 'J.title', 'B.description', 'M.gtm_tbcn_location'), ('booz_allen', 'J.identifier.value', 'J.title', 'J.description', NULL),
('encoded_api', 'L.posting_id', 'L.title', 'B.description', 'L.raw_location'), ('hii', 'H.req_id', 'L.title', 'L.description', 'L.raw_location'), ('l3harris', 'M.job-ats-req-id', 'J.title', 'J.description', 'M.gtm_tbcn_location'),
('leidos', 'T.Job #:', 'L.title', 'L.description', 'T.Location:'), ('lockheed', 'L.posting_id', 'J.title', 'B.description', 'M.gtm_tbcn_location'), ('northrop', 'L.posting_id', 'L.title', 'V.job_description', 'L.raw_location'),
('rtx', 'L.posting_id', 'V.title', 'J.description', 'V.address'), ('thales', 'L.posting_id', 'J.title', 'J.description', 'M.gtm_tbcn_location'), ('usajobs_api', 'V.PositionID', 'V.PositionTitle', 'V.PositionSummary', 'V.PositionLocationDisplay'))
SELECT p_partkey, vendor, posting_id || ' ' || p_partkey AS posting_id, position_title || ' ' || p_partkey AS position_title, description || ' ' || p_partkey AS description, raw_location || ' ' || p_partkey AS raw_location FROM part, v""")
def vendor_rows(table):
    """PRJ12: twelve vendors; every field of each map tells its own name, so that the best source of a column shows."""
    out = None
    for vendor in _VENDORS:
        paths = {p for ps in mapping.SOURCES[vendor].values() for p in ps}
        maps = {letter: {p[2:]: _cat(f"{letter}.{p[2:]} ", _key()) for p in sorted(paths) if p[0] == letter} for letter in sorted({p[0] for p in paths})}
        columns = [c if c in mapping.SOURCES[vendor] else None for c in ("posting_id", "position_title", "description", "raw_location")]
        rows = _mapped(table, vendor, maps, *[c for c in columns if c]).withColumn("vendor", F.lit(vendor))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


# Filters, joins


@_query("""SELECT p_partkey, p_partkey % 4 < 3 AS is_posting FROM part""")
def posting_marks(table):
    """FLT8: URLs of postings, in any case, and others."""
    url = F.when(_key() % 4 == 0, _cat("https://x/JOB/", _key())).when(_key() % 4 == 1, _cat("https://x/careers/job/", _key())).when(_key() % 4 == 2, _cat("https://x/opportunities/", _key())).otherwise(_cat("https://x/jobless/", _key()))
    return table("part").select("p_partkey", urls.is_posting_url(url).alias("is_posting"))


@_query("""SELECT 'with' AS part, count(*) FILTER (p_partkey % 3 = 2) AS n FROM part UNION ALL SELECT 'without', count(*) FILTER (p_partkey % 3 <> 2) FROM part""")
def listed_with_url(table):
    """FLT11: rows with a URL, and those without."""
    good, bad = canonical.with_url(table("part").select(F.when(_key() % 3 == 0, "").when(_key() % 3 == 2, "u").alias("detail_url")))
    return good.agg(F.lit("with").alias("part"), F.count("*").alias("n")).union(bad.agg(F.lit("without"), F.count("*")))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'title' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 'id' END AS lacks FROM part""")
def strict_rows(table):
    """FLT12: what a strict posting lacks."""
    rows = table("part").select("p_partkey", F.when(_key() % 3 != 0, F.col("p_name")).alias("title"), F.when((_key() % 3 == 1) & (_key() % 2 == 0), "").otherwise("i").alias("id"))
    good, bad = canonical.strict_postings(rows, "title", "id")
    return good.select("p_partkey", F.lit(None).cast("string").alias("lacks")).union(bad.select("p_partkey", F.array_join("lacks", ",")))


@_query("""SELECT coalesce(nullif(event_type, 'view'), 'ok') AS status, count(*) AS n FROM events GROUP BY 1""")
def parse_outcomes(table):
    """FLT15: rows that were parsed, and counts of the others."""
    good, others = canonical.parsed_only(table("events").select(F.when(F.col("event_type") == "view", "ok").otherwise(F.col("event_type")).alias("status")))
    return good.agg(F.lit("ok").alias("status"), F.count("*").alias("n")).union(others)


@_query("""SELECT o_orderkey, o_orderpriority AS vendor FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 3 = 0 AND s.o_orderpriority = o.o_orderpriority AND s.o_custkey = o.o_custkey)""")
def new_by_url(table):
    """JON3: rows whose exact URL isn't stored for the vendor."""
    rows = table("orders").select("o_orderkey", F.col("o_orderpriority").alias("vendor"), _cat("https://x/", F.col("o_custkey")).alias("detail_url"))
    stored = incremental.SnapshotTable(rows.sparkSession, tables.work_path(rows.sparkSession, "stored"), buckets=4)
    stored.upsert(rows.where(F.col("o_orderkey") % 3 == 0).withColumn("dedupe_key", _s("o_orderkey")), F.lit("2024-01-01").cast("timestamp"), "o_orderkey")
    return incremental.skip_known(rows, stored, key="detail_url").select("o_orderkey", "vendor")


@_query("""SELECT s_suppkey AS company, CASE WHEN s_suppkey % 2 = 0 THEN 'detail' WHEN s_suppkey % 3 = 0 THEN 'search' ELSE 'none' END AS step FROM supplier""")
def probe_steps(table):
    """JON7: the next step of each company."""
    k = F.col("s_suppkey")
    best = table("supplier").select(k.alias("company"), F.array(_cat("u", k)).alias("samples"), F.when(k % 3 == 0, "s").alias("search"))
    return probe.probe_plan(best, table("supplier").where(k % 2 == 0).select(_cat("u", k).alias("url"))).select("company", "step")


@_query("""SELECT DISTINCT unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['Geo City', 'Geo Country Code'] ELSE ['Geo Road'] END) AS name FROM supplier""")
def enriched_columns(table):
    """AGG9, EXT16: columns that places add."""
    record = F.when(F.col("s_suppkey") % 2 == 0, '{"address":{"city":"x","country_code":"y"}}').otherwise('{"address":{"road":"z"}}')
    return enrichment.new_columns(table("supplier").select(markup.geo_record(F.try_parse_json(record))["address"].alias("a")), "a")


# Text and pages


@_query("""SELECT p_partkey, CAST(greatest(p_size, 2) AS INTEGER) AS last_page, CAST(CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 25 END AS INTEGER) AS page_size, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1000 + p_size ELSE 25 END AS INTEGER) AS total, CAST(1000 + p_size AS INTEGER) AS seen, CAST(ceil((1000 + p_size) / 25.0) AS INTEGER) AS pages FROM part""")
def pager_numbers(table):
    """AGG7, EXT14, EXT15."""
    links = _cat('<a href="?page=2">', '<a href="/l?x=1&page=', _size(), '">')
    label = F.when(_key() % 2 == 0, _cat("Results 1 – 10 of ", _size() + 1000)).otherwise("none")
    seen = markup.visible_total(_cat("1 - 25 of 1,0", F.lpad(_s(_size()), 2, "0"), " jobs"), 25)
    pager = markup.pager(label)
    return table("part").select("p_partkey", markup.last_page(links).alias("last_page"), pager["page_size"].alias("page_size"), pager["total"].alias("total"), seen["total"].alias("seen"), seen["pages"].alias("pages"))


@_query("""SELECT p_partkey, array_to_string(list_filter(['(?i)tin', 'STEEL', 'zzz', '(?i)brass'], lambda p: CASE p WHEN 'STEEL' THEN contains(p_type, 'STEEL') WHEN '(?i)tin' THEN contains(upper(p_type), 'TIN') WHEN '(?i)brass' THEN contains(upper(p_type), 'BRASS') ELSE FALSE END)[1:2], ',') AS hits,
  p_brand AS brand FROM part""")
def page_patterns(table):
    """AGG10: the patterns that match, in the list's order, so many at most."""
    found = markup.matched_patterns(F.col("p_type"), ["(?i)tin", "STEEL", "zzz", "(?i)brass"], 2)
    return table("part").select("p_partkey", F.array_join(found, ",").alias("hits"), F.col("p_brand").alias("brand"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '…' || repeat('a', 5) || 'KEY' || p_size || repeat('b', 5 - length(CAST(p_size AS VARCHAR))) || '…' ELSE repeat('a', 30) END AS excerpt FROM part""")
def excerpts(table):
    """CLS5: the text around the first pattern that matches; without one the beginning."""
    body = F.when(_key() % 2 == 0, _cat("a" * 50, "KEY", _size(), "b" * 50)).otherwise("a" * 50)
    return table("part").select("p_partkey", text.excerpt(body, ["none", "KEY"], context=5, longest=30).alias("excerpt"))


@_query("""SELECT p_partkey, CAST(100000 + p_partkey AS VARCHAR) AS job_id, ['Senior', 'Data', 'Engineer'] AS words FROM part""")
def url_words(table):
    """URL7: stop words are those of Spark ML."""
    found = urls.url_tokens(_cat("https://x/job/", _key() + 100000, "/Senior-Data_of%20the+Engineer-between-should_yourselves-in"))
    return table("part").select("p_partkey", found["job_id"].alias("job_id"), found["slug_words"].alias("words"))


@_query("""SELECT p_partkey, p_name || chr(10) || 'a < b & c' || chr(10) || 'x' || chr(10) || chr(10) || 'y' AS text, p_brand AS stripped FROM part""")
def built_texts(table):
    """TXT1, TXT2: markup to text, and white space of all kinds."""
    html = _cat("<style>p{}</style><p>  ", F.col("p_name"), "</p><script>var s = '<p>no</p>';</script>a &lt; b&nbsp;&amp; c<br/>x<!-- no --></div><p></p><p></p><p></p>y ")
    return table("part").select("p_partkey", text.html_to_text(html).alias("text"), text.strip(_cat("\t \n", F.col("p_brand"), " \r\n")).alias("stripped"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'BS in ' || p_brand END AS required_education, p_name || chr(10) || 'two' AS required_skills, CASE WHEN p_partkey % 3 = 0 THEN 'nice' END AS preferred_skills FROM part""")
def built_sections(table):
    """ENR1, ENR2: sections by their headings, bullets one a line."""
    body = _cat("Intro\n", F.when(_key() % 2 == 0, _cat("Basic Qualifications:\nBS in ", F.col("p_brand"), "\nBenefits\nnone\n")).otherwise(F.lit("")), "required skills\n - ", F.col("p_name"), "\n • two;\n\nPay\n", F.when(_key() % 3 == 0, "Nice to Have\nnice\n").otherwise(""))
    found = sections.education_and_skills(body)
    return table("part").select("p_partkey", found["required_education"].alias("required_education"), found["required_skills"].alias("required_skills"), found["preferred_skills"].alias("preferred_skills"))


@_query("""SELECT p_partkey, p_name AS dug, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS unwrapped, p_type AS bare FROM part""")
def dug_values(table):
    """JSN3, JSN4, JSN5, PRJ3."""
    doc = F.try_parse_json(_json(a=F.struct(F.struct(F.col("p_name").alias("c")).alias("b")), jobDetail=F.when(_key() % 2 == 0, F.struct(F.struct(F.col("p_brand").alias("v")).alias("job"))), v=F.array("p_type", "p_name")))
    bare = json_paths.strip_prefix(F.create_map(F.lit("ld.x"), F.col("p_type"), F.lit("y"), F.lit("z")), "ld.")
    return table("part").select("p_partkey", json_paths.dig(doc, "a", "b", "c", kind="string").alias("dug"), text.first_any(json_paths.dig(doc, "none"), json_paths.dig(json_paths.unwrap(doc), "v")).alias("unwrapped"), F.try_element_at(bare, F.lit("x")).alias("bare"))


@_query("""SELECT p_partkey, CAST(length(p_type) AS INTEGER) AS n_deep, p_name AS leaf FROM part""")
def deep_leaves(table):
    """JSN1: documents of any depth; lists of scalars are one leaf."""
    doc = F.try_parse_json(_cat('{"a":[{"b":' * 6, '["', F.col("p_name"), '"]', "}]}" * 6))
    long = json_paths.flatten(table("part").select("p_partkey", F.length("p_type").alias("n_deep"), doc.alias("doc")), F.col("doc"), "p_partkey", "n_deep")
    return long.where(F.col("path") == ".".join(["a.0.b"] * 6)).select("p_partkey", "n_deep", F.col("value").alias("leaf"))


def _pages_of_parts(table) -> DataFrame:
    """Pages with everything that a posting's page may hold."""
    ld = _json(**{"@type": F.lit("JobPosting"), "title": F.col("p_name"), "datePosted": F.lit("2024-02-01"), "jobLocation": F.array(F.struct(F.struct(F.col("p_brand").alias("addressLocality")).alias("address"))), "description": _cat("<p>About ", _key(), "</p>")})
    html = _cat(
        '<html><head><meta name="gtm_tbcn_location" content="', F.col("p_type"), '"><meta content="no" name="gtm_tbcn_location"><link rel="canonical" href="https://h.com/c/', _key(), '"><script type="application/ld+json">', ld, "</script>",
        "<script>dataLayer.push({'size': '", _size(), "'}); phApp.ddo = {\"eagerLoadRefineSearch\":{\"totalHits\":", _size(), "}};</script><script type=\"text/javascript\">var x = {\"@type\": \"JobPosting\", \"note\": \"} <b>", _key(), '</b>"}; f({});</script>',
        '<code id="smartApplyData">{&quot;positions&quot;:[{&quot;id&quot;:', _key(), '}]}</code></head><body><h1>H ', _key(), "</h1><div class='career-detail-description'><b>Level:</b> ", _size(), "</div><b>Menu</b> no</body></html>",
    )
    return table("part").select(F.lpad(_s(_key()), 10, "0").alias("sort"), _cat("https://h.com/job/", _key()).alias("url"), html.alias("html"))


@_query("""SELECT 'https://h.com/job/' || p_partkey AS detail_url, 'https://h.com/c/' || p_partkey AS canonical_url, 'H ' || p_partkey AS h1, p_type AS place, p_brand AS city, CAST(p_size AS VARCHAR) AS size, CAST(p_size AS INTEGER) AS hits, CAST(p_partkey AS VARCHAR) AS applied, CAST(p_size AS VARCHAR) AS level, '} <b>' || p_partkey || '</b>' AS note, p_name AS ld_title, 'JSON_LD' AS source FROM part""")
def posting_parts(table):
    """SRC3, EXT1, EXT2, EXT4, EXT5, EXT6, EXT7, EXT8, EXT9, EXT10, CLS2, D5."""
    pages = _pages_of_parts(table)
    found = page_sources.detail_artifacts(pages, parts=("html", "canonical_url", "h1", "meta", "jsonld", "datalayer", "smart_apply", "bold"))
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    html = F.col("html")
    return found.select("detail_url", "canonical_url", "h1", at("meta", "gtm_tbcn_location").alias("place"), at("jsonld", "jobLocation.0.address.addressLocality").alias("city"), at("datalayer", "size").alias("size"), markup.total_hits(markup.page_state(html)).alias("hits"), at("smart_apply", "positions.0.id").alias("applied"), at("bold", "Level").alias("level"),
        json_paths.dig(markup.embedded_posting(html), "note", kind="string").alias("note"), at(markup.json_ld_fields(html, 4), "ld.title").alias("ld_title"), markup.detail_source(markup.signals(html), F.lit(False), html != "").alias("source"))


@_query("""SELECT p_partkey, p_brand AS place, CAST(p_partkey AS VARCHAR) AS req_id, 'Part-Time' AS full_time_status, CASE WHEN p_partkey % 2 = 0 THEN 'Secret' ELSE 'None' END AS clearance FROM part""")
def labelled_fields(table):
    """EXT11, EXT12: labelled lines, and the head of a posting; the last of equal lines counts."""
    head = _cat("Req ID: ", _key(), "\nFull-Time\nPart-Time\nClearance Required: Secret\n", F.when(_key() % 2 == 1, "Clearance Required: None\n").otherwise(""), "Location: ", F.col("p_brand"))
    found = markup.head_fields(head)
    return table("part").select("p_partkey", text.labelled_line(head, "Location:").alias("place"), found["req_id"].alias("req_id"), found["full_time_status"].alias("full_time_status"), found["clearance_level_must_possess"].alias("clearance"))


@_query("""SELECT n_nationkey, n_nationkey + 0.5 AS lat, n_name AS display_name, n_name AS state, CASE WHEN n_nationkey % 2 = 0 THEN 3.0 END AS west FROM nation""")
def geo_rows(table):
    """EXT16, D12: a geocoder's records."""
    k = F.col("n_nationkey")
    record = _cat('{"lat":"', k, '.5","display_name":"', F.col("n_name"), '","address":{"state_name":"', F.col("n_name"), '"},"boundingbox":["1","2","3"', F.when(k % 2 == 0, ',"4"').otherwise(""), "]}")
    geo = markup.geo_record(F.try_parse_json(record))
    return table("nation").select("n_nationkey", geo["lat"].alias("lat"), geo["display_name"].alias("display_name"), F.try_element_at(geo["address"], F.lit("Geo State Name")).alias("state"), geo["west"].alias("west"))


@_query("""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'JSON_LD' WHEN 1 THEN 'PHAPP_DDO' WHEN 2 THEN 'SMARTAPPLY_EMBED' WHEN 3 THEN 'APP_STATE_EMBED' WHEN 4 THEN 'XHR_JSON_OR_HTML' WHEN 5 THEN 'SERVER_HTML' ELSE 'UNKNOWN' END AS source,
  CASE WHEN p_partkey % 7 = 4 THEN 'XHR' ELSE 'DOM' END AS highlight FROM part""")
def page_classes(table):
    """CLS1, CLS2, CLS4: where a posting's data comes from, by the marks of its page."""
    k = _key() % 7
    html = F.when(k == 0, '<script type="application/ld+json">{"@type":"JobPosting"}</script>phApp.ddo').when(k == 1, "phApp.ddo smartApplyData").when(k == 2, "smartApplyData window.__NUXT__").when(k == 3, 'id="__NEXT_DATA__"').otherwise('"JobPosting"')
    marks = markup.signals(html)
    return table("part").select("p_partkey", markup.detail_source(marks, k == 4, k == 5).alias("source"), markup.highlight_source(marks, k == 4, k == 5).alias("highlight"))


@_query("""SELECT s_suppkey AS page, CASE WHEN s_suppkey % 4 = 0 THEN 'ORACLE_HCM_API' WHEN s_suppkey % 4 = 1 THEN 'GENERIC_XHR_JSON' WHEN s_suppkey % 4 = 2 THEN 'DOM_ONLY' ELSE 'UNKNOWN' END AS source FROM supplier""")
def search_classes(table):
    """CLS3: the first service that a page's responses tell, else what kind of hits it had."""
    k = F.col("s_suppkey")
    pages = table("supplier").select(k.alias("page"), (k % 4 == 2).alias("dom_hits"))
    other = table("supplier").where(k % 4 < 2).select(k.alias("page"), F.lit(0).alias("ordinal"), F.lit("https://x/api").alias("url"), F.lit("{}").alias("body"))
    oracle = table("supplier").where(k % 4 == 0).select(k.alias("page"), F.lit(1).alias("ordinal"), F.when(k % 8 == 0, "https://x/hcmRestApi/resources/recruitingCE").otherwise("").alias("url"), F.when(k % 8 == 0, "").otherwise('{"requisitionList":[],"TotalJobsCount":1}').alias("body"))
    return probe.search_sources(pages, other.union(oracle))


# Whole runs and streams


@_query("""WITH r AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 5 = 0 THEN 'b' ELSE 'a' END AS vendor FROM part WHERE p_partkey % 7 <> 6)
SELECT vendor, CAST(p_partkey AS VARCHAR) AS dedupe_key, p_name AS position_title, 'https://h.com/c/' || p_partkey AS detail_url, '2024-02-01' AS post_date, p_type AS raw_location, 'About ' || p_partkey AS description, 'T' || CASE WHEN p_partkey % 7 < 3 THEN 1 ELSE 2 END AS seen FROM r""")
def two_runs(table):
    """SNK7 and the run itself: pages to stored postings, twice; what the first run stored is skipped by the second."""
    k = F.col("p_partkey")
    listing = table("part").select(F.when(k % 5 == 0, "b").otherwise("a").alias("vendor"), k.alias("ordinal"), _s(k).alias("posting_id"), F.lit("listed").alias("title"), F.when(k % 7 != 6, _cat("https://h.com/job/", k)).alias("detail_url"), "p_partkey")
    pages, spark = _pages_of_parts(table).drop("sort"), listing.sparkSession
    stored = incremental.SnapshotTable(spark, tables.work_path(spark, "postings"))
    for day, part in (("2024-02-10", listing.where(k % 7 < 3)), ("2024-02-20", listing)):
        runs_of_postings.run(stored, part.drop("p_partkey"), pages, "sitemap", F.lit(day).cast("date"))
    rows = stored.read()
    seen = F.when(F.col("first_seen").cast("date") == F.lit("2024-02-10").cast("date"), "T1").otherwise("T2")
    return rows.select("vendor", "dedupe_key", "position_title", "detail_url", "post_date", "raw_location", "description", seen.alias("seen"))


@_query("""WITH r AS (SELECT unnest(['phenom_search', 'encoded_api', 'usajobs_api']) AS platform, p_partkey, p_name, p_brand FROM part WHERE p_partkey % 4 > 0)
SELECT platform, CAST(p_partkey AS VARCHAR) AS posting_id, CASE WHEN p_partkey % 3 <> 2 THEN p_name END AS position_title, '2024-02-01' AS post_date, CASE platform WHEN 'usajobs_api' THEN 'U ' WHEN 'encoded_api' THEN 'B ' ELSE 'V ' END || p_brand AS description,
  CASE WHEN p_partkey % 3 = 2 THEN 'missing_required:Position Title' ELSE 'stored' END AS outcome FROM r""")
def platform_runs(table):
    """The run itself on platforms whose documents are page states, listings with labelled pages, and whole payloads; with a first day, and rejected rows."""
    k = _key()
    title, day = F.when(k % 3 != 2, F.col("p_name")), F.when(k % 4 == 0, "2023-12-01").otherwise("2024-02-01")
    url = _cat("https://h.com/job/", k)
    rows = table("part").select(F.lit("v").alias("vendor"), k.alias("ordinal"), _s(k).alias("posting_id"), F.lit("").alias("title"), url.alias("detail_url"), title.alias("real"), day.alias("day"), "p_brand")
    state = F.to_json(F.struct(F.struct(F.struct(title.alias("title"), day.alias("datePosted"), _cat("<p>V ", F.col("p_brand"), "</p>").alias("description")).alias("posting")).alias("position")))
    states = table("part").select(url.alias("url"), _cat("<script>phApp.ddo = ", state, ";</script>").alias("html"))
    labels = table("part").select(url.alias("url"), _cat("<div class='career-detail-description'><b>description:</b> B ", F.col("p_brand"), "</div>").alias("html"))
    plain = rows.drop("real", "day", "p_brand")
    payload = {"PositionID": F.col("posting_id"), "PositionTitle": F.col("real"), "PositionURI.0": F.col("detail_url"), "PublicationStartDate": F.col("day"), "PositionSummary": _cat("U ", F.col("p_brand"))}
    fields = F.create_map(*[x for n, c in payload.items() for x in (F.lit(n), c)])
    listings = {
        "phenom_search": (plain, states),
        "encoded_api": (rows.select("vendor", "ordinal", "posting_id", F.coalesce("real", F.lit("")).alias("title"), "detail_url", F.col("day").alias("post_date")), labels),
        "usajobs_api": (rows.select("vendor", "ordinal", "posting_id", "title", "detail_url", fields.alias("vendor_fields")), None),
    }
    done = []
    for platform, (listing, pages) in listings.items():
        stored = incremental.SnapshotTable(rows.sparkSession, tables.work_path(rows.sparkSession, platform), buckets=2)
        ran = runs_of_postings.run(stored, listing, pages, platform, F.lit("2024-02-10").cast("date"), first_day=F.lit("2024-01-01").cast("date"))
        columns = [F.lit(platform).alias("platform"), "posting_id", "position_title", "post_date", "description"]
        done += [stored.read().select(*columns, F.lit("stored").alias("outcome")), ran.rejected.select(*columns, F.array_join("errors", ",").alias("outcome"))]
    return tables.union_all(*done)


@_query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'b' ELSE 'a' END AS vendor, row_number() OVER (PARTITION BY p_partkey % 5 = 0 ORDER BY p_partkey) AS n FROM part),
c AS (SELECT * FROM r WHERE n <= 150), f AS (SELECT count(*) AS listed, count(*) FILTER (p_partkey % 4 = 1) AS known, count(*) FILTER (p_partkey % 4 <> 1 AND p_partkey % 3 > 0) AS parsed, count(*) FILTER (p_partkey % 4 <> 1 AND p_partkey % 3 = 2) AS rejected FROM c)
SELECT unnest(['listed', 'known', 'new', 'parsed', 'rejected', 'keyless', 'stored']) AS name, CAST(unnest([listed, known, listed - known, parsed, rejected, 0, parsed - rejected]) AS DOUBLE) AS total FROM f""")
def run_counts(table):
    """AGG2, WIN5: a run's counters, observed as it writes; with a cap, a first day and rejected rows."""
    k = _key()
    rows = table("part").select(F.when(k % 5 == 0, "b").otherwise("a").alias("vendor"), k.alias("ordinal"), _s(k).alias("posting_id"), F.lit("listed").alias("title"), _cat("https://h.com/job/", k).alias("detail_url"), "p_partkey")
    # One posting in three is too old, and one in three has no title.
    day = F.when(k % 3 == 0, "2023-01-01").otherwise("2024-02-01")
    ld = _json(**{"@type": F.lit("JobPosting"), "title": F.when(k % 3 != 2, F.col("p_name")), "datePosted": day, "description": F.lit("d")})
    pages = table("part").select(_cat("https://h.com/job/", k).alias("url"), _cat('<script type="application/ld+json">', ld, "</script>").alias("html"))
    spark = rows.sparkSession
    stored = incremental.SnapshotTable(spark, tables.work_path(spark, "postings"), buckets=2)
    stored.upsert(rows.where(k % 4 == 1).select("vendor", F.col("posting_id").alias("dedupe_key"), F.col("title").alias("position_title"), "ordinal"), F.lit("2024-01-01").cast("timestamp"), "ordinal")
    listing = rows.drop("p_partkey").withColumn("title", F.lit(""))
    done = runs_of_postings.run(stored, listing, pages, "sitemap", F.lit("2024-02-10").cast("date"), cap=150, first_day=F.lit("2024-01-01").cast("date"))
    return runs.metrics(done.metrics("parts", F.lit(1))).select("name", "total")


@_query("""SELECT p_partkey, p_name AS position_title, 'https://h.com/job/' || p_partkey AS detail_url, '2024-02-01' AS post_date, 104000.0 AS salary_min, 'About ' || p_partkey AS description, 'one' || chr(10) || 'two' AS required_skills, 0.0 AS bonus FROM part""")
def canonical_parts(table):
    """PRJ1, D1: raw rows to canonical ones."""
    raw = table("part").select("p_partkey", F.col("p_name").alias("position_title"), _cat("https://h.com/job/", _key(), "?a=b#c").alias("detail_url"), F.lit("2024/02/01").alias("post_date"), F.lit("$50/hr").alias("salary_raw"), _cat("<p>About ", _key(), "</p>").alias("description"), F.lit("one\ntwo").alias("required_skills"), F.lit("x").alias("bonus"))
    rows = canonical.canonicalize(raw, F.lit("v"), F.lit("2024-03-01").cast("date"), keep=("p_partkey",))
    return rows.select("p_partkey", "position_title", "detail_url", "post_date", "salary_min", "description", "required_skills", "bonus")


def _staged(rows: DataFrame, name: str, kind: str = "parquet") -> tuple[str, str]:
    """Files that a stream reads, and a place for what it keeps."""
    path = tables.work_path(rows.sparkSession, name)
    rows.repartition(4).write.format(kind).save(path)
    return path, tables.work_path(rows.sparkSession, f"{name}-stream")


def _in_turn(rows: DataFrame, path: str, by: str) -> None:
    """Add files that a stream takes one after another, one for each value of a column of few numbers, in their order.

    A stream takes files in the order of their times, so each is written after the one before it.
    """
    spark, staged = rows.sparkSession, tables.work_path(rows.sparkSession, "in-turn")
    rows.repartition(by).write.partitionBy(by).parquet(staged)
    for k in sorted(r[0] for r in rows.select(by).distinct().collect()):  # a dozen values
        spark.read.schema(rows.drop(by).schema).parquet(f"{staged}/{by}={k}").coalesce(1).write.mode("append").parquet(path)


def _one_by_one(rows: DataFrame, path: str, by: str) -> DataFrame:
    """The stream of such files, a batch for each."""
    return rows.sparkSession.readStream.schema(rows.drop(by).schema).option("maxFilesPerTrigger", 1).parquet(path)


@_query("""WITH l AS (SELECT o_orderpriority, o_custkey, o_orderkey % 4 AS batch, min(o_orderkey) AS first FROM orders GROUP BY 1, 2, 3)
SELECT o_orderpriority AS vendor, CAST(o_custkey AS VARCHAR) AS dedupe_key, 'T ' || max_by(first, batch) AS position_title, '2024-02-01' AS first_seen, '2024-02-01' AS updated_at FROM l GROUP BY 1, 2""")
def stream_ingested(table):
    """STR1: captured batches to stored postings; a batch that is given again after others, on another day, changes nothing."""
    rows = table("orders").select(F.col("o_orderpriority").alias("vendor"), _s("o_custkey").alias("posting_id"), _cat("T ", F.col("o_orderkey")).alias("position_title"), F.lit("https://x/").alias("detail_url"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 4).alias("batch"))
    spark = rows.sparkSession
    path, kept = (tables.work_path(spark, n) for n in ("batches", "ingested"))
    stored = incremental.SnapshotTable(spark, f"{kept}/table", buckets=4)
    day = lambda d: F.lit(d).cast("date")
    take = lambda part, number: ingest.ingest_batch(part, number, stored, kept, F.col("vendor"), day("2024-02-01"))
    # What is there at a start is a batch, of however many files, so that all tasks share in it.
    for k in range(4):
        part = rows.where(F.col("batch") == k).drop("batch")
        part.write.mode("append").parquet(path)
        spark.readStream.schema(part.schema).parquet(path).writeStream.foreachBatch(take).option("checkpointLocation", f"{kept}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    ingest.ingest_batch(rows.where("batch = 0").drop("batch"), 0, stored, kept, F.col("vendor"), day("2024-03-01"))
    return stored.read().select("vendor", "dedupe_key", "position_title", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "updated_at")])


@_query("""WITH RECURSIVE k AS (SELECT DISTINCT user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS p FROM events),
-- A batch for each three days, whose rows have the first day's time; at the stop after the fifth one without rows goes by, at which keys are forgotten too.
periods AS (SELECT p, row_number() OVER (ORDER BY p) AS n FROM (SELECT DISTINCT p FROM k)),
batches AS (SELECT n + CASE WHEN n > 5 THEN 1 ELSE 0 END AS b, p FROM periods UNION ALL SELECT 6, NULL WHERE (SELECT count(*) FROM periods) >= 5),
marks AS (SELECT b, max(p) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * 72 - 36 AS watermark FROM batches),
forgotten AS (SELECT x.p, min(m.b) AS b FROM batches x JOIN marks m ON m.b > x.b AND m.watermark >= x.p * 72 + 36 WHERE x.p IS NOT NULL GROUP BY 1),
again AS (SELECT f.p, min(x.p) AS next FROM forgotten f JOIN batches x ON x.b > f.b AND x.p IS NOT NULL GROUP BY 1),
r AS (SELECT user_id, event_type, min(p) AS p FROM k GROUP BY 1, 2
  UNION ALL SELECT r.user_id, r.event_type, min(k.p) FROM r JOIN again a ON a.p = r.p JOIN k ON k.user_id = r.user_id AND k.event_type = r.event_type AND k.p >= a.next GROUP BY r.user_id, r.event_type, r.p)
SELECT user_id, event_type, p AS period FROM r""")
def stream_first_seen(table):
    """STR2: batches in order of time, a stop and a restart; a key comes out again once the watermark has forgotten it."""
    period = F.expr("datediff(to_date(ts), date'2024-01-01') div 3").cast("long")
    rows = table("events").select("user_id", "event_type", period.alias("period"))
    rows = rows.withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(CAST(period AS INT) * 3)"))
    spark = rows.sparkSession
    path, kept = (tables.work_path(spark, n) for n in ("events", "first-seen"))
    first = [r[0] for r in rows.select("period").distinct().orderBy("period").limit(5).collect()]
    for part in (rows.where(F.col("period").isin(first)), rows.where(~F.col("period").isin(first))):
        _in_turn(part, path, "period")
        found = ingest.first_seen(_one_by_one(rows, path, "period"), "ts", "36 hours", "user_id", "event_type")
        found.writeStream.format("parquet").option("path", f"{kept}/rows").option("checkpointLocation", f"{kept}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    came = spark.read.schema(rows.drop("period").schema).parquet(f"{kept}/rows")
    return came.select("user_id", "event_type", F.expr("datediff(to_date(ts), date'2024-01-01') div 3").cast("long").alias("period"))


@_query("""WITH o AS (SELECT user_id AS company_id, event_id AS ts, event_type = 'purchase' AS ok, CASE WHEN event_id % 3 > 0 THEN 't' || event_id % 3 ELSE 'unknown' END AS type FROM events WHERE event_type IN ('error', 'purchase')), w AS (SELECT company_id, max(ts) FILTER (ok) AS last_success FROM o GROUP BY 1),
f AS (SELECT o.* FROM o JOIN w USING (company_id) WHERE NOT ok AND (last_success IS NULL OR ts > last_success))
SELECT w.company_id, w.last_success, max(f.ts) AS last_failure, max_by(f.type, f.ts) AS last_failure_type, count(f.ts) AS failure_count FROM w LEFT JOIN f USING (company_id) GROUP BY 1, 2""")
def stream_status(table):
    """STR3: states after all batches of a log, whose outcomes come in any order."""
    kind = F.when(F.col("event_id") % 3 > 0, _cat("t", F.col("event_id") % 3))
    rows = table("events").where(F.col("event_type").isin("error", "purchase")).select(F.col("user_id").alias("company_id"), F.col("event_id").alias("ts"), (F.col("event_type") == "purchase").alias("ok"), kind.alias("type"))
    spark = rows.sparkSession
    path, kept = _staged(rows, "outcomes")
    states = incremental.SnapshotTable(spark, f"{kept}/states", vendor="part", buckets=4)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    ingest.running_status(stream, states, f"{kept}/checkpoint").awaitTermination()
    return states.read().select("company_id", "last_success", "last_failure", "last_failure_type", "failure_count")


@_query("""WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS watermark FROM events)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(user_id % 3 AS VARCHAR) AS scraper, event_type AS name, count(*) AS n, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events, m
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= watermark GROUP BY 1, 2, 3""")
def stream_metrics(table):
    """STR4: hourly figures, each once its hour is closed; rows that come after that are dropped."""
    rows = table("events").select(F.col("ts").cast("timestamp").alias("ts"), _s(F.col("user_id") % 3).alias("scraper"), F.col("event_type").alias("name"), "value", F.expr("datediff(to_date(ts), date'2024-01-01') div 6").cast("long").alias("period"))
    ends = rows.agg(F.min("period"), F.max("period")).first()
    late = rows.where(F.col("period") == ends[0]).where(F.lit(ends[0] != ends[1])).withColumns({"value": F.col("value") + 1000, "period": F.lit(ends[1]).cast("long")})
    every, spark = rows.union(late), rows.sparkSession
    path, kept = (tables.work_path(spark, n) for n in ("metrics", "closed"))
    _in_turn(every, path, "period")
    figures = ingest.windowed_metrics(_one_by_one(every, path, "period"))
    figures.writeStream.outputMode("append").format("parquet").option("path", f"{kept}/figures").option("checkpointLocation", f"{kept}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    came = spark.read.schema(figures.schema).parquet(f"{kept}/figures")
    return came.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "scraper", "name", "n", F.round("sum", 4).alias("sum"), "min", "max")
