"""The registered queries of the posting library, by name, and their SQL.

The given tables hold no postings, so each operator runs on a table of the same
shape: orders as stored rows, customers as postings by vendor, pages as captured
pages, events as run logs and metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.functions import dates, json_paths, keys, markup, money, sections, text, urls
from postworks.operators import canonical, dedupe, enrichment, incremental, mapping, probe, query, runs
from postworks.sources import pages as page_sources
from postworks.sources import sitemaps
from postworks.sources.tables import work_path

FLAGSHIP = "search_page"
#: Tables whose rows stand for documents, of which a few MB hold a million: read as they lie, they would be one task's or two tasks' work.
COMPACT = {"part"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a function of a table reader as a query, with its SQL."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                return page_sources.dealt(rows) if name in COMPACT else rows

            return f(table)

        QUERIES[f.__name__] = run
        run.__doc__ = f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _postings(table) -> DataFrame:
    """Orders as postings: priority as vendor, customer as place."""
    return table("orders").select(
        F.col("o_orderpriority").alias("vendor"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("dedupe_key"),
        F.concat(F.lit("Order "), F.col("o_orderstatus"), F.lit(" "), F.col("o_custkey").cast("string")).alias("position_title"),
        F.lit("").alias("description"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("raw_location"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("post_date"),
        F.col("o_totalprice").alias("salary_min"),
    )


_POSTINGS_SQL = """p AS (SELECT o_orderpriority AS vendor, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS dedupe_key,
  'Order ' || o_orderstatus || ' ' || CAST(o_custkey AS VARCHAR) AS position_title, '' AS description, 'C' || CAST(o_custkey AS VARCHAR) AS raw_location,
  strftime(o_orderdate, '%Y-%m-%d') AS post_date, o_totalprice AS salary_min FROM orders)"""


@_query("SELECT c_mktsegment AS vendor, count(*) AS count FROM customer GROUP BY 1")
def vendor_counts(table):
    """AGG1, SRC23."""
    return query.vendor_counts(table("customer").withColumnRenamed("c_mktsegment", "vendor"))


@_query("SELECT DISTINCT c_mktsegment AS vendor FROM customer WHERE trim(c_mktsegment) <> ''")
def vendor_names(table):
    """SRT3."""
    return query.vendor_names(table("customer").withColumnRenamed("c_mktsegment", "vendor"))


@_query(f"WITH {_POSTINGS_SQL} SELECT * FROM p WHERE vendor = '1-URGENT' AND post_date >= '1995-01-01' AND lower(position_title) LIKE '%order o%' ORDER BY post_date DESC, dedupe_key LIMIT 50 OFFSET 50")
def search_page(table):
    """FLT1, FLT2, FLT4, SRT1, SRT2: the second page of a search."""
    return query.search(_postings(table), vendor="1-URGENT", q="Order O", since="1995-01-01", limit="50", offset="50")


@_query(f"WITH {_POSTINGS_SQL} SELECT * FROM p WHERE salary_min > 100000 OR (salary_min = 100000 AND dedupe_key > '0000000100') ORDER BY salary_min, dedupe_key LIMIT 50")
def keyset_page(table):
    """SRT2 in its form for deep pages."""
    return query.after(_postings(table), "salary_min", 100000, "dedupe_key", "0000000100", 50)


@_query(f"WITH {_POSTINGS_SQL} SELECT vendor, count(*) AS n FROM p WHERE CAST(post_date AS DATE) >= DATE '1998-01-01' - INTERVAL 30 DAY GROUP BY 1")
def preset_last_30(table):
    """FLT14."""
    return query.preset(_postings(table), "last_30", F.lit("1998-01-01").cast("date")).groupBy("vendor").agg(F.count("*").alias("n"))


@_query(f"WITH {_POSTINGS_SQL} SELECT * FROM p WHERE vendor = '2-HIGH' AND dedupe_key = '0000000004'")
def point_lookup(table):
    """FLT13: from the one file of a stored table that can hold the key."""
    found = _store(_postings(table).withColumn("ordinal", F.lit(1)), "2024-01-01").lookup("2-HIGH", "0000000004")
    return found.drop("first_seen", "updated_at")


@_query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice IS NOT NULL AND lower(p_name) LIKE '%blue%'")
def salary_filter(table):
    """FLT5, FLT6, SRT4."""
    rows = table("part").where(F.col("p_retailprice").isNotNull())
    return query.contains(rows, "p_name", "Blue").select("p_partkey", "p_name", "p_retailprice").orderBy("p_retailprice", "p_partkey")


@_query(f"WITH {_POSTINGS_SQL} SELECT position_title AS title, vendor, raw_location AS location, post_date AS posted FROM p")
def display_rows(table):
    """PRJ16."""
    rows = _postings(table).withColumns({c: F.lit(None).cast("string") for c in ("city", "state", "clearance_level_must_possess", "clearance_level_must_obtain", "salary_raw")})
    return query.display(rows).select("title", "vendor", "location", "posted")


# Keys, dates, money


_DATES = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN CAST(o_orderkey % 40 AS VARCHAR) || ' days ago' WHEN 3 THEN 'Yesterday' ELSE 'soon' END"


@_query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN strftime(DATE '2024-03-01' - CAST(o_orderkey % 40 AS INTEGER), '%Y-%m-%d') WHEN 3 THEN '2024-02-29' END AS post_date FROM (SELECT *, {_DATES} AS raw FROM orders)""")
def post_dates(table):
    """DAT1."""
    kind = F.col("o_orderkey") % 5
    raw = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")).when(kind == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(kind == 2, F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(" days ago"))).when(kind == 3, "Yesterday").otherwise("soon")
    return table("orders").select("o_orderkey", dates.parse_date(raw, F.lit("2024-03-01").cast("date")).alias("post_date"))


@_query(f"WITH {_POSTINGS_SQL} SELECT vendor, count(*) AS n FROM p WHERE post_date >= '1997-06-01' GROUP BY 1")
def since_normalized(table):
    """FLT3."""
    return canonical.since(_postings(table), F.lit("1997-06-01").cast("date"), F.lit("2024-03-01").cast("date")).groupBy("vendor").agg(F.count("*").alias("n"))


@_query("""WITH u AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '/hr' WHEN 1 THEN '/day' WHEN 2 THEN '/mo' ELSE '' END AS unit,
  CASE p_partkey % 4 WHEN 0 THEN 2080 WHEN 1 THEN 260 WHEN 2 THEN 12 ELSE 1 END AS f FROM part)
SELECT p_partkey, round(p_size * 1.0 * f, 2) AS low, round((p_size + 100) * 1.0 * f, 2) AS high FROM u""")
def salaries(table):
    """SAL1, SAL2, SAL3."""
    kind = F.col("p_partkey") % 4
    unit = F.when(kind == 0, "/hr").when(kind == 1, "/day").when(kind == 2, "/mo").otherwise("")
    raw = F.concat(F.lit("$"), F.col("p_size").cast("string"), unit, F.lit(" - $"), (F.col("p_size") + 100).cast("string"), unit)
    return table("part").select("p_partkey", money.salary(raw).alias("s")).select("p_partkey", "s.low", "s.high")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size * 12000.0 BETWEEN 1000 AND 1000000 THEN p_size * 12000.0 END ELSE p_size * 1000.0 END AS lower,
  CASE WHEN p_partkey % 3 = 2 THEN p_size * 1000.0 + 5000 END AS upper FROM part""")
def yearly_salaries(table):
    """SAL4."""
    kind = F.col("p_partkey") % 3
    thousands = F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(",000"))
    raw = F.when(kind == 0, F.concat(thousands, F.lit(" per hour"))).when(kind == 1, F.concat(thousands, F.lit(" per month"))).otherwise(F.concat(thousands, F.lit(" to $"), (F.col("p_size") + 5).cast("string"), F.lit(",000")))
    return table("part").select("p_partkey", money.yearly_only(raw).alias("s")).select("p_partkey", "s.lower", "s.upper")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN 'u' || CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS dedupe_key FROM orders""")
def dedupe_keys(table):
    """KEY1, KEY2, PRJ2."""
    kind = F.col("o_orderkey") % 3
    fields = F.create_map(F.lit("jobId"), F.when(kind == 0, F.col("o_orderkey").cast("string")).otherwise(""), F.lit("loc"), F.when(kind < 2, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).otherwise(""), F.lit("title"), F.col("o_orderstatus"))
    return table("orders").select("o_orderkey", keys.provisional_key(fields).alias("dedupe_key"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE s_acctbal END AS number, CASE WHEN s_suppkey % 4 <> 3 THEN '{\"other\":\"' || s_name || '\"}' END AS extra FROM supplier")
def coerced(table):
    """PRJ13, PRJ14."""
    raw = F.when(F.col("s_suppkey") % 4 == 3, F.lit("n/a")).otherwise(F.col("s_acctbal").cast("string"))
    fields = F.when(F.col("s_suppkey") % 4 == 3, F.create_map(F.lit("title"), F.col("s_name"))).otherwise(F.create_map(F.lit("title"), F.col("s_name"), F.lit("other"), F.col("s_name")))
    return table("supplier").select("s_suppkey", keys.as_number(raw).alias("number"), keys.unknown_as_json(fields, ["title"]).alias("extra"))


# URLs and pages


@_query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN regexp_extract(url, '^(https?://[^?#]*)', 1) END AS clean,
  regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS base, nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/(\d+)/?$', 1), '') AS number FROM pages""")
def page_urls(table):
    """URL1, URL2, URL6."""
    return table("pages").select("page_id", urls.normalize_url(F.col("url")).alias("clean"), urls.base_url(F.col("url")).alias("base"), urls.trailing_number(urls.normalize_url(F.col("url"))).alias("number"))


@_query(r"""SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1] AS posting_id, FALSE AS is_posting FROM pages""")
def posting_ids(table):
    """URL5; none of these URLs is a posting's (FLT8 has a query of its own)."""
    return table("pages").select("page_id", urls.posting_id(F.col("url")).alias("posting_id"), urls.is_posting_url(F.col("url")).alias("is_posting"))


@_query(r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || '?' || CASE WHEN url LIKE '%page=2&ref=x%' THEN 'page=7&ref=x' WHEN url LIKE '%utm_source=feed%' THEN 'utm_source=feed&page=7' ELSE 'page=7' END
  || regexp_extract(url, '(#.*)$', 1) AS next_page FROM pages""")
def next_page_urls(table):
    """URL4."""
    return table("pages").select("page_id", urls.set_query(F.col("url"), {"page": F.lit(7)}).alias("next_page"))


@_query(r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, base || href AS detail_url FROM a WHERE href LIKE '/%'""")
def page_links(table):
    """SRC16, URL3, FLT7, WIN3."""
    return page_sources.page_links(page_sources.spread(table("pages")), "page_id", needle="://").select("page_id", "detail_url")


@_query(r"""WITH a AS (SELECT page_id, base || href AS u FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"', 1)) AS href FROM pages)),
d AS (SELECT DISTINCT page_id, u FROM a), f AS (SELECT page_id, u, row_number() OVER (PARTITION BY u ORDER BY page_id) AS n FROM d)
SELECT page_id, count(*) AS got, count(*) FILTER (n = 1) AS added FROM f GROUP BY 1""")
def page_link_counts(table):
    """SRC17."""
    return page_sources.link_counts(page_sources.page_links(page_sources.spread(table("pages")), "page_id", needle="://"), "page_id")


@_query(r"""SELECT page_id, nullif(trim(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') AS h1,
  contains(html, '"JobPosting"') AS has_posting FROM pages""")
def page_titles(table):
    """EXT3, CLS1."""
    return table("pages").select("page_id", markup.h1_text(F.col("html")).alias("h1"), F.array_contains(markup.signals(F.col("html")), "json_ld").alias("has_posting"))


#: Markup to text in SQL, one replacement after another.
_TEXT_SQL = "coalesce(html, '')"
for _pattern, _to in [(r"(?is)<script\b[^>]*>.*?</script\s*>", ""), (r"(?is)<style\b[^>]*>.*?</style\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<\s*/?\s*br\b[^>]*>|</\s*(p|div|li|h[1-6]|tr|ul|ol)\s*>", "\n"), (r"(?s)<[^>]*>", ""), ("&nbsp;|\u00a0", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&ndash;", "–"), ("&mdash;", "—"), ("&bull;", "•"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]:
    _TEXT_SQL = f"regexp_replace({_TEXT_SQL}, '{_pattern}', '{_to}', 'g')"


@_query(f"SELECT page_id, {_TEXT_SQL} AS text FROM pages")
def page_texts(table):
    """TXT1."""
    return page_sources.spread(table("pages")).select("page_id", text.html_to_text(F.col("html")).alias("text"))


@_query()
def page_artifacts(table):
    """SRC3, EXT1, EXT2, EXT4, EXT5, EXT6, EXT10, CLS2: which parts each page has."""
    pages = page_sources.spread(table("pages"))
    found = page_sources.detail_artifacts(pages, parts=("html", "vendor_blob", "jsonld", "meta", "datalayer", "canonical_url", "bold"))
    marks = markup.signals(F.col("html"))
    return found.select("detail_url", F.size("meta").alias("n_meta"), F.size("datalayer").alias("n_layer"), F.col("vendor_blob").isNotNull().alias("has_state"), F.col("jsonld").isNotNull().alias("has_ld"), "canonical_url", F.size("bold").alias("n_labels"), markup.detail_source(marks, F.lit(False), F.col("html") != "").alias("source"))


_XML = "concat('<urlset><url><loc>', replace(url, '&', '&amp;'), '</loc></url><url><loc> ', split_part(replace(url, '&', '&amp;'), '#', 1), '/x </loc><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url></urlset>')"


@_query("""SELECT page_id, CAST(0 AS INTEGER) AS ordinal, url AS loc, '' AS lastmod FROM pages
UNION ALL SELECT page_id, 1, split_part(url, '#', 1) || '/x', '2024-01-01' FROM pages""")
def sitemap_entries(table):
    """SRC4."""
    documents = table("pages").select("page_id", F.expr(_XML).alias("xml"))
    return sitemaps.sitemap_urls(documents, "page_id")


@_query(r"""WITH h AS (SELECT url, page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS sitemap FROM pages)
SELECT sitemap, count(*) AS n_urls, count(*) FILTER (contains(url, '/en/')) AS n_matched, count(DISTINCT url) FILTER (contains(url, '/en/')) AS n_unique,
  list_slice(list(url ORDER BY page_id) FILTER (contains(url, '/en/')), 1, 3) AS samples FROM h GROUP BY 1""")
def sitemap_totals(table):
    """AGG3, WIN8; English pages stand for postings."""
    rows = table("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("sitemap"), F.col("url").alias("real"), F.when(F.col("url").contains("/en/"), F.concat(F.col("url"), F.lit("/job/"))).otherwise(F.col("url")).alias("loc"), F.col("page_id").alias("ordinal"))
    found = probe.sitemap_totals(rows, samples=3)
    return found.withColumn("samples", F.transform("samples", lambda u: F.regexp_replace(u, "/job/$", "")))


_SCAN_SQL = """WITH c AS (SELECT DISTINCT 'i' || o_custkey % 5 AS index, o_orderkey % 30 AS child FROM orders), u AS (SELECT 'i' || o_custkey % 5 AS index, o_orderkey % 30 AS child, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'https://x/about/' ELSE 'https://x/job/' END || o_custkey AS loc FROM orders WHERE o_orderkey % 30 % 11 <> 3),
n AS (SELECT c.index, c.child, row_number() OVER (PARTITION BY c.index ORDER BY c.child) AS turn, k.n FROM c LEFT JOIN (SELECT index, child, count(*) AS n FROM u GROUP BY 1, 2) k USING (index, child)),
s AS (SELECT * FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY index ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n WHERE turn <= 20) WHERE used < 550),
r AS (SELECT u.* FROM u JOIN s USING (index, child)),
f AS (SELECT {group}, loc, count(*) AS n, min((child, o_orderkey)) AS place FROM r WHERE contains(loc, '/job/') GROUP BY {group}, loc)
SELECT {group}, t.n_children, t.n_urls, coalesce(m.n_matched, 0) AS n_matched, coalesce(m.n_unique, 0) AS n_unique, coalesce(m.kept[1:3], []) AS samples, coalesce(m.kept, []) AS kept
FROM (SELECT {group}, count(*) AS n_children, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_urls FROM s GROUP BY {group}) t
LEFT JOIN (SELECT {group}, CAST(sum(n) AS BIGINT) AS n_matched, count(*) AS n_unique, (list(loc ORDER BY place))[1:{stored}] AS kept FROM f GROUP BY {group}) m USING ({group})"""


def _scan(table) -> tuple[DataFrame, DataFrame]:
    """Five indexes of thirty sitemaps, of which some weren't captured, and their URLs; the budget ends inside a child."""
    rows = table("orders").select(F.concat(F.lit("i"), F.col("o_custkey") % 5).alias("index"), (F.col("o_orderkey") % 30).alias("child"), "o_orderkey", "o_custkey").withColumn("sitemap", F.concat("index", F.lit("/"), "child"))
    loc = F.concat(F.when(F.col("o_custkey") % 3 == 0, "https://x/about/").otherwise("https://x/job/"), "o_custkey")
    urls = rows.where(F.col("child") % 11 != 3).select("sitemap", F.col("o_orderkey").alias("ordinal"), loc.alias("loc"))
    return probe.scanned_children(rows.select("index", "child", "sitemap").distinct(), urls, most_children=20, most_urls=550), urls


@_query(_SCAN_SQL.format(group="index", stored=40))
def scanned_indexes(table):
    """AGG3, WIN8: what a scan with a budget of children and URLs finds, by index."""
    return probe.scan_totals(*_scan(table), samples=3, stored=40)


@_query(_SCAN_SQL.format(group="index, child", stored=5))
def scanned_sitemaps(table):
    """AGG3: the same by child."""
    return probe.scan_totals(*_scan(table), each=True, samples=3, stored=5)


@_query(r"""WITH t AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS sitemap, page_id, url FROM pages),
g AS (SELECT regexp_extract(sitemap, '([a-z]+)$', 1) AS company, sitemap, count(*) % 3 AS n_unique, count(*) FILTER (contains(url, '/en/')) % 2 AS n_matched, min(page_id) AS ordinal FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n_unique DESC, n_matched DESC, ordinal % 2 = 0, ordinal) AS k FROM g) SELECT company, sitemap, n_unique FROM r WHERE k = 1""")
def best_sitemaps(table):
    """WIN7: most unique postings, most matches, files before indexes, the first."""
    rows = table("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("sitemap"), "page_id", "url").withColumn("company", F.regexp_extract("sitemap", "([a-z]+)$", 1))
    totals = rows.groupBy("company", "sitemap").agg((F.count("*") % 3).alias("n_unique"), (F.count_if(F.col("url").contains("/en/")) % 2).alias("n_matched"), F.min("page_id").alias("ordinal"))
    return probe.best_sitemap(totals.withColumn("is_index", F.col("ordinal") % 2 == 0)).select("company", "sitemap", "n_unique")


_TOKENS = ["HTML", "Head", "body", "title", "div", "href", "class", "meta", "span", "http", "script", "www", "zzqx"]


@_query(f"""WITH r AS (SELECT page_id, page_id % 50 AS page, CASE page_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'application/rss+xml' WHEN 3 THEN 'image/png' END AS ct, lower(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page, page_id, list_filter(list_append({_TOKENS}, CAST(page AS VARCHAR)), lambda t: contains(body, lower(t)))[1:10] AS hits FROM r WHERE ct IS NULL OR ct <> 'image/png')
SELECT page, page_id AS ordinal, array_to_string(hits, ',') AS hits FROM h WHERE len(hits) > 0""")
def token_responses(table):
    """CLS6."""
    rows = table("pages")
    page, kind = F.col("page_id") % 50, F.col("page_id") % 4
    content = F.when(kind == 1, "").when(kind == 2, "application/rss+xml").when(kind == 3, "image/png")
    responses = rows.select(page.alias("page"), F.col("page_id").alias("ordinal"), content.alias("content_type"), F.col("html").alias("body"))
    tokens = rows.select(page.alias("page")).distinct().withColumn("tokens", F.array(*map(F.lit, _TOKENS), F.col("page").cast("string")))
    return probe.responses_with_tokens(responses, tokens).select("page", "ordinal", F.array_join("hits", ",").alias("hits"))


@_query("""SELECT event_id, 'k' AS path, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def flat_props(table):
    """JSN1, D6."""
    return json_paths.flatten(table("events").withColumn("doc", F.try_parse_json("props")), F.col("doc"), "event_id")


@_query("""SELECT n_nationkey, n_name AS city, r_name AS state, CASE WHEN n_nationkey % 2 = 1 THEN 'X, Y' END AS country FROM nation JOIN region ON n_regionkey = r_regionkey""")
def places_split(table):
    """EXT13."""
    joined = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", markup.split_location(F.concat(F.col("n_name"), F.lit(" , "), F.col("r_name"), F.when(F.col("n_nationkey") % 2 == 1, ",X , Y").otherwise(""))).alias("p")).select("n_nationkey", "p.*")


@_query()
def document_sections(table):
    """ENR1, ENR2: tests hold it against headings that are worked out by hand."""
    return page_sources.spread(table("documents")).select("doc_id", sections.education_and_skills(F.col("text")).alias("s")).select("doc_id", "s.*")


# Deduplication, caps


@_query("SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_rows(table):
    """WIN1, WIN3."""
    return dedupe.keep_first(table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("o_custkey").cast("string"), "o_orderkey")


@_query("""SELECT CAST(o.o_custkey AS VARCHAR) AS key, f.k AS kept_o_orderkey, o.o_orderkey AS dropped_o_orderkey FROM orders o
JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) f ON o.o_custkey = f.o_custkey WHERE o.o_orderkey <> f.k""")
def dropped_rows(table):
    """WIN2, D11."""
    return dedupe.dropped_pairs(table("orders"), F.col("o_custkey").cast("string"), "o_orderkey", "o_orderkey")


@_query("""SELECT p_brand, p_name FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS n FROM part) WHERE n = 1""")
def richest_names(table):
    """WIN4."""
    return dedupe.richest(table("part"), "p_brand", value="p_name", order="p_partkey")


@_query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3")
def capped_rows(table):
    """WIN5."""
    return dedupe.cap_each(table("orders"), "o_custkey", 3, "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@_query("SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 5000")
def budgeted_rows(table):
    """WIN6: a budget of 5000 rows over the vendors in order."""
    return dedupe.global_budget(table("orders"), "o_orderpriority", 5000, "o_orderkey").select("o_orderpriority", "o_orderkey")


@_query("""SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 2) AS "values" FROM orders GROUP BY 1""")
def first_values(table):
    """WIN8."""
    return dedupe.first_values(table("orders").withColumn("ordinal", F.col("o_orderkey")), "o_custkey", "o_orderkey", "ordinal", 2)


@_query("""WITH g AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS added FROM events),
s AS (SELECT *, CASE WHEN added = 0 AND coalesce(lag(added) OVER (PARTITION BY user_id ORDER BY event_id), 1) = 0 THEN 1 ELSE 0 END AS stop FROM g),
c AS (SELECT *, sum(stop) OVER (PARTITION BY user_id ORDER BY event_id) AS stopped FROM s) SELECT user_id, event_id FROM c WHERE stopped = 0""")
def pages_until_dry(table):
    """WIN9: an error stands for a page without new rows."""
    rows = table("events").select("user_id", "event_id", F.lit(1).alias("got"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("added"))
    return dedupe.until_dry(rows, "user_id", "event_id").select("user_id", "event_id")


# Against what is stored


def _split(table) -> tuple[DataFrame, DataFrame]:
    """Orders as stored rows (before 1996) and rows that came in (from 1995 on), by customer."""
    rows = table("orders").select(F.col("o_orderpriority").alias("vendor"), F.col("o_custkey").cast("string").alias("dedupe_key"), F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("price"), "o_orderdate")
    return rows.where("o_orderdate < '1996-01-01'"), rows.where("o_orderdate >= '1995-01-01'")


_SPLIT_SQL = """r AS (SELECT o_orderpriority AS vendor, CAST(o_custkey AS VARCHAR) AS dedupe_key, o_orderkey AS ordinal, o_totalprice AS price, o_orderdate FROM orders),
s AS (SELECT * FROM r WHERE o_orderdate < TIMESTAMP '1996-01-01'), i AS (SELECT * FROM r WHERE o_orderdate >= TIMESTAMP '1995-01-01')"""


def _store(rows: DataFrame, day: str, order: str = "ordinal") -> incremental.SnapshotTable:
    """A stored table of rows, as of a day."""
    stored = incremental.SnapshotTable(rows.sparkSession, work_path(rows.sparkSession, "stored"), buckets=4)
    stored.upsert(rows, F.lit(day).cast("timestamp"), order)
    return stored


@_query(f"WITH {_SPLIT_SQL} SELECT DISTINCT vendor, dedupe_key FROM i WHERE (vendor, dedupe_key) IN (SELECT (vendor, dedupe_key) FROM s)")
def stored_keys(table):
    """JON1: against a table in buckets, which is read where it lies."""
    stored, incoming = _split(table)
    return incremental.known_keys(incoming, _store(stored, "2024-01-01"))


@_query(f"WITH {_SPLIT_SQL} SELECT vendor, dedupe_key, ordinal FROM i WHERE (vendor, dedupe_key) NOT IN (SELECT (vendor, dedupe_key) FROM s)")
def new_rows(table):
    """JON2."""
    stored, incoming = _split(table)
    return incremental.skip_known(incoming, _store(stored, "2024-01-01")).select("vendor", "dedupe_key", "ordinal")


@_query(f"WITH {_SPLIT_SQL} SELECT DISTINCT dedupe_key FROM i EXCEPT SELECT dedupe_key FROM s")
def key_difference(table):
    """SET3."""
    stored, incoming = _split(table)
    return incremental.new_keys(incoming, stored, "dedupe_key")


@_query(f"""WITH {_SPLIT_SQL}, os AS (SELECT vendor, dedupe_key, max_by(price, ordinal) AS price FROM s GROUP BY 1, 2), li AS (SELECT vendor, dedupe_key, max_by(price, ordinal) AS price FROM i GROUP BY 1, 2)
SELECT vendor, dedupe_key, CASE WHEN li.price IS NULL THEN os.price ELSE li.price END AS price, CASE WHEN os.price IS NULL THEN '2024-03-01' ELSE '2024-01-01' END AS first_seen,
  CASE WHEN li.price IS NULL THEN '2024-01-01' ELSE '2024-03-01' END AS updated_at FROM os FULL JOIN li USING (vendor, dedupe_key)""")
def upserted(table):
    """SNK7: the stored table after the rows came in, in the buckets that they fall into."""
    stored, incoming = _split(table)
    kept = _store(stored.drop("o_orderdate"), "2024-01-01")
    kept.upsert(incoming.drop("o_orderdate"), F.lit("2024-03-01").cast("timestamp"), "ordinal")
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_seen", "updated_at")]
    return kept.read().select("vendor", "dedupe_key", "price", *days)


@_query(f"WITH {_SPLIT_SQL} SELECT vendor, count(*) AS n FROM (SELECT vendor FROM s UNION ALL SELECT vendor FROM i) GROUP BY 1")
def all_vendors(table):
    """SET1."""
    from postworks.sources.tables import union_all

    stored, incoming = _split(table)
    return union_all(stored, incoming.drop("price")).groupBy("vendor").agg(F.count("*").alias("n"))


@_query("SELECT page_id, url, strlen(html) AS size FROM pages")
def listing_with_pages(table):
    """JON4."""
    listing = table("pages").select("page_id", "url", F.concat(F.col("url"), F.lit("|"), F.col("page_id").cast("string")).alias("detail_url"))
    artifacts = table("pages").select(F.concat(F.col("url"), F.lit("|"), F.col("page_id").cast("string")).alias("detail_url"), F.octet_length("html").cast("long").alias("size"))
    return incremental.with_artifacts(listing, artifacts).select("page_id", "url", "size")


# Enrichment, states, metrics


def _located(table) -> tuple[DataFrame, DataFrame]:
    rows = table("customer").select("c_custkey", F.concat(F.lit(" N"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("raw_location"), F.lit(None).cast("double").alias("latitude"), F.lit(1.0).alias("longitude"), F.lit("?").alias("country"), F.lit("keep").alias("state"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("postal_code"))
    geo = F.struct(F.col("n_nationkey").cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.col("n_name").alias("country"), F.lit("").alias("state"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("postal_code"))
    cache = table("nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("query"), F.when(F.col("n_nationkey") % 5 != 0, geo).alias("geo"))
    return rows, cache


@_query("""SELECT c_custkey, CASE WHEN n_nationkey < 20 AND n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS latitude, CAST(1 AS DOUBLE) AS longitude,
  CASE WHEN n_nationkey < 20 AND n_nationkey % 5 <> 0 THEN n_name ELSE '?' END AS country, 'keep' AS state FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def placed_rows(table):
    """JON5."""
    rows, cache = _located(table)
    return enrichment.with_places(rows, cache).select("c_custkey", "latitude", "longitude", "country", "state")


@_query("SELECT DISTINCT 'N' || CAST(c_nationkey AS VARCHAR) AS query FROM customer WHERE c_nationkey >= 20")
def places_to_resolve(table):
    """JON5, SET2."""
    return enrichment.to_resolve(*_located(table))


@_query("""SELECT count(*) AS n_rows, count(*) AS n_with_place, count(DISTINCT c_nationkey) AS n_places, count(*) FILTER (c_nationkey < 20 AND c_nationkey % 5 <> 0) AS n_matched FROM customer""")
def place_coverage(table):
    """AGG5."""
    return enrichment.place_coverage(*_located(table))


def _outcomes(table) -> DataFrame:
    log = table("events").where(F.col("event_type").isin("error", "purchase"))
    return log.select(F.col("user_id").alias("company_id"), F.col("event_id").alias("ts"), (F.col("event_type") == "purchase").alias("ok"), F.when(F.col("event_id") % 2 == 0, "timeout").alias("type"))


_STATUS_SQL = """o AS (SELECT user_id AS company_id, event_id AS ts, event_type = 'purchase' AS ok, CASE WHEN event_id % 2 = 0 THEN 'timeout' END AS type FROM events WHERE event_type IN ('error', 'purchase')),
w AS (SELECT company_id, max(ts) FILTER (ok) AS last_success FROM o GROUP BY 1),
f AS (SELECT o.company_id, max(ts) AS last_failure, max_by(coalesce(type, 'unknown'), ts) AS last_failure_type, count(*) AS failure_count FROM o JOIN w USING (company_id)
  WHERE NOT ok AND (last_success IS NULL OR ts > last_success) GROUP BY 1),
st AS (SELECT w.company_id, last_success, last_failure, last_failure_type, coalesce(failure_count, 0) AS failure_count FROM w LEFT JOIN f USING (company_id))"""


@_query(f"WITH {_STATUS_SQL} SELECT * FROM st")
def company_status(table):
    """AGG8, D9."""
    return runs.status_fold(_outcomes(table))


@_query(f"WITH {_STATUS_SQL} SELECT c_custkey AS company_id, c_name AS name, last_failure, coalesce(failure_count, NULL) AS failure_count FROM customer LEFT JOIN st ON c_custkey = company_id")
def registry_with_status(table):
    """JON6."""
    companies = table("customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return enrichment.with_status(companies, runs.status_fold(_outcomes(table)).select("company_id", "last_failure", "failure_count"))


@_query("""WITH c AS (SELECT s_suppkey, s_suppkey % 10 = 0 AS disabled, s_suppkey % 3 * 60 AS cooldown, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 5 END AS hours_ago FROM supplier)
SELECT s_suppkey FROM c WHERE NOT disabled AND (cooldown = 0 OR hours_ago IS NULL OR hours_ago * 60 >= cooldown)""")
def eligible_companies(table):
    """FLT9; every fourth has a time that isn't understood."""
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    failed = F.when(F.col("s_suppkey") % 4 == 0, "never").otherwise(F.date_format(now - F.make_interval(hours=(F.col("s_suppkey") % 5).cast("int")), "yyyy-MM-dd HH:mm:ss"))
    companies = table("supplier").select("s_suppkey", (F.col("s_suppkey") % 10 == 0).alias("disabled"), (F.col("s_suppkey") % 3 * 60).alias("cooldown_minutes"), failed.alias("last_failure"))
    return runs.eligible(companies, now).select("s_suppkey")


def _measured(table) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "counter").when(F.col("event_type") == "view", "gauge").otherwise("histogram")
    return runs.metrics(table("events").select((F.col("user_id") % 7).cast("string").alias("scraper"), kind.alias("kind"), F.col("event_type").alias("name"), F.round("value").alias("value"), F.col("event_id").alias("ts")))


_METRICS_SQL = """m AS (SELECT CAST(user_id % 7 AS VARCHAR) AS scraper, CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' ELSE 'histogram' END AS kind, event_type AS name, round(value) AS value, event_id FROM events)"""


@_query(f"""WITH {_METRICS_SQL} SELECT scraper, kind, name, sum(value) FILTER (kind = 'counter') AS total, max_by(value, event_id) FILTER (kind = 'gauge') AS last, count(value) FILTER (kind = 'histogram') AS count,
  sum(value) FILTER (kind = 'histogram') AS sum, min(value) FILTER (kind = 'histogram') AS min, max(value) FILTER (kind = 'histogram') AS max, avg(value) FILTER (kind = 'histogram') AS mean FROM m GROUP BY 1, 2, 3""")
def run_metrics(table):
    """AGG2, D10."""
    return _measured(table)


@_query(f"WITH {_METRICS_SQL} SELECT sum(value) AS total FROM m WHERE kind = 'counter' AND name = 'click'")
def total_jobs(table):
    """AGG4."""
    return runs.total_of(_measured(table), "click")


_LABELS_SQL = """ || '{scraper="' || scraper || '",name="' || name || '"} ' || """


@_query(f"""WITH {_METRICS_SQL}, a AS (SELECT scraper, kind, name, sum(value) AS total, max_by(value, event_id) AS last, count(value) AS n, min(value) AS lo, max(value) AS hi FROM m GROUP BY 1, 2, 3),
v AS (SELECT scraper, name, unnest(CASE kind WHEN 'counter' THEN [('counter', CAST(total AS VARCHAR))] WHEN 'gauge' THEN [('gauge', CAST(last AS VARCHAR))]
  ELSE [('histogram_count', CAST(n AS VARCHAR)), ('histogram_sum', CAST(total AS VARCHAR)), ('histogram_min', CAST(lo AS VARCHAR)), ('histogram_max', CAST(hi AS VARCHAR))] END) AS x FROM a)
SELECT 'postworks_' || x[1]{_LABELS_SQL}x[2] AS line FROM v""")
def metric_lines(table):
    """SNK9."""
    return runs.prometheus_lines(_measured(table))


@_query("SELECT code, n FROM (SELECT 'missing_required:Detail URL' AS code, count(*) FILTER (o_orderkey % 4 = 0) AS n FROM orders UNION ALL SELECT 'bad_detail_url', count(*) FILTER (o_orderkey % 4 = 1) FROM orders UNION ALL SELECT 'salary_min_gt_max', count(*) FILTER (o_totalprice > 100000) FROM orders) WHERE n > 0")
def error_counts(table):
    """FLT10, AGG6."""
    rows = _postings(table).withColumns({"detail_url": F.when(F.col("dedupe_key").cast("long") % 4 == 0, None).when(F.col("dedupe_key").cast("long") % 4 == 1, "ftp://x").otherwise("https://x/"), "salary_max": F.lit(100000.0)})
    return canonical.error_summary(rows)


# Configurations by the customer's key: what each lacks is null or blank, so that weak evidence decides for some.
_CONFIG = {
    "platform": "CASE c_custkey % 11 WHEN 0 THEN 'paged_html_search' WHEN 1 THEN ' usajobs_api ' WHEN 2 THEN 'nobody' WHEN 3 THEN '' END",
    "discovery_type": "CASE c_custkey % 5 WHEN 0 THEN 'HTML_search' WHEN 1 THEN 'sitemap_index' END",
    "api_url": "CASE c_custkey % 7 WHEN 0 THEN 'https://x/api/apply/v2/jobs?n=1' WHEN 1 THEN 'https://x/API/Careers/CareerSearch' ELSE '' END",
    "search_url": "CASE c_custkey % 13 WHEN 0 THEN 'https://data.usajobs.gov/api/Search' WHEN 1 THEN 'https://x/en/search-results' WHEN 2 THEN 'https://x/search-jobs?p={page}' WHEN 3 THEN 'https://x/api/apply/v2/jobs' WHEN 4 THEN 'https://x/a/search/b' END",
    "careers_url": "CASE c_custkey % 3 WHEN 0 THEN 'https://x/search/' ELSE 'https://x/' END",
    "sitemap_url": "CASE c_custkey % 17 WHEN 0 THEN 'https://x/global/en/sitemap.xml' WHEN 1 THEN 'https://x/sitemap.xml' WHEN 2 THEN '' END",
    "requires_browser": "c_custkey % 2 = 0",
}


@_query(f"""WITH c AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in _CONFIG.items())} FROM customer),
names(platform, adapter) AS (VALUES ('sitemap_job_urls', 'sitemap'), ('phenom', 'phenom_sitemap'), ('apply_v2', 'apply_v2'), ('paged_html_search', 'paged_html'), ('selenium_paged_html_search', 'browser_paged_html'), ('usajobs_api', 'usajobs_api'), ('phenom_search', 'phenom_search'), ('encoded_request_api', 'encoded_api')),
e AS (
  SELECT c_custkey, 1 AS place, 'sitemap' AS adapter, 1.0 AS score FROM c WHERE lower(discovery_type) IN ('sitemap', 'sitemap_index')
  UNION ALL SELECT c_custkey, 1, 'sitemap', 0.8 FROM c WHERE sitemap_url <> ''
  UNION ALL SELECT c_custkey, 2, 'phenom_sitemap', 0.85 FROM c WHERE contains(sitemap_url, '/global/en/')
  UNION ALL SELECT c_custkey, 3, 'apply_v2', 0.9 FROM c WHERE contains(api_url, '/api/apply/v2/jobs') OR contains(search_url, '/api/apply/v2/jobs')
  UNION ALL SELECT c_custkey, 4, 'paged_html', CASE WHEN lower(discovery_type) = 'html_search' THEN 0.6 ELSE 0.35 END FROM c
    WHERE lower(discovery_type) = 'html_search' OR regexp_matches(coalesce(search_url, '') || ' ' || careers_url, 'search-jobs|/search/')
  UNION ALL SELECT c_custkey, 5, 'browser_paged_html', 0.75 FROM c WHERE requires_browser AND contains(search_url, '{{page}}')
  UNION ALL SELECT c_custkey, 6, 'usajobs_api', 0.95 FROM c WHERE contains(search_url, 'data.usajobs.gov/api/Search')
  UNION ALL SELECT c_custkey, 7, 'phenom_search', 0.8 FROM c WHERE contains(search_url, 'search-results') AND contains(search_url, '/en/')
  UNION ALL SELECT c_custkey, 8, 'encoded_api', 0.9 FROM c WHERE contains(api_url, 'API/Careers/CareerSearch')),
b AS (SELECT c_custkey, adapter, score FROM e QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, place) = 1)
SELECT c.c_custkey, CASE WHEN trim(coalesce(c.platform, '')) <> '' THEN n.adapter ELSE coalesce(b.adapter, 'sitemap') END AS chosen_adapter,
  CASE WHEN trim(coalesce(c.platform, '')) <> '' THEN CASE WHEN n.adapter IS NOT NULL THEN 1.0 END ELSE coalesce(b.score, 0.0) END::DOUBLE AS adapter_score,
  CASE WHEN trim(c.platform) <> '' AND n.adapter IS NULL THEN 'unknown_platform:' || trim(c.platform) END AS adapter_error
FROM c LEFT JOIN names n ON n.platform = trim(c.platform) LEFT JOIN b ON b.c_custkey = c.c_custkey""")
def adapters(table):
    """PRJ17: the adapter that a configuration names, else what its URLs and its discovery tell."""
    rows = table("customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in _CONFIG.items()])
    return mapping.choose_adapter(rows).select("c_custkey", "chosen_adapter", "adapter_score", "adapter_error")


@_query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS posting_id, p_name AS position_title, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS raw_location FROM part""")
def mapped_rows(table):
    """PRJ4, D4."""
    rows = table("part").select("p_partkey", F.create_map(F.lit("posting_id"), F.col("p_partkey").cast("string"), F.lit("raw_location"), F.col("p_type")).alias("listing"), F.create_map(F.lit("title"), F.col("p_name")).alias("ld"), F.create_map(F.lit("gtm_tbcn_location"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")).alias("meta"))
    return mapping.normalize(rows, "sitemap", {"L": "listing", "J": "ld", "M": "meta"}).select("p_partkey", "posting_id", "position_title", "raw_location")


def _texts_sql(markup: str) -> str:
    """The texts between tags in SQL, unescaped and stripped, without blank ones."""
    one = "replace(t, '&nbsp;', chr(160))"
    for entity, to in [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&ndash;", "'–'"), ("&mdash;", "'—'"), ("&bull;", "'•'"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")]:
        one = f"replace({one}, '{entity}', {to})"
    return rf"list_filter(list_transform(string_split_regex({markup}, '(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>'), lambda t: regexp_replace({one}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')), lambda t: t <> '')"


_LINES_SQL = rf"""p AS (SELECT *, string_split_regex(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '<p>', 'g'), '(?i)<li\b[^>]*>') AS parts FROM pages),
halves AS (SELECT *, list_transform(parts[2:], lambda x: string_split_regex(x, '(?i)</li\s*>')) AS items FROM p),
lines AS (SELECT *, {_texts_sql("parts[1]")} || flatten(list_transform(items, lambda h: list_filter([array_to_string({_texts_sql("h[1]")}, ' ')], lambda u: u <> '') || {_texts_sql("array_to_string(h[2:], '</li>')")})) AS texts FROM halves),
d AS (SELECT *, trim(replace(regexp_replace(regexp_replace(array_to_string(texts, chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(160), ' '), ' ' || chr(10) || chr(9)) AS description FROM lines)"""


@_query(rf"""WITH {_LINES_SQL},
t AS (SELECT *, nullif(trim(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), '') AS h1, regexp_extract(url, '(?s)^[^?#]*') AS bare FROM d)
SELECT 'pages' AS vendor, h1 AS position_title, lower(regexp_extract(bare, '^([A-Za-z]+)://', 1)) || regexp_extract(bare, '^[A-Za-z]+(://.*)$', 1) AS detail_url, description, '2024-02-27' AS post_date, CAST(page_id AS VARCHAR) AS posting_id,
  '$50/hr - $80/hr' AS salary_raw, 104000.0::DOUBLE AS salary_min, 166400.0::DOUBLE AS salary_max, 0.0::DOUBLE AS bonus, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
  {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in canonical.COLUMNS if c not in ('vendor', 'position_title', 'detail_url', 'description', 'post_date', 'posting_id', 'salary_raw', 'salary_min', 'salary_max', 'bonus', 'latitude', 'longitude'))} FROM t""")
def canonical_rows(table):
    """PRJ1, D1, TXT1: pages as raw postings, with descriptions as lines."""
    raw = page_sources.spread(table("pages")).select(F.col("page_id").cast("string").alias("posting_id"), markup.h1_text(F.col("html")).alias("position_title"), F.col("url").alias("detail_url"), F.col("html").alias("description"), F.lit("3 days ago").alias("post_date"), F.lit("$50/hr - $80/hr").alias("salary_raw"))
    return canonical.canonicalize(raw, F.lit("pages"), F.lit("2024-03-01").cast("date"))
