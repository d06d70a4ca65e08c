"""Operators on small tables: nulls, blanks, ties and repeated rows included."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from postworks.operators import canonical, dedupe, enrichment, incremental, mapping, probe, query, runs
from postworks.plans import run
from postworks.sources import pages, payloads, registry, sitemaps, tables
from postworks.streaming import ingest

def day():
    return F.lit("2024-03-01").cast("date")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_canonical_row(spark):
    raw = spark.createDataFrame([("https://example.com/p?x", "2025/11/01", "$50/hr - $80/hr", "<p>Hello<br/>World</p>", "Eng", None)], "detail_url string, post_date string, salary_raw string, description string, position_title string, bonus string")
    out = canonical.canonicalize(raw, F.lit("V"), day())
    r = out.first()
    assert out.columns == canonical.COLUMNS and len(canonical.COLUMNS) == 35
    assert (r.vendor, r.detail_url, r.post_date, r.salary_min, r.salary_max, r.bonus, r.description) == ("V", "https://example.com/p", "2025-11-01", 104000.0, 166400.0, 0.0, "Hello\nWorld")
    assert canonical.to_display(out).columns == canonical.DISPLAY_NAMES
    good, bad = canonical.split_valid(out)
    assert (good.count(), bad.count()) == (1, 0)
    again = canonical.canonicalize(out, F.lit("V"), day()).first()
    assert (again.detail_url, again.post_date, again.salary_min) == (r.detail_url, r.post_date, r.salary_min)


def test_given_salary_is_kept(spark):
    raw = spark.createDataFrame([("5", None, "$1 - $2")], "salary_min string, salary_max string, salary_raw string")
    r = canonical.canonicalize(raw, F.lit("V"), day()).first()
    assert (r.salary_min, r.salary_max) == (5.0, None)


def test_errors(spark):
    bad = spark.createDataFrame([("v", "t", "not-a-url", "1 May", "5", "3"), (None, "", None, None, "x", "3"), ("v", "t", "http://a", "2024-01-01", None, "3")], "vendor string, position_title string, detail_url string, post_date string, salary_min string, salary_max string")
    found = [r.e for r in bad.select(canonical.errors(bad).alias("e")).collect()]
    assert found == [["bad_detail_url", "bad_post_date_format", "salary_min_gt_max"], ["missing_required:Vendor", "missing_required:Position Title", "missing_required:Detail URL", "salary_non_numeric"], []]
    assert ("bad_detail_url", 1) in rows(canonical.error_summary(bad))


POSTS = [("a", "1", 2), ("a", "1", 1), ("a", "", 3), ("a", None, 4), ("b", "1", 5), ("b", "2", 6), ("b", "2", 7)]


def test_dedupe(spark):
    df = spark.createDataFrame(POSTS, "vendor string, id string, ordinal int")
    assert rows(dedupe.keep_first(df, F.col("id"), "ordinal", within="vendor"), "ordinal") == [(1,), (3,), (4,), (5,), (6,)]
    pairs = dedupe.dropped_pairs(df, F.col("id"), "ordinal", "ordinal", within="vendor")
    assert rows(pairs, "key", "kept_ordinal", "dropped_ordinal") == [("1", 1, 2), ("2", 6, 7)]
    first = dedupe.keep_first(df, F.col("id"), "ordinal", within="vendor")
    assert rows(dedupe.keep_first(first, F.col("id"), "ordinal", within="vendor")) == rows(first)
    assert dedupe.keep_first(df.limit(0), F.col("id"), "ordinal").count() == 0


def test_caps(spark):
    df = spark.createDataFrame(POSTS, "vendor string, id string, ordinal int")
    assert rows(dedupe.cap_each(df, "vendor", 2, "ordinal"), "ordinal") == [(1,), (2,), (5,), (6,)]
    assert rows(dedupe.global_budget(df, "vendor", 5, "ordinal"), "ordinal") == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(dedupe.first_values(df, "vendor", "id", "ordinal", 2)) == [("a", ["1", "1"]), ("b", ["1", "2"])]
    pages_ = spark.createDataFrame([("x", 1, 5, 5), ("x", 2, 5, 0), ("x", 3, 5, 1), ("x", 4, 5, 0), ("x", 5, 5, 0), ("x", 6, 5, 5), ("y", 1, 0, 0)], "g string, p int, got int, added int")
    assert rows(dedupe.until_dry(pages_, "g", "p"), "g", "p") == [("x", 1), ("x", 2), ("x", 3), ("x", 4)]
    names = spark.createDataFrame([("k", "aa", 2), ("k", "bb", 1), ("k", "c", 0)], "k string, v string, o int")
    assert rows(dedupe.richest(names, "k", value="v", order="o")) == [("k", "bb")]


def test_incremental(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], "vendor string, dedupe_key string")
    seen = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", ""), ("a", "2")], "vendor string, dedupe_key string")
    assert rows(incremental.skip_known(seen, stored)) == [("a", ""), ("a", "2"), ("a", "2")]
    assert rows(incremental.skip_known(seen, stored, vendor=None)) == [("a", "")]
    assert rows(incremental.known_keys(seen, stored)) == [("a", "1")]
    assert rows(incremental.new_keys(seen, stored, "vendor", "dedupe_key")) == [("a", ""), ("a", "2")]


def test_status_and_eligibility(spark):
    log = spark.createDataFrame([("x", 1, False, "e"), ("x", 2, True, None), ("x", 3, False, None), ("x", 4, False, "t"), ("y", 1, True, None)], "company_id string, ts int, ok boolean, type string")
    assert rows(runs.status_fold(log)) == [("x", 2, 4, "t", 2), ("y", 1, None, None, 0)]
    companies = spark.createDataFrame([("a", False, 0, "2024-01-01 11:59:00"), ("b", False, 5, "2024-01-01 11:59:00"), ("c", False, 5, "2024-01-01 11:00:00"), ("d", True, 0, None), ("e", False, 5, "junk")], "id string, disabled boolean, cooldown_minutes int, last_failure string")
    assert rows(runs.eligible(companies, F.lit("2024-01-01 12:00:00").cast("timestamp")), "id") == [("a",), ("c",), ("e",)]


def test_metrics(spark):
    events = spark.createDataFrame([("s", "counter", "n", 1.0, 1), ("s", "counter", "n", 2.0, 2), ("s", "gauge", "g", 5.0, 2), ("s", "gauge", "g", 9.0, 1), ("s", "histogram", "h", 1.0, 1), ("s", "histogram", "h", 3.0, 1)], "scraper string, kind string, name string, value double, ts int")
    measured = runs.metrics(events)
    assert runs.total_of(measured, "n").first().total == 3.0
    assert rows(runs.prometheus_lines(measured, "p")) == [(x,) for x in sorted(['p_counter{scraper="s",name="n"} 3.0', 'p_gauge{scraper="s",name="g"} 5.0', 'p_histogram_count{scraper="s",name="h"} 2', 'p_histogram_sum{scraper="s",name="h"} 4.0', 'p_histogram_min{scraper="s",name="h"} 1.0', 'p_histogram_max{scraper="s",name="h"} 3.0'], key=lambda x: repr((x,)))]
    assert '"generated_at":"t"' in runs.snapshot_json(measured, F.lit("t")).first().json


def test_places(spark):
    df = spark.createDataFrame([(1, " Austin ", 1.0, None, "US"), (2, "Nowhere", None, None, "?"), (3, None, None, None, None)], "id int, raw_location string, latitude double, longitude double, country string").withColumns({c: F.lit(None).cast("string") for c in ("state", "city", "postal_code")})
    cache = spark.createDataFrame([("Austin", (30.0, -97.0, "", "TX", None, None)), ("Nowhere", None)], "query string, geo struct<latitude: double, longitude: double, country: string, state: string, city: string, postal_code: string>")
    assert rows(enrichment.with_places(df, cache), "id", "latitude", "longitude", "country", "state") == [(1, 30.0, -97.0, "US", "TX"), (2, None, None, "?", None), (3, None, None, None, None)]
    assert rows(enrichment.to_resolve(df, cache)) == []
    assert tuple(enrichment.place_coverage(df, cache).first()) == (3, 2, 2, 1)
    maps = spark.createDataFrame([({"a": "1"},), ({"b": "1"},)], "m map<string,string>")
    assert rows(enrichment.new_columns(maps, "m")) == [("a",), ("b",)]


def test_search(spark):
    df = spark.createDataFrame([("v", "k1", "Radar Eng", "", "X", "2024-01-02"), ("v", "k2", "Cook", "radar", "Y", None), ("w", "k3", "radar", "", "Z", "2024-01-01")], "vendor string, dedupe_key string, position_title string, description string, raw_location string, post_date string")
    assert [r.dedupe_key for r in query.search(df, q="RADAR", sort_field="nonsense", sort_dir="up", limit="x", offset=None).collect()] == ["k1", "k3", "k2"]
    assert [r.dedupe_key for r in query.search(df, vendor="v", since="2024-01-01").collect()] == ["k1"]
    assert [r.dedupe_key for r in query.search(df, q="ra%r", sort_field="vendor", sort_dir="asc", limit=1, offset=1).collect()] == ["k2"]
    assert query.preset(df, "last_7", F.lit("2024-01-08").cast("date")).count() == 2


def test_probe(spark):
    totals = spark.createDataFrame([("c", "s1", 5, 9, False, 2), ("c", "s2", 5, 9, True, 1), ("c", "s3", 4, 99, False, 0)], "company string, sitemap string, n_unique int, n_matched int, is_index boolean, ordinal int")
    assert rows(probe.best_sitemap(totals), "sitemap") == [("s1",)]
    best = spark.createDataFrame([("a", ["u"], None), ("b", ["x"], "s"), ("c", None, None)], "company string, samples array<string>, search string")
    captured = spark.createDataFrame([("u",)], "url string")
    assert rows(probe.probe_plan(best, captured), "company", "step") == [("a", "detail"), ("b", "search"), ("c", "none")]
    responses = spark.createDataFrame([("p", 1, "application/json", '{"id":77}'), ("p", 2, "image/png", "77"), ("p", 3, "text/html", "none")], "page string, ordinal int, content_type string, body string")
    tokens = spark.createDataFrame([("p", ["77", "radar"])], "page string, tokens array<string>")
    assert rows(probe.responses_with_tokens(responses, tokens), "ordinal", "hits") == [(1, ["77"])]


def test_mapping(spark):
    raw = spark.createDataFrame([({"posting_id": "1", "detail_url": "u"}, {"jobId": "2", "salaryMin": "90000", "structureData.employmentType": "Full-time"})], "l map<string,string>, v map<string,string>")
    r = mapping.normalize(raw, "bae", {"L": "l", "V": "v"}).first()
    assert (r.posting_id, r.salary_min, r.full_time_status, r.detail_url, r.shift) == ("1", "90000", "Full-time", "u", None)
    for platform in mapping.SOURCES:
        out = mapping.normalize(raw, platform, {"L": "l", "V": "v"})
        assert set(out.columns) - {"l", "v", "passed"} <= set(canonical.COLUMNS)
        assert out.count() == 1
    usa = spark.createDataFrame([({"PositionURI.0": "u", "PositionSchedule.0.Name": "Full", "PositionID": "7"},)], "v map<string,string>")
    r = mapping.normalize(usa, "usajobs_api", {"V": "v"}).first()
    assert (r.detail_url, r.full_time_status, r.posting_id, r.city) == ("u", "Full", "7", None)


def test_adapter_choice(spark):
    fields = ("platform", "adapter", "discovery_type", "api_url", "search_url", "careers_url", "requires_browser", "sitemap_urls")
    cases = [
        (dict(platform="phenom"), "phenom_sitemap", 1.0),
        (dict(platform="phenom_sitemap", adapter=" "), "phenom_sitemap", 1.0),
        (dict(platform="apply_v2", adapter="sitemap"), "sitemap", 1.0),
        (dict(platform="Phenom"), None, None),  # names are held against the registry as they are
        (dict(platform="what", search_url="https://data.usajobs.gov/api/Search"), None, None),
        (dict(), "sitemap", 0.0),
        (dict(discovery_type="sitemap"), "sitemap", 1.0),
        (dict(sitemap_urls=["https://x/s.xml"]), "sitemap", 0.8),
        (dict(sitemap_urls=["https://x/s.xml", "https://x/global/en/s.xml"]), "phenom_sitemap", 0.85),
        (dict(search_url="https://x/api/apply/v2/jobs", api_url="https://x/API/Careers/CareerSearch"), "apply_v2", 0.9),  # a tie: the first registered
        (dict(api_url="https://x/API/Careers/CareerSearch"), "encoded_api", 0.9),
        (dict(discovery_type="html_search", careers_url="https://x/search/"), "paged_html", 0.6),
        (dict(careers_url="https://x/search-jobs"), "paged_html", 0.35),
        (dict(requires_browser=True, search_url="https://x/search/{page}"), "browser_paged_html", 0.75),
        (dict(requires_browser=False, search_url="https://x/search/{page}"), "paged_html", 0.35),
        (dict(search_url="https://x/en/search-results"), "phenom_search", 0.8),
        (dict(search_url="https://data.usajobs.gov/api/Search", sitemap_urls=["s"]), "usajobs_api", 0.95),
    ]
    schema = "n int, " + ", ".join(f"{f} {'array<string>' if f == 'sitemap_urls' else 'boolean' if f == 'requires_browser' else 'string'}" for f in fields)
    rows = spark.createDataFrame([(n, *[given.get(f) for f in fields]) for n, (given, _, _) in enumerate(cases)], schema)
    found = mapping.choose_adapter(rows).orderBy("n").collect()
    assert [(r.chosen_adapter, r.adapter_score) for r in found] == [c[1:] for c in cases]
    assert [r.n for r in found if r.adapter_error] == [3, 4] and found[4].adapter_error == "unknown_platform:what"
    assert mapping.choose_adapter(rows.select("n")).first().chosen_adapter == "sitemap"


def test_registry(spark):
    doc = '{"companies":{"acme":{"name":"Acme","domain":"acme.com","platform":"sitemap"},"Bad Id":{"name":"","platform":"x","max_rps":0}}}'
    found = registry.companies(spark.createDataFrame([(doc,)], "doc string"))
    r = found.where("company_id = 'acme'").first()
    assert (r.max_rps, r.cooldown_minutes, r.disabled, r.sitemap_urls, r.headers) == (2.0, 0, False, [], {})
    assert {m for _, m in rows(registry.violations(found))} == {"company_id must be lower-case letters, digits, - or _", "name is required", "platform is not known", "max_rps must be above 0"}
    listed = registry.sites(spark.createDataFrame([('{"A":{"site":"s","careers":"c"},"B":7}',)], "doc string"))
    assert rows(listed) == [("A", "s", "c", None)]


def test_sitemaps(spark):
    urlset = '﻿<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/job/1 </loc></url><url><loc>https://a/x</loc><lastmod>2024-01-01</lastmod></url><url><loc> </loc></url><url><loc>https://a/job/1</loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://a/s1</loc></sitemap></sitemapindex>"
    children = spark.createDataFrame([("https://a/s1", urlset)], "url string, xml string")
    assert rows(sitemaps.sitemap_urls(children, "url"), "ordinal", "loc", "lastmod") == [(0, "https://a/job/1", ""), (1, "https://a/x", "2024-01-01"), (3, "https://a/job/1", "")]
    assert rows(sitemaps.posting_urls(children), "loc", "ordinal") == [("https://a/job/1", 0)]
    assert rows(sitemaps.posting_urls(children, prefixes=["https://a/x"]), "loc") == [("https://a/x",)]
    parents = spark.createDataFrame([("https://a/i", index)], "url string, xml string")
    assert rows(sitemaps.expand(parents, children), "loc", "ordinal") == [("https://a/job/1", 0), ("https://a/x", 1)]
    robots = spark.createDataFrame([("User-agent: *\nSitemap: https://a/1\n sitemap:https://a/2\r\nSITEMAP: https://a/1",)], "text string")
    assert rows(sitemaps.robots_sitemaps(robots), "sitemap") == [("https://a/1",), ("https://a/2",)]


def test_sitemap_files_are_shared_among_tasks(spark, tmp_path):
    head = '<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    entry = lambda i: f"<url {'' if i % 2 else chr(10)}><loc> https://x/job/{i}?a=1&amp;b=2 </loc>" + (f"\n<lastmod>2024-01-0{i % 9 + 1}</lastmod>" if i % 3 else "<image:image><image:loc>z</image:loc></image:image>") + "</url>" + "\n" * (i % 2)
    text = head + "".join(map(entry, range(4000))) + "<url><loc> </loc></url><url></url></urlset>"
    (tmp_path / "a.xml").write_text(text)
    with gzip.open(tmp_path / "b.xml.gz", "wt") as f:
        f.write(text)
    whole = sitemaps.sitemap_urls(spark.createDataFrame([(text,)], "xml string")).orderBy("ordinal").select("loc", "lastmod").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        for name in ("a.xml", "b.xml.gz"):
            found = sitemaps.sitemap_files(spark, str(tmp_path / name))
            assert found.orderBy("block", "place").select("loc", "lastmod").collect() == whole
            assert (found.select("block").distinct().count() > 3) == (name == "a.xml")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><lastmod>2024</lastmod><loc>b</loc></sitemap></sitemapindex>")
    assert rows(sitemaps.sitemap_files(spark, str(tmp_path / "i.xml"), "sitemap"), "loc", "lastmod") == [("a", ""), ("b", "2024")]


def test_payloads(spark):
    body = lambda s: spark.createDataFrame([(s,), ("junk",)], "body string")
    assert rows(payloads.apply_v2(body('{"positions":[{"id":"1","name":"N","canonicalPositionUrl":"u"},{"ats_job_id":"2"}]}')), "posting_id", "title", "detail_url") == [("1", "N", "u")]
    usa = '{"SearchResult":{"SearchResultItems":[{"MatchedObjectDescriptor":{"PositionID":"P","PositionTitle":"T","ApplyURI":["a1","a2"],"PublicationStartDate":"2024-01-02T00:00","PositionRemuneration":[{"MinimumRange":"10","MaximumRange":"20","RateIntervalCode":"PA"}],"PositionSchedule":[{"Name":"Full"}]}}]}}'
    assert rows(payloads.usajobs(body(usa)), "posting_id", "detail_url", "post_date", "salary_min", "salary_raw", "full_time_status") == [("P", "a1", "2024-01-02", 10.0, "10–20 PA", "Full")]
    gd = '{"Results":[{"Link":{"Url":"/j/1"},"ReferenceCode":"R","EmploymentTypes":["A","B"],"Locations":[{"Name":"X","State":"TX"}]}]}'
    assert rows(payloads.encoded_search(body(gd), "https://g.example"), "posting_id", "detail_url", "raw_location", "full_time_status", "remote_status") == [("R", "https://g.example/j/1", "X", "A, B", "")]
    state = '{"refineSearch":{"data":{"jobs":[{"jobId":"1","title":"a"},{"jobId":"1","title":"b"},{"jobId":" "},{"jobID":"2"}]}}}'
    states = spark.createDataFrame([(state,)], "s string").select(F.parse_json("s").alias("state"))
    assert rows(payloads.page_state_jobs(states, "https://p/"), "posting_id", "title", "detail_url") == [("1", "a", "https://p/global/en/job/1/"), ("2", None, "https://p/global/en/job/2/")]
    context = '<script id="vike_pageContext" type="application/json">{"data":{"data":{"data":[{"url":"u1"},{"x":1}]}}}</script>'
    assert rows(payloads.page_context_urls(spark.createDataFrame([(context,), ("none",)], "html string")), "detail_url") == [("u1",)]
    detail = '<script id="vike_pageContext">{"data":{"data":{"id":7,"description":"<p>Hi</p>"}}}</script>'
    assert rows(payloads.page_context_detail(spark.createDataFrame([("u", detail)], "url string, html string")), "job_url", "description_text") == [("u", "Hi")]
    assert payloads.api_records(body('{"data":[{"a":1},{"a":2}]}')).count() == 2


def test_listing_pages(spark):
    html = '<a href="/job/1?x">One</a><a class=c href="/other">No</a><a href="/job/1?x">Again</a><tr class="data-row odd"><td class="c"><a href="/p/77/">T</a></td><td class="jobLocation">L</td><td class="jobDate">D</td></tr><tr class="data-row"><td>none</td></tr><a data-job-id="5" href="/q">Q</a><a data-job-id="5" href="/r">R</a>'
    df = spark.createDataFrame([(1, "https://a/x", html), (2, "https://a/y", None)], "page int, url string, html string")
    links = pages.page_links(df, "page")
    assert rows(links, "detail_url", "posting_id", "title") == [("https://a/job/1?x", "1", "One")]
    assert rows(pages.link_counts(links, "page")) == [(1, 1, 1)]
    assert rows(pages.table_rows(df, "page"), "posting_id", "title", "raw_location", "post_date") == [("77", "T", "L", "D")]
    assert rows(pages.job_id_anchors(df, "page"), "posting_id", "detail_url") == [("5", "https://a/q")]
    card = '<div class="job-card x"><h2><a href="/j/1">Eng</a></h2><p>Location:</p><p>Austin</p></div><div class="job-card"><p>untitled</p></div>'
    assert rows(pages.cards(spark.createDataFrame([(1, "https://a/", card)], "page int, url string, html string"), "page", ["Location:"], host="a"), "title", "detail_url", "location") == [("Eng", "https://a/j/1", "Austin")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', {"k": "v"}), (2, None, None)], "id int, `x.y[0]` string, extra map<string,string>")
    tables.write_full_csv(df, str(tmp_path / "csv"))
    assert rows(tables.wide_csv(spark, str(tmp_path / "csv"), ["x.y[0]", "extra"])) == sorted([('a "q"', '{"k":"v"}'), (None, None)], key=repr)
    (tmp_path / "urls.txt").write_text(" u1 \n\nu2\n")
    assert rows(tables.url_list(spark, str(tmp_path / "urls.txt"))) == [("u1",), ("u2",)]
    assert tables.write_report(df.limit(0), "s", str(tmp_path / "none")) is False
    long = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "a", "z")], "id int, path string, value string")
    wide = tables.pivoted(long, "id")
    assert wide.columns == ["id", "a", "b"] and rows(wide) == [(1, "y", "x"), (2, "z", None)]
    both = tables.union_all(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int"))
    assert rows(both) == sorted([(1, None), (None, 2)], key=repr)


def test_responses_whole(spark):
    kinds = [None, "", " ", "application/xml", "application/json"]
    bodies = [(1, i, kinds[i % 5], "x" * 300_000 + "Job-77") for i in range(15)] + [(1, 15, "image/png", "job-77")]
    responses = spark.createDataFrame(bodies, "page int, ordinal int, content_type string, body string")
    tokens = spark.createDataFrame([(1, ["job-77", *["x" * n for n in range(1, 15)]])], "page int, tokens array<string>")
    found = probe.responses_with_tokens(responses, tokens).collect()
    assert sorted(r.ordinal for r in found) == list(range(15))
    assert all(r.hits == ["job-77", *["x" * n for n in range(1, 10)]] for r in found)


def test_page_state_of_other_shape(spark):
    deep = '{"a":' * 20 + '{"list": [{"x": 1}], "rows": [[], [{"id": 8, "title": "d"}]]}' + "}" * 20
    docs = ['{"widget": {"tags": [{"n": 1}], "results": [{"jobId": "5", "title": "a"}, {"jobID": " "}]}}', deep, '{"jobs": [], "more": [{"id": "9"}]}', '{"x": [1, {"id": 3}]}', None]
    states = spark.createDataFrame([(d,) for d in docs], "s string").selectExpr("try_parse_json(s) AS state")
    found = payloads.page_state_jobs(states, "https://p").collect()
    assert sorted((r.posting_id, r.title) for r in found) == [("5", "a"), ("8", "d")]


def test_columns_of_the_same_name_stay(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("b", 1, 9)], "_key string, _n int, _share int")
    assert rows(dedupe.keep_first(df, F.col("_key"), "_n"), "_key", "_n", "_share") == [("a", 1, 7), ("b", 1, 9)]
    assert rows(dedupe.global_budget(df, "_key", 1, "_n"), "_key", "_n", "_share") == [("a", 1, 7)]
    assert rows(dedupe.dropped_pairs(df, F.col("_key"), "_n", "_share"), "key", "kept__share", "dropped__share") == [("a", 7, 8)]


def test_a_run_takes_nested_jobs_and_rejects(spark, tmp_path):
    listing = spark.createDataFrame([("v", 1, "1", "t", "https://h/1"), ("v", 2, "2", "", "https://h/2"), ("v", 3, "3", "t", "https://h/3")], "vendor string, ordinal int, posting_id string, title string, detail_url string")
    state = '<script>phApp.ddo = {"position": {"posting": {"title": "Deep", "postedDate": "2024-01-05"}}};</script>'
    pages = spark.createDataFrame([("https://h/1", state), ("https://h/3", state)], "url string, html string")
    good, bad = run.new_postings(listing, pages, None, "phenom_search", F.lit("2024-02-01").cast("date"), cap=2)
    assert rows(good, "posting_id", "position_title", "post_date") == [("1", "t", "2024-01-05")]
    assert [(r.posting_id, r.errors) for r in bad.collect()] == [("2", ["missing_required:Position Title"])]


def test_counts_of_links(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "c")], "page int, detail_url string")
    assert rows(pages.link_counts(links, "page"), "page", "got", "added") == [(1, 2, 2), (2, 1, 0), (3, 2, 1)]


def test_scans_indexes_and_rejects(spark):
    job = lambda n: f"https://x/job/{n}"
    urls = spark.createDataFrame([(s, i, job(i) if i % 2 else f"https://x/a/{i}") for s, n in (("a", 3), ("b", 4), ("d", 5), ("e", 1)) for i in range(n)], "sitemap string, ordinal int, loc string")
    children = spark.createDataFrame([("i", 0, "a"), ("i", 2, "missing"), ("i", 5, "b"), ("i", 6, "d"), ("i", 9, "e"), ("j", 1, "b"), ("j", 2, "b"), ("k", 0, "missing")], "index string, child int, sitemap string")
    seen = lambda **most: rows(probe.scanned_children(children, urls, **most), "index", "child", "n_urls")
    assert seen() == [("i", 0, 3), ("i", 2, None), ("i", 5, 4), ("i", 6, 5), ("i", 9, 1), ("j", 1, 4), ("j", 2, 4), ("k", 0, None)]
    # A child in which the budget is used up is read to its end; one that wasn't captured uses nothing.
    assert seen(most_urls=4, most_children=4) == [("i", 0, 3), ("i", 2, None), ("i", 5, 4), ("j", 1, 4), ("k", 0, None)]
    assert seen(most_urls=3) == [("i", 0, 3), ("j", 1, 4), ("k", 0, None)]
    assert seen(most_children=1) == [("i", 0, 3), ("j", 1, 4), ("k", 0, None)]
    whole = rows(probe.scan_totals(probe.scanned_children(children, urls), urls, samples=1))
    assert whole == [("i", 5, 13, 5, 2, [job(1)], [job(1), job(3)]), ("j", 2, 8, 4, 2, [job(1)], [job(1), job(3)]), ("k", 1, 0, 0, 0, [], [])]
    each = rows(probe.scan_totals(probe.scanned_children(children, urls, most_children=2), urls, each=True, stored=1))
    assert each[:2] == [("i", 0, 1, 3, 1, 1, [job(1)], [job(1)]), ("i", 2, 1, 0, 0, 0, [], [])] and len(each) == 5
    docs = spark.createDataFrame([("<sitemapindex><sitemap><loc> a </loc></sitemap></sitemapindex>",)], "xml string")
    assert rows(sitemaps.sitemap_index(docs), "ordinal", "loc", "lastmod") == [(0, "a", "")]


def test_mapped_fields_are_stripped_once(spark):
    raw = spark.sql("SELECT map('PositionID', ' 7 ', 'PositionURI.0', '  ', 'ApplyURI', 'u', 'other', 'x', 'PositionTitle', CAST(NULL AS STRING)) AS v, 1 AS _V")
    rows = mapping.normalize(raw, "usajobs_api", {"V": "v"})
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    r = rows.first()
    assert (r.posting_id, r.detail_url, r.position_title, rows.columns[:2]) == ("7", "u", None, ["v", "_V"])
