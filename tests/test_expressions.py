"""Expressions against values that are worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from postworks.functions import dates, json_paths, keys, markup, money, sections, text, urls

DAY = datetime.date(2024, 3, 1)


@pytest.mark.parametrize(
    ("url", "clean"),
    [
        ("https://example.com/path?utm=foo", "https://example.com/path"),
        (" HTTPS://Example.com/a;b/c;d?x#y ", "https://Example.com/a;b/c"),
        ("https://example.com", "https://example.com"),
        ("not-a-url", None),
        ("ftp://example.com/x", None),
        ("", None),
        (None, None),
    ],
)
def test_normalize_url(one, url, clean):
    assert one(lambda c: urls.normalize_url(c.cast("string")), url) == clean


def test_links(one):
    base = "https://a.example/x/y?q=1"
    for href, full in [("/z", "https://a.example/z"), ("z", "https://a.example/x/z"), ("//b/c", "https://b/c"), ("http://c/", "http://c/"), ("?p=2", "https://a.example/x/y?p=2")]:
        assert one(urls.resolve_link, base, href) == full
    assert one(lambda c: urls.base_url(c), " example.com/x") == "https://example.com"
    assert one(lambda c: urls.base_url(c), "  ") == ""


def test_query_parameters(one):
    assert one(lambda c: urls.set_query(c, {"page": F.lit(2), "q": F.lit("a b")}), "https://a/x?page=1&k=v&k=w#f") == "https://a/x?page=2&k=w&q=a+b#f"


@pytest.mark.parametrize(
    ("url", "found"),
    [("https://a/global/en/job/R12345/Title", "R12345"), ("https://a/jobs/title-98765/1234567", "1234567"), ("https://a/x/some-title", "some-title"), ("https://a/", None)],
)
def test_posting_id(one, url, found):
    assert one(urls.posting_id, url) == found


def test_url_words(one):
    assert one(urls.last_segment, "https://a/b/c/") == "c"
    assert one(lambda c: urls.last_segment(c, 2), "https://a/b/c/") == "b"
    assert one(urls.trailing_number, "https://a/b/123/") == "123"
    assert one(urls.is_posting_url, "https://a/JOB/7") is True
    assert one(lambda c: urls.is_posting_url(c.cast("string")), None) is False
    found = one(urls.url_tokens, "https://a/job/77/senior-engineer-for-the-radar%20lab")
    assert (found.job_id, found.slug_words) == ("77", ["senior", "engineer", "radar", "lab"])


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("2025/11/01", "2025-11-01"), ("2025-11-01T10:00:00Z", "2025-11-01"), ("2025-1-2", "2025-01-02"), ("2025/13/45", "2025-13-45"), ("20251101", "2025-11-01"), ("3 days ago", "2024-02-27"), ("1D ago", "2024-02-29"), ("Yesterday", "2024-02-29"), ("Dec 11, 2025", None), ("2025", None), ("", None), (None, None)],
)
def test_dates(one, raw, iso):
    assert one(lambda c, d: dates.parse_date(c.cast("string"), d), raw, DAY) == iso


@pytest.mark.parametrize(
    ("raw", "low", "high"),
    [("$50/hr - $80/hr", 104000.0, 166400.0), ("$90,000 - $120,000", 90000.0, 120000.0), ("2,000.5 / month", 24006.0, 24006.0), ("400/Day", 104000.0, 104000.0), ("competitive", None, None), (None, None, None)],
)
def test_salary(one, raw, low, high):
    found = one(lambda c: money.salary(c.cast("string")), raw)
    assert (found.low, found.high, found.raw) == (low, high, raw)


@pytest.mark.parametrize(("raw", "pair"), [("$95,000 to $120,000", (95000.0, 120000.0)), ("5,000 per month", (60000.0, None)), ("$50 per hour", (None, None)), ("1.2.3 and 80000", (80000.0, None)), ("120 days", (None, None))])
def test_yearly_pay(one, raw, pair):
    assert tuple(one(money.yearly_only, raw)) == pair


def test_html_text(one):
    html = "<div>A&nbsp;b<br/>c</div><script>var t='</p>';</script><style>p{}</style><ul><li>x &amp;lt; y</li><li> z</li></ul><!-- n -->"
    assert one(text.html_to_text, html) == "A b\nc\nx &lt; y\nz"
    assert one(lambda c: text.html_to_text(c.cast("string")), None) == ""
    assert one(text.html_to_text, "<p>Hello<br/>World</p>") == "Hello\nWorld"


def test_first_text_and_labels(one):
    assert one(lambda a, b, c: text.first_text(a.cast("string"), b, c), None, " \t", " x ") == "x"
    assert one(lambda c: text.labelled_line(c, "Shift:"), "Job #: 7\nShift: Day\n") == "Day"
    assert one(lambda c: text.labelled_line(c, "Pay:"), "x") == ""


def test_excerpt(one):
    body = "a" * 100 + " needle " + "b" * 100
    assert one(lambda c: text.excerpt(c, ["nothing", "needle"], context=3), body) == "…aa needle bb…"
    assert one(lambda c: text.excerpt(c, ["x"], longest=5), body) == "aaaaa"


def test_sections(one):
    description = "Intro\nBasic Qualifications:\nBS degree\n5 years\nBenefits\nmany\nResponsibilities\n- build;  test\n* ship\nPay\n1"
    found = one(sections.education_and_skills, description)
    assert found.required_education == "BS degree\n5 years"
    assert found.required_skills == "build\ntest\nship"
    assert found.preferred_education is None and found.preferred_skills is None


def test_keys(one):
    assert one(lambda a, b, c: keys.dedupe_key(a, b, c), "", "u", "t") == "u"
    assert one(lambda a: keys.dedupe_key(a.cast("string"), a.cast("string"), a.cast("string")), None) == ""
    assert one(lambda c: keys.as_number(c), "1.5") == 1.5
    assert one(lambda c: keys.as_number(c), "x") is None
    assert one(lambda c: keys.unknown_as_json(F.create_map(F.lit("a"), c, F.lit("b"), c), ["a"]), "v") == '{"b":"v"}'
    assert one(lambda c: keys.unknown_as_json(F.create_map(F.lit("a"), c), ["a"]), "v") is None


PAGE = """<html><head><META property='og:title' content="T"><meta content="D1" name="gtm_tbcn_division"><meta name="gtm_tbcn_division" content="D2">
<link href="https://a/c" rel="canonical"><script type="application/ld+json">not json</script>
<script type="application/ld+json">[{"@type":"Org"},{"@type":"JobPosting","title":"Eng","jobLocation":[{"address":{"addressLocality":"X"}}]}]</script>
<script>phApp.ddo = {"eagerLoadRefineSearch":{"totalHits":3}}; dataLayer.push({'k': 'v', "m": "1"}); dataLayer.push({'k': 'w'});</script></head>
<body><h1 class="t">A <i>title</i></h1><div><b>Skills:</b><ul><li>one</li><li>two</li></ul><b>Place</b>Here<br>now<b>Place</b>Here</div></body></html>"""


def test_markup(one):
    assert one(markup.meta_tags, PAGE) == {"og:title": "T", "gtm_tbcn_division": "D1"}
    assert one(markup.canonical_link, PAGE) == "https://a/c"
    assert one(markup.h1_text, PAGE) == "A title"
    assert one(lambda c: json_paths.dig(markup.job_posting_ld(c), "title", kind="string"), PAGE) == "Eng"
    assert one(lambda c: F.to_json(markup.data_layer(c)), PAGE) == '{"k":"w","m":"1"}'
    assert one(lambda c: markup.total_hits(markup.page_state(c)), PAGE) == 3
    assert one(markup.bold_blocks, PAGE) == {"Skills": "one\ntwo", "Place": "Here now", "Page Title": one(markup.h1_text, PAGE)}
    assert one(markup.signals, PAGE) == ["json_ld", "phapp_ddo"]
    assert one(lambda c: markup.detail_source(markup.signals(c), F.lit(False), F.lit(True)), PAGE) == "JSON_LD"
    assert one(lambda c: markup.detail_source(markup.signals(c), F.lit(True), F.lit(True)), "x") == "XHR_JSON_OR_HTML"
    assert one(lambda c: markup.highlight_source(markup.signals(c), F.lit(True), F.lit(False)), "x") == "XHR"
    assert one(lambda a, b: markup.search_source(a, b), "", "RequisitionList TotalJobsCount") == "ORACLE_HCM_API"
    assert one(lambda c: markup.matched_patterns(c, ["b", "z", "a"], 2), "ab") == ["b", "a"]


def test_bold_blocks_beside_their_labels(one):
    found = lambda html: one(markup.bold_blocks, html)
    # A block ends with the element that its label stands in, and labels inside what is beside it don't end it.
    assert found("<p><b>Place:</b> here</p><ul><li>no</li></ul><b>Duties</b><p>Do <b>great</b> things</p><ul><li>one</li><li>two <i>2</i></li></ul> tail <ul><li>three</li></ul>") == {"Place": "here", "Duties": "one\ntwo 2\nthree", "great": "things"}
    assert found("<b>A</b> x<br>y <div><ul><li>in a div</li></ul></div><b>A:</b> z") == {"A": "x y in a div"}
    assert found("<b></b> x <b>Open <i>one</i></b> <ul><li>a</li>") == {"Open one": "a"}
    # Only the description counts where a page has one, however its inner elements nest.
    page = '<h1>Engineer</h1><b>Menu</b> no<div class="x career-detail-description y"><div><b>Skills</b><ul><li>Spark</li></ul></div></div><b>Footer</b> no'
    assert found(page) == {"Skills": "Spark", "Page Title": "Engineer"}
    assert found('<div class="other-career-detail-description-not"><b>L</b> v</div>') == {"L": "v"}


def test_json_ld_maps(one):
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    page = block('{"@type":"JobPosting","title":"A\nB","jobLocation":[{"address":{"addressLocality":"X"}}],"skills":["a","b"],"none":null,"empty":[]}') + block("broken {") + block('[{"title":"C"},{"title":"D","o":{}}]') + block('{"title":"E"}')
    ld = {"@type": "JobPosting", "jobLocation.0.address.addressLocality": "X", "skills": "a; b", "none": "", "empty": ""}
    assert one(lambda c: markup.json_ld_fields(c, 4), page) == {**{f"ld.{k}": v for k, v in ld.items()}, "ld.title": "E", "ld[0].title": "C", "ld[1].title": "D"}
    assert one(lambda c: json_paths.flat_fields(markup.job_posting_ld(c), 4), page) == {**ld, "title": "A\nB"}
    assert one(lambda c: markup.json_ld_fields(c, 4), "<p>") == {}
    payload = '<pre class="x" id="smartApplyData">{&quot;positions&quot;:[{&quot;id&quot;:7,&quot;at&quot;:{&quot;city&quot;:&quot;X&quot;}}]}</pre>'
    assert one(lambda c: markup.smart_apply_fields(c, 4), payload) == {"positions.0.id": "7", "positions.0.at.city": "X"}


def test_nested_jobs_and_first_values(one):
    assert one(lambda c: F.to_json(json_paths.unwrap_job(F.try_parse_json(c))), '{"job":{"data":{"posting":{"id":1}}},"position":{"id":2}}') == '{"id":1}'
    assert one(lambda c: F.to_json(json_paths.unwrap_job(F.try_parse_json(c))), '{"job":"x","id":3}') == '{"id":3,"job":"x"}'
    values = '{"a":null,"b":"  ","c":[],"d":["x","y"],"e":5}'
    at = lambda c, n: json_paths.dig(F.try_parse_json(c), n)
    assert one(lambda c: text.first_any(at(c, "a"), at(c, "b"), at(c, "e")), values) == "5"
    assert one(lambda c: text.first_any(at(c, "b"), at(c, "d"), at(c, "e")), values) == "x"
    assert one(lambda c: text.first_any(at(c, "a"), at(c, "b")), values) is None


def test_embedded_objects(one):
    nested = '<script type="text/javascript">var a = 1;</script><script type=\'text/javascript\' defer>window.x = {"@type": "JobPosting", "description":"<p>a } b</p>\n", "at":{"x":{}}}; var y = {"z":1};</script>'
    assert one(lambda c: F.to_json(markup.embedded_posting(c)), nested) == '{"@type":"JobPosting","at":{"x":{}},"description":"<p>a } b</p>\\n"}'
    assert one(lambda c: markup.embedded_posting(c).isNull(), nested.replace("};", "; ")) is True
    script = '<script type="text/javascript">var x = {"@type":"JobPosting","title":"T"};</script>'
    assert one(lambda c: json_paths.dig(markup.embedded_posting(c), "title", kind="string"), script) == "T"
    assert one(lambda c: markup.embedded_posting(c).isNull(), "<script type='text/javascript'>JobPosting {</script>") is True
    code = '<code id="smartApplyData">{&quot;positions&quot;:[{&quot;id&quot;:7}]}</code>'
    assert one(lambda c: F.try_variant_get(markup.smart_apply(c), "$.positions[0].id", "int"), code) == 7


def test_head_lines_and_pagers(one):
    found = one(markup.head_fields, "Req ID: 7\nTeam: A\nTeam: B\nFull-Time\nClearance Required: Secret")
    assert (found.req_id, found.requisition_id, found.team, found.full_time_status, found.clearance_level_must_possess, found.shift) == ("7", "7", "B", "Full-Time", "Secret", None)
    assert tuple(one(markup.split_location, "Austin, TX, US, Earth")) == ("Austin", "TX", "US, Earth")
    assert tuple(one(markup.split_location, "Austin")) == ("Austin", None, None)
    assert tuple(one(markup.pager, "Results 1 – 50 of 321")) == (50, 321)
    assert tuple(one(markup.pager, "none")) == (25, 25)
    assert tuple(one(lambda c: markup.visible_total(c, 25), "1 to 25 of 1,234 jobs")) == (1234, 50)
    assert one(markup.last_page, '<a href="?page=2"><a href="/x?a=1&page=11">') == 11
    assert one(markup.last_page, "") == 1


def test_geo_record(one):
    record = '{"lat":"1.5","lon":2,"address":{"city_block":"B"},"boundingbox":["1","2","3","4"]}'
    found = one(lambda c: markup.geo_record(F.parse_json(c)), record)
    assert (found.lat, found.lon, found.address, found.south, found.east) == (1.5, 2.0, {"Geo City Block": "B"}, 1.0, 4.0)


def test_byte_order_marks(one):
    assert one(markup.repair_bom, "﻿<a/>") == "<a/>"
    assert one(markup.repair_bom, "ï»¿<a/>") == "<a/>"


def test_flatten(spark):
    doc = '{"a":{"b":[1,2],"c":null},"d":[{"e":"x"},{"e":"y"}],"f":[],"g":{}}'
    rows = spark.createDataFrame([(1, doc), (2, "bad"), (3, None)], "id int, j string").withColumn("v", F.try_parse_json("j"))
    dotted = {r.path: r.value for r in json_paths.flatten(rows, F.col("v"), "id").collect()}
    assert dotted == {"a.b": "1; 2", "a.c": "", "d.0.e": "x", "d.1.e": "y", "f": ""}
    indexed = {r.path: r.value for r in json_paths.flatten(rows, F.col("v"), "id", indexed=True).collect()}
    assert indexed == {"a.b[0]": "1", "a.b[1]": "2", "a.c": None, "d[0].e": "x", "d[1].e": "y"}


DOCS = [
    '{"a":{"b":[1,2.50,true,null],"c":null},"d":[{"e":"x"},{"e":[]},[1,[2]]],"f":[],"g":{},"h":{"i":{}},"é":"ü"}',
    '[1, "two", null]', '[[], {}, {"k": false}]', '"text"', "12", "null", "[]", "{}", "bad", None, '{"n": 1e30, "m": -0.5, "big": 12345678901234567890}',
]


@pytest.mark.parametrize("indexed", [False, True])
def test_walked_documents_are_like_opened_ones(spark, monkeypatch, indexed):
    deep = '{"a":' * 300 + '{"x": [1, {"y": "z"}]}' + "}" * 300
    rows = spark.createDataFrame(list(enumerate([*DOCS, deep])), "id int, j string").withColumn("v", F.try_parse_json("j"))

    def found():
        got = {}
        for r in json_paths.flatten(rows, F.col("v"), "id", indexed=indexed).collect():
            got.setdefault(r.id, []).append((r.path, r.value))
        return got

    # No job looks first.
    spark.sparkContext.setJobGroup(f"flatten-{indexed}", "")
    json_paths.flatten(rows, F.col("v"), "id", indexed=indexed)
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup(f"flatten-{indexed}"))
    opened = found()
    below = ".".join(["a"] * 300)
    assert opened[len(DOCS)] == ([(f"{below}.x[0]", "1"), (f"{below}.x[1].y", "z")] if indexed else [(f"{below}.x.0", "1"), (f"{below}.x.1.y", "z")])
    for levels in (0, 1, 2):
        monkeypatch.setattr(json_paths, "LEVELS", levels)
        assert found() == opened


def test_unwrap_and_prefix(one):
    assert one(lambda c: json_paths.dig(json_paths.unwrap(F.parse_json(c)), "id", kind="int"), '{"jobDetail":{"data":{"job":{"id":5}}}}') == 5
    assert one(lambda c: json_paths.dig(json_paths.unwrap(F.parse_json(c)), "id", kind="int"), '{"id":6}') == 6
    assert one(lambda c: json_paths.strip_prefix(F.create_map(F.lit("meta.x"), c), "meta."), "v") == {"x": "v"}


def test_a_page_is_told_once_for_its_labels(spark):
    page = F.concat(F.lit("<b>marker:</b> x"), F.col("id").cast("string"))
    plan = spark.range(1).select(markup.bold_blocks(page).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("marker") < 10


@pytest.mark.parametrize("make", [lambda c: json_paths.flat_fields(F.try_parse_json(c), 3), lambda c: F.map_from_entries(json_paths._unrolled(F.try_parse_json(c), False)["entries"])])
def test_levels_below_the_leaves_are_not_worked_on(one, monkeypatch, make):
    calls, children = [], json_paths._children

    def counted(node, indexed):
        calls.append(node)
        return children(node, indexed) if len(calls) < 3 else F.raise_error(F.lit("opened too far")).cast("array<struct<path:string,value:variant>>")

    monkeypatch.setattr(json_paths, "_children", counted)
    assert one(make, '{"a":{"b":"c"}}') == {"a.b": "c"}


def test_sections_of_texts_without_headings_are_not_worked_on(one, monkeypatch):
    monkeypatch.setattr(sections, "section", lambda text, headings: F.raise_error(F.lit("looked for a section")).cast("string"))
    assert set(one(sections.education_and_skills, "About us, as a text\nof two lines").asDict().values()) == {None}
    assert set(one(lambda c: sections.education_and_skills(c.cast("string")), None).asDict().values()) == {None}
