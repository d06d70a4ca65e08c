"""Listing rows from captured JSON payloads: posting_id, title, raw_location, detail_url and what else a source gives."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postworks.functions.json_paths import dig, with_fields
from postworks.functions.text import html_to_text
from postworks.functions.urls import resolve_link


def apply_v2(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Positions of an apply-v2 payload that have a URL."""
    kind = "positions array<struct<id: string, ats_job_id: string, name: string, location: string, department: string, canonicalPositionUrl: string>>"
    rows = payloads.select(F.posexplode(F.from_json(body, kind)["positions"]).alias("ordinal", "p"))
    listed = rows.select("ordinal", F.coalesce("p.id", "p.ats_job_id").alias("posting_id"), F.col("p.name").alias("title"), F.col("p.location").alias("raw_location"), F.col("p.department").alias("department"), F.col("p.canonicalPositionUrl").alias("detail_url"))
    return listed.where("detail_url IS NOT NULL AND detail_url != ''")


def _first_url(v: Column, name: str) -> Column:
    value = dig(v, name)
    return F.coalesce(F.try_element_at(F.try_variant_get(value, "$", "array<string>"), F.lit(1)), F.try_variant_get(value, "$", "string"))


def usajobs(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Search items of the federal jobs API."""
    items = F.try_variant_get(F.try_parse_json(body), "$.SearchResult.SearchResultItems", "array<variant>")
    rows = payloads.select(F.posexplode(items).alias("ordinal", "item")).select("ordinal", dig(F.col("item"), "MatchedObjectDescriptor").alias("d"))
    text = lambda *path: dig(F.col("d"), *path, kind="string")
    one = lambda path: F.try_variant_get("d", path, "string")
    low, high, unit = (one(f"$.PositionRemuneration[0].{n}") for n in ("MinimumRange", "MaximumRange", "RateIntervalCode"))
    return rows.select(
        "ordinal",
        text("PositionID").alias("posting_id"),
        text("PositionTitle").alias("title"),
        text("PositionLocationDisplay").alias("raw_location"),
        F.coalesce(_first_url(F.col("d"), "PositionURI"), _first_url(F.col("d"), "ApplyURI")).alias("detail_url"),
        F.substring(text("PublicationStartDate"), 1, 10).alias("post_date"),
        low.try_cast("double").alias("salary_min"),
        high.try_cast("double").alias("salary_max"),
        F.btrim(F.concat(F.coalesce(low, F.lit("")), F.lit("–"), F.coalesce(high, F.lit("")), F.lit(" "), F.coalesce(unit, F.lit(""))), F.lit(" –")).alias("salary_raw"),
        one("$.PositionSchedule[0].Name").alias("full_time_status"),
        one("$.JobCategory[0].Name").alias("job_category"),
    )


def encoded_search(payloads: DataFrame, base: str, body: str = "body") -> DataFrame:
    """Results of an encoded-request career search; the first location counts."""
    kind = "Results array<struct<Link: struct<Url: string>, ReferenceCode: string, EmploymentTypes: array<string>, Category: string, Clearance: string, Title: string, Date: string, Company: string, WorkplaceOptions: array<string>, Locations: array<struct<Country: string, State: string, Latitude: double, Longitude: double, Name: string>>>>"
    rows = payloads.select(F.posexplode(F.from_json(body, kind)["Results"]).alias("ordinal", "r"))
    place = F.try_element_at("r.Locations", F.lit(1))
    joined = lambda c: F.coalesce(F.array_join(F.col(c), ", "), F.lit(""))
    return rows.select(
        "ordinal",
        F.col("r.ReferenceCode").alias("posting_id"),
        F.col("r.Title").alias("title"),
        place["Name"].alias("raw_location"),
        resolve_link(F.lit(base), F.col("r.Link.Url")).alias("detail_url"),
        F.col("r.Date").alias("post_date"),
        F.col("r.Company").alias("company"),
        F.col("r.Category").alias("job_category"),
        F.col("r.Clearance").alias("clearance"),
        joined("r.EmploymentTypes").alias("full_time_status"),
        joined("r.WorkplaceOptions").alias("remote_status"),
        *[place[n].alias(n.lower()) for n in ("Country", "State", "Latitude", "Longitude")],
    )


def _listed_jobs(document: str | None) -> str | None:
    """The first list of objects, at any place and depth, of which one has an id key; a walk without a bound, which expressions can't say."""
    stack = [] if document is None else [json.loads(document)]
    while stack:
        cur = stack.pop()
        if isinstance(cur, list) and cur and all(isinstance(x, dict) for x in cur) and any(k in x for x in cur for k in ("jobId", "jobID", "id")):
            return json.dumps(cur)
        below = cur.values() if isinstance(cur, dict) else cur
        stack.extend(x for x in reversed(list(below)) if isinstance(x, (dict, list)))
    return None


def page_state_jobs(states: DataFrame, base: str, state: str = "state") -> DataFrame:
    """Jobs of a page state (a variant), in the first of its known shapes, or else in the first list of objects with an id, by names of keys; blank and repeated ids are dropped."""
    shapes = ["$.eagerLoadRefineSearch.data.jobs", "$.refineSearch.data.jobs", "$.data.jobs", "$.jobs"]
    known = F.coalesce(*[F.try_variant_get(state, p, "array<variant>") for p in shapes])
    other = F.udf(_listed_jobs, "string", useArrow=False)(F.when(known.isNull(), F.to_json(state)))
    jobs = F.coalesce(known, F.try_variant_get(F.try_parse_json(other), "$", "array<variant>"))
    rows = states.select(F.posexplode(jobs).alias("ordinal", "j"))
    text = lambda *names: F.coalesce(*[dig(F.col("j"), n, kind="string") for n in names])
    listed = rows.select("ordinal", F.trim(text("jobId", "jobID", "id", "reqId")).alias("posting_id"), text("title", "jobTitle").alias("title"), text("location", "cityStateCountry").alias("raw_location"))
    first = listed.where("posting_id != ''").groupBy("posting_id").agg(F.min_by(F.struct("ordinal", "title", "raw_location"), "ordinal").alias("f"))
    return first.select("f.ordinal", "posting_id", "f.title", "f.raw_location", F.concat(F.lit(base.rstrip("/") + "/global/en/job/"), "posting_id", F.lit("/")).alias("detail_url"))


def page_context_urls(pages: DataFrame, html: str = "html") -> DataFrame:
    """Job URLs of a page's embedded context; a page without one gives none."""
    body = F.regexp_extract(html, r"""(?is)<script[^>]*id\s*=\s*["']vike_pageContext["'][^>]*>(.*?)</script>""", 1)
    jobs = F.try_variant_get(F.try_parse_json(F.nullif(body, F.lit(""))), "$.data.data.data", "array<variant>")
    return pages.select(F.posexplode(jobs).alias("ordinal", "j")).select("ordinal", F.coalesce(dig(F.col("j"), "url", kind="string"), dig(F.col("j"), "jobUrl", kind="string")).alias("detail_url")).where("detail_url IS NOT NULL")


def page_context_detail(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(job_url, fields, description_text) of detail pages: the embedded job as a map of indexed paths, with its URL, and its description as text."""
    body = F.regexp_extract(html, r"""(?is)<script[^>]*id\s*=\s*["']vike_pageContext["'][^>]*>(.*?)</script>""", 1)
    job = F.coalesce(*[F.try_variant_get(F.try_parse_json(F.nullif(body, F.lit(""))), p, "variant") for p in ("$.data.data", "$.data")])
    rows = pages.select(F.col(url).alias("job_url"), job.alias("job")).where("job IS NOT NULL")
    found = with_fields(rows, {"fields": F.col("job")}, "job_url", html_to_text(dig(F.col("job"), "description", kind="string")).alias("description_text"), indexed=True)
    return found.select("job_url", F.map_concat("fields", F.create_map(F.lit("jobUrl"), F.col("job_url"))).alias("fields"), "description_text")


def api_records(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(ordinal, fields): records of an API's pages as maps of indexed paths; a page that doesn't parse is skipped."""
    rows = payloads.select(F.posexplode(F.try_variant_get(F.try_parse_json(body), "$.data", "array<variant>")).alias("ordinal", "record"))
    return with_fields(rows, {"fields": F.col("record")}, "ordinal", indexed=True)
