"""Vendors' fields to canonical columns, by tables of sources; and the choice of an adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postworks.functions.names import free
from postworks.functions.text import strip

_PLACE = {"city": "addressLocality", "state": "addressRegion", "country": "addressCountry", "postal_code": "postalCode"}
_LD_PLACE = {c: [f"J:jobLocation.0.address.{n}"] for c, n in _PLACE.items()}
_URL = {"detail_url": ["L:canonical_url", "L:detail_url"]}
_REQUISITION = ["V:requisitionId", "V:requisitionID", "V:reqId", "V:jobId", "V:jobID", "V:id"]


def _plain(letter: str, **fields: str) -> dict[str, list[str]]:
    """Columns with one source each, in the same map."""
    return {c: [f"{letter}:{f}"] for c, f in fields.items()}


def _own_place_first(*columns: str) -> dict[str, list[str]]:
    """Places by the vendor's document, else by JSON-LD."""
    return {c: [f"V:{'postalCode' if c == 'postal_code' else c}", *_LD_PLACE[c]] for c in columns}


_LD = _plain("J", position_title="title", description="description", post_date="datePosted", full_time_status="employmentType") | _LD_PLACE | _URL

#: For each platform or vendor the sources of a column, best first. L listing, J JSON-LD, V vendor's
#: document, M meta tags, B bold blocks, H head lines of the description, T labelled lines of the page.
SOURCES: dict[str, dict[str, list[str]]] = {
    "sitemap": _LD
    | {
        "posting_id": ["J:identifier.value", "L:posting_id"],
        "position_title": ["J:title", "L:title"],
        "post_date": ["J:datePosted", "L:lastmod"],
        "raw_location": ["M:gtm_tbcn_location", "L:raw_location"],
        "full_time_status": ["J:employmentType", "L:full_time_status"],
        "business_sector": ["M:gtm_tbcn_division"],
    },
    "phenom_sitemap": _own_place_first(*_PLACE)
    | _URL
    | {
        "posting_id": ["L:posting_id", *_REQUISITION, "J:identifier.value", "J:identifier", "M:job-ats-req-id"],
        "position_title": ["L:title", "V:title", "V:jobTitle", "J:title", "M:og:title"],
        "description": ["V:description", "V:jobDescription", "J:description"],
        "post_date": ["V:datePosted", "V:postedDate", "V:postingDate", "J:datePosted"],
        "raw_location": ["V:location", "V:locations", "M:gtm_tbcn_location", "L:raw_location"],
        "full_time_status": ["V:employmentType", "J:employmentType"],
    },
    "browser_paged_html": _plain("L", posting_id="posting_id", position_title="title", raw_location="raw_location", detail_url="detail_url") | {"position_title": ["L:h1", "L:title"]},
    "encoded_api": _plain("L", posting_id="posting_id", position_title="title", raw_location="raw_location", post_date="post_date", job_category="job_category", clearance_level_must_possess="clearance", full_time_status="full_time_status", remote_status="remote_status", country="country", state="state", latitude="latitude", longitude="longitude")
    | _plain("B", description="description", career_level="Career Level")
    | _URL,
    "usajobs_api": _plain("V", position_title="PositionTitle", salary_raw="UserArea.Details.Salary", city="PositionLocation.0.CityName", state="PositionLocation.0.StateCode", country="PositionLocation.0.CountryCode", postal_code="PositionLocation.0.PostalCode")
    | {
        "posting_id": ["V:PositionID", "L:posting_id"],
        "detail_url": ["V:PositionURI.0", "V:PositionURI", "V:ApplyURI.0", "V:ApplyURI"],
        "description": ["V:PositionSummary", "V:UserArea.Details.JobSummary"],
        "post_date": ["V:PublicationStartDate", "V:PositionStartDate"],
        "raw_location": ["V:PositionLocationDisplay", "V:PositionLocation.0.LocationName", "V:PositionLocation.0.CityName"],
        "full_time_status": ["V:PositionSchedule.0.Name"],
        "job_category": ["V:JobCategory.0.Name"],
        "required_skills": ["V:UserArea.Details.RequiredDocuments", "V:QualificationSummary"],
    },
    "bae": _plain("V", position_title="title", description="description", post_date="postedDate", raw_location="location", city="city", state="state", country="country", full_time_status="structureData.employmentType", hours_per_week="structureData.workHours", business_sector="sector", business_area="businessArea", industry="industry", shift="shift", career_level="careerLevel", travel_percentage="travelPercentage", us_person_required="isUsCitizenshipRequired", clearance_level_must_possess="isSecurityClearanceRequired", clearance_level_must_obtain="clearenceLevel", salary_raw="payRange", salary_min="salaryMin", salary_max="salaryMax", bonus="bonus", remote_status="physicalLocation", job_category="category", latitude="latitude", longitude="longitude")
    | _URL
    | {"posting_id": ["L:posting_id", "V:jobId"], "postal_code": [*_LD_PLACE["postal_code"], "V:postalCode"]},
    "rtx": _own_place_first("city", "state", "country")
    | _URL
    | _plain("V", post_date="postedDate", business_area="businessUnit", relocation_available="relocationEligible", clearance_level_must_possess="clearanceType", salary_min="minSalary", salary_max="maxSalary")
    | {
        "posting_id": ["L:posting_id"],
        "position_title": ["V:title", "J:title"],
        "description": ["J:description", "V:description"],
        "raw_location": ["V:address", "V:location"],
        "postal_code": _LD_PLACE["postal_code"],
        "full_time_status": ["V:type", "J:employmentType"],
        "hours_per_week": ["J:workHours"],
    },
    # These two take the employment type for the clearance, as their source does.
    "lockheed": _LD_PLACE | _URL | _plain("J", position_title="title", post_date="datePosted", clearance_level_must_possess="employmentType", industry="industry", required_education="educationRequirements", required_skills="qualifications") | _plain("M", raw_location="gtm_tbcn_location", business_sector="gtm_tbcn_division") | {"posting_id": ["L:posting_id"], "description": ["B:description"]},
    "boeing": {c: v for c, v in _LD_PLACE.items() if c != "postal_code"} | _URL | _plain("J", position_title="title", business_area="industry", clearance_level_must_possess="employmentType") | _plain("M", raw_location="gtm_tbcn_location", business_sector="gtm_tbcn_division", job_category="gtm_tbcn_jobcategory") | {"posting_id": ["L:posting_id"], "description": ["B:description", "J:description"]},
    "booz_allen": _LD | {"posting_id": ["J:identifier.value", "L:posting_id"], "business_area": ["J:hiringOrganization.name"]} | {c: [f"J:jobLocation.address.{n}", *_LD_PLACE[c]] for c, n in _PLACE.items()},
    "l3harris": _LD | {"posting_id": ["M:job-ats-req-id", "L:posting_id"], "raw_location": ["M:gtm_tbcn_location"], "business_sector": ["M:gtm_tbcn_division"]},
    "thales": _LD | {"posting_id": ["L:posting_id"], "raw_location": ["M:gtm_tbcn_location", "M:location"], "business_sector": ["M:gtm_tbcn_division"]},
    "northrop": _plain("V", description="job_description", job_category="department", business_area="business_unit", clearance_level_must_possess="custom_JD.data_fields.Clearance Type.0") | _URL | {"posting_id": ["L:posting_id"], "position_title": ["L:title"], "raw_location": ["L:raw_location"], "full_time_status": ["J:employmentType", "V:custom_JD.data_fields.Employment Type.0"], "post_date": ["J:datePosted"]},
    "hii": _plain("H", us_person_required="us_person_required", full_time_status="full_time_status", shift="shift", relocation_available="relocation_available", remote_status="remote_status", travel_percentage="travel_requirement", clearance_level_must_possess="clearance_level_must_possess") | _URL | {"posting_id": ["H:req_id", "L:posting_id"], "position_title": ["L:title", "M:og:title", "L:h1"], "raw_location": ["L:raw_location"], "post_date": ["L:post_date"], "description": ["L:description"]},
    "leidos": {"posting_id": ["T:Job #:"], "position_title": ["L:title"], "detail_url": ["L:detail_url"], "description": ["L:description"], **_plain("T", raw_location="Location:", job_category="Category:", full_time_status="Schedule (FT/PT):", shift="Shift:", remote_status="Remote Type:", clearance_level_must_possess="Clearance:", business_sector="Sector:", post_date="Original Posting:", salary_raw="Pay Range:")},
}
SOURCES["apply_v2"] = SOURCES["sitemap"] | {"raw_location": ["L:raw_location"]}
SOURCES["paged_html"] = {c: s for c, s in SOURCES["sitemap"].items() if c != "business_sector"}
SOURCES["phenom_search"] = SOURCES["phenom_sitemap"] | {"raw_location": ["L:raw_location", "V:location", "M:gtm_tbcn_location"], "full_time_status": ["J:employmentType", "V:employmentType"]}

#: Adapters in order of registration, each with the platform name that configurations give it.
ADAPTERS = [
    ("sitemap", "sitemap_job_urls"),
    ("phenom_sitemap", "phenom"),
    ("apply_v2", "apply_v2"),
    ("paged_html", "paged_html_search"),
    ("browser_paged_html", "selenium_paged_html_search"),
    ("usajobs_api", "usajobs_api"),
    ("phenom_search", "phenom_search"),
    ("encoded_api", "encoded_request_api"),
]


#: Keys of a listing that go on with its rows, by platform.
PASSED = {"phenom_sitemap": ["Req Number", "Clearance", "_page", "_rank"]}


def normalize(df: DataFrame, platform: str, maps: dict[str, str], sources: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Canonical columns of a platform's rows. maps: the map column of each letter that the rows have.

    Where a platform passes keys of its listing on, a map column `passed` holds those that a row has.
    """
    table = (sources or SOURCES)[platform]
    wanted = {letter: sorted({s.partition(":")[2] for paths in table.values() for s in paths if s.partition(":")[0] == letter}) for letter in maps}
    # The fields that are looked for are stripped once, map by map, and blank ones left out; columns then only look them up.
    clean = {letter: free(f"_{letter}", df.columns) for letter in maps if wanted[letter]}
    filled = lambda letter: F.map_filter(F.transform_values(F.map_filter(F.col(maps[letter]), lambda k, v: k.isin(wanted[letter])), lambda k, v: strip(v)), lambda k, v: v != "")

    def value(source: str) -> Column:
        letter, _, path = source.partition(":")
        return F.try_element_at(F.col(clean[letter]), F.lit(path)) if letter in maps else F.lit(None).cast("string")

    more = [F.map_filter(F.col(maps["L"]), lambda k, v: k.isin(PASSED[platform])).alias("passed")] if platform in PASSED and "L" in maps else []
    rows = df.withColumns({c: filled(letter) for letter, c in clean.items()})
    return rows.select(*df.columns, *[F.coalesce(*[value(s) for s in paths]).alias(c) for c, paths in table.items()], *more)


def _evidence(text, flag) -> list[tuple[str, Column, float]]:
    """What tells of an adapter in a company's configuration, and how sure that is; the strongest of an adapter counts."""
    search, home, api, maps = text("search_url"), text("careers_url"), text("api_url"), text("sitemap_url", "sitemap_index_url", "sitemap_urls")
    kind = F.lower(text("discovery_type"))
    pages = F.concat_ws(" ", search, home)
    return [
        ("sitemap", kind.isin("sitemap", "sitemap_index"), 1.0),
        ("sitemap", maps != "", 0.8),
        ("phenom_sitemap", maps.contains("/global/en/"), 0.85),
        ("apply_v2", api.contains("/api/apply/v2/jobs") | search.contains("/api/apply/v2/jobs"), 0.9),
        ("paged_html", kind == "html_search", 0.6),
        ("paged_html", pages.contains("search-jobs") | pages.contains("/search/"), 0.35),
        ("browser_paged_html", flag("requires_browser") & search.contains("{page}"), 0.75),
        ("usajobs_api", search.contains("data.usajobs.gov/api/Search"), 0.95),
        ("phenom_search", search.contains("search-results") & search.contains("/en/"), 0.8),
        ("encoded_api", api.contains("API/Careers/CareerSearch"), 0.9),
    ]


def choose_adapter(companies: DataFrame) -> DataFrame:
    """Companies with their adapter (chosen_adapter), how sure it is (adapter_score) and why there is none (adapter_error).

    The adapter that a company names, as `adapter` or as `platform`, by our name or by
    its configuration's, is taken; a name that isn't known is an error. Without a name the
    one with the strongest evidence in the configuration is taken, of equal ones the
    first registered, and sitemap where nothing tells. Columns may be missing or null.
    """
    types = dict(companies.dtypes)

    def text(*names: str) -> Column:
        """The columns' texts, one after another; lists are joined."""
        own = [F.array_join(n, " ") if types[n].startswith("array") else F.col(n).cast("string") for n in names if n in types]
        return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in own])

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in types else F.lit(False)

    order = {name: i for i, (name, _) in enumerate(ADAPTERS)}
    known = F.create_map(*[F.lit(x) for pair in dict(n for ours, given in ADAPTERS for n in ((ours, ours), (given, ours))).items() for x in pair])
    named = F.coalesce(*[F.nullif(strip(text(c)), F.lit("")) for c in ("adapter", "platform")])
    told = F.array(*[F.struct(F.when(rule, F.lit(score)).otherwise(F.lit(0.0)).alias("score"), F.lit(-order[name]).alias("order"), F.lit(name).alias("name")) for name, rule, score in _evidence(text, flag)])
    best = F.array_max(told)  # where nothing tells, all scores are 0 and the first adapter is the greatest
    found = F.try_element_at(known, named)
    return companies.select(
        "*",
        F.when(named.isNotNull(), found).otherwise(best["name"]).alias("chosen_adapter"),
        F.when(named.isNull(), best["score"]).when(found.isNotNull(), F.lit(1.0)).alias("adapter_score"),
        F.when(named.isNotNull() & found.isNull(), F.concat(F.lit("unknown_platform:"), named)).alias("adapter_error"),
    )
