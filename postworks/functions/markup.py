"""What pages hold for machines: JSON-LD, meta tags, page state, labelled blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postworks.functions import tree
from postworks.functions.json_paths import balanced, entries_map, flat_entries, flat_fields, relaxed
from postworks.functions.text import bound, html_to_text, strip, unescape


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, "" if it has none."""
    return unescape(F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{p}", 1), F.lit("")) for p in ('"([^"]*)"', "'([^']*)'")], F.lit("")))


def json_ld(html: Column) -> Column:
    """JSON-LD blocks that parse, as variants."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: bound(strip(x), relaxed)), lambda v: v.isNotNull())


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def job_posting_ld(html: Column) -> Column:
    """The JSON-LD block, or item of a block, that is a job posting; else the first block."""
    kind = lambda v: F.try_variant_get(v, "$['@type']", "string")
    items = F.flatten(F.transform(json_ld(html), lambda v: F.coalesce(_items(v), F.array(v))))
    return bound(items, lambda x: F.coalesce(F.try_element_at(F.filter(x, lambda v: kind(v) == "JobPosting"), F.lit(1)), F.try_element_at(x, F.lit(1))))


def json_ld_fields(html: Column, depth: int) -> Column:
    """Map of all JSON-LD blocks: "ld." and a dotted path, "ld[i]." for item i of a block that is a list; later blocks count."""
    named = lambda prefix, v: F.transform(flat_entries(v, depth), lambda e: F.struct(F.concat(prefix, e["path"]).alias("path"), e["value"].alias("value")))
    listed = lambda v: F.flatten(F.transform(_items(v), lambda x, i: named(F.concat(F.lit("ld["), i.cast("string"), F.lit("].")), x)))
    blocks = F.transform(json_ld(html), lambda v: F.when(_items(v).isNotNull(), listed(v)).otherwise(named(F.lit("ld."), v)))
    return entries_map(F.flatten(blocks))


def meta_tags(html: Column) -> Column:
    """Map of meta names and properties to contents; the first of a name counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    pairs = F.transform(tags, lambda t: F.struct(F.coalesce(F.nullif(attribute(t, "name"), F.lit("")), attribute(t, "property")).alias("k"), attribute(t, "content").alias("v")))
    named = F.filter(pairs, lambda p: p["k"] != "")
    # The last of equal paths counts, hence backwards.
    return bound(named, lambda x: entries_map(F.reverse(F.transform(x, lambda p: F.struct(p["k"].alias("path"), p["v"].alias("value"))))))


def h1_text(html: Column) -> Column:
    return F.nullif(html_to_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)), F.lit(""))


def canonical_link(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*>)", 1)
    return F.nullif(attribute(tag, "href"), F.lit(""))


def data_layer(html: Column) -> Column:
    """Map of the 'key': 'value' pairs pushed to the page's data layer."""
    bodies = F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)dataLayer\.push\(\s*\{(.*?)\}\s*\)"), F.lit(1)), ",")
    pattern = r"""['"]([\w.-]+)['"]\s*:\s*['"]([^'"]*)['"]"""
    keys, values = (F.regexp_extract_all(bodies, F.lit(pattern), F.lit(n)) for n in (1, 2))
    return entries_map(F.transform(F.arrays_zip(keys.alias("path"), values.alias("value")), lambda e: F.struct(e["path"].alias("path"), e["value"].alias("value"))))


def page_state(html: Column) -> Column:
    """The page's phApp.ddo object as a variant, up to the first "};"."""
    return F.try_parse_json(F.nullif(F.regexp_extract(html, r"(?s)phApp\.ddo\s*=\s*(\{.*?\});", 1), F.lit("")))


def total_hits(state: Column) -> Column:
    return F.coalesce(F.try_variant_get(state, "$.eagerLoadRefineSearch.totalHits", "int"), F.lit(0))


def smart_apply(html: Column) -> Column:
    """The embedded application payload as a variant, in whatever element it stands."""
    body = F.regexp_extract(html, r"""(?is)<(\w+)\b[^>]*\bid\s*=\s*["']smartApplyData["'][^>]*>(.*?)</\1\s*>""", 2)
    return F.try_parse_json(F.nullif(unescape(strip(body)), F.lit("")))


def smart_apply_fields(html: Column, depth: int) -> Column:
    """Map of the application payload's paths; its first position stands under positions.0."""
    return flat_fields(smart_apply(html), depth)


def embedded_posting(html: Column) -> Column:
    """The job posting in a text/javascript script: of the first script that is marked as one, the object that begins at its first brace.

    Braces are balanced, those inside strings don't count; null if the object doesn't close, doesn't parse or is none.
    """
    bodies = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["']text/javascript["'][^>]*>(.*?)</script>"""), F.lit(1))
    marked = F.try_element_at(F.filter(bodies, lambda b: b.rlike(r'"@type"\s*:\s*"JobPosting"')), F.lit(1))
    parsed = lambda v: F.when(F.try_variant_get(v, "$['@type']", "string") == "JobPosting", v)
    return bound(F.when(marked.isNotNull(), bound(balanced(marked), relaxed)), parsed)


def element(html: Column, name: str) -> Column:
    """Inner markup of the first element with a class, up to the end tag that closes it; null if there is none."""
    opening = rf"""(?is)<(\w+)\b[^>]*\bclass\s*=\s*["'][^"']*(?<![\w-]){name}(?![\w-])[^"']*["'][^>]*>(.*)$"""
    zero = F.struct(F.lit(1).alias("level"), F.lit(0).alias("n"))

    def inner(found: Column) -> Column:
        tag = found["tag"]

        def step(s: Column, piece: Column) -> Column:
            begins = lambda mark: F.lower(F.substring(piece, 1, 60)).startswith(F.concat(F.lit(mark), tag))
            level = s["level"] + F.when(begins("</"), -1).when(begins("<"), 1).otherwise(0)
            return F.when(s["level"] == 0, s).otherwise(F.struct(level.alias("level"), (s["n"] + F.when(level > 0, 1).otherwise(0)).alias("n")))

        cut = lambda pieces: F.array_join(F.slice(pieces, 1, F.aggregate(pieces, zero, step, lambda s: s["n"])), "")
        return F.when(tag != "", bound(F.split(found["after"], F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)"))), cut))

    # Page and tag are computed once, not for each piece.
    return bound(html, lambda h: bound(F.struct(F.lower(F.regexp_extract(h, opening, 1)).alias("tag"), F.regexp_extract(h, opening, 2).alias("after")), inner))


#: Bold labels that expressions are asked to follow, as each looks at all that comes after it.
FEW_LABELS = 64


def bold_blocks(html: Column) -> Column:
    """Map of bold labels to what follows them beside them, in the description if the page has one.

    A block ends at the next bold label beside it or with the element that both
    stand in. Items of lists beside the label, one a line, count; without such a
    list the text does. Of equal labels the longest value counts. "Page Title"
    is the page's heading, unless there is such a label. Pages with many labels, or
    whose tags don't pair up, are read as trees.
    """
    simple = F.coalesce(tree.pairs_up(html) & (F.regexp_count(html, F.lit(r"(?i)<b\b")) <= FEW_LABELS), F.lit(True))
    return F.coalesce(tree.label_map(F.when(~simple, html)), bound(F.when(simple, html), _few_blocks))


def _few_blocks(html: Column) -> Column:
    inner = F.coalesce(element(html, "career-detail-description"), html)
    parts = F.split(inner, r"(?i)<b\b[^>]*>")

    def of(parts: Column) -> Column:
        numbers = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda i: _block(F.array_join(F.slice(parts, i, F.size(parts)), "<b>")))

    def richest(named: Column) -> Column:
        # Shorter values first, of equally long ones later labels first: the last of equal paths counts.
        order = lambda b, i: F.struct(F.length(b["value"]).alias("n"), (-i).alias("i"), b["label"].alias("path"), b["value"].alias("value"))
        return entries_map(F.transform(F.array_sort(F.transform(named, order)), lambda x: F.struct(x["path"], x["value"])))

    blocks = bound(F.filter(bound(parts, of), lambda b: b["label"] != ""), richest)
    titled = lambda b, t: F.when(F.map_contains_key(b, "Page Title") | t.isNull(), b).otherwise(F.map_concat(b, F.create_map(F.lit("Page Title"), t)))
    return bound(blocks, lambda b: bound(h1_text(html), lambda t: titled(b, t)))


def _block(part: Column) -> Column:
    """Label and value of a block, from after its <b>."""

    def named(halves: Column) -> Column:
        label = strip(F.regexp_replace(html_to_text(F.element_at(halves, 1)), r":+\s*$", ""))
        return F.struct(label.alias("label"), _beside(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))).alias("value"))

    return bound(F.split(part, r"(?i)</b\s*>", 2), named)


def _beside(rest: Column) -> Column:
    """What stands beside a label: tags are followed until the element around it ends or another label begins beside it."""
    spans = "array<struct<a: int, b: int>>"
    # Pieces so far, where the open list begins (0: none is open), and the lists that have ended.
    zero = F.struct(F.lit(0).alias("level"), F.lit(False).alias("ended"), F.lit(0).alias("n"), F.lit(0).alias("open"), F.array().cast(spans).alias("lists"))

    def tag(piece: Column) -> Column:
        closes = piece.startswith("</")
        named = lambda name: F.struct(name.alias("name"), ((name != "") & closes).alias("closes"), ((name != "") & ~closes & ~name.isin(tree.VOID) & ~piece.rlike(r"^<[^>]*/>")).alias("opens"))
        return bound(F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9]*)", 1)), named)

    def step(s: Column, piece: Column) -> Column:
        name, closes, opens = piece["name"], piece["closes"], piece["opens"]
        beside, n = s["level"] == 0, s["n"] + 1
        level = s["level"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        done = closes & (level == 0) & (s["open"] > 0)
        lists = F.when(done, F.concat(s["lists"], F.array(F.struct(s["open"].alias("a"), s["n"].alias("b"))))).otherwise(s["lists"])
        begun = F.when(opens & beside & (name == "ul"), n).when(done, 0).otherwise(s["open"])
        went = F.struct(level.alias("level"), F.lit(False).alias("ended"), n.alias("n"), begun.alias("open"), lists.alias("lists"))
        stopped = F.struct(s["level"].alias("level"), F.lit(True).alias("ended"), s["n"].alias("n"), s["open"].alias("open"), s["lists"].alias("lists"))
        return F.when(s["ended"], s).when((closes & beside) | (opens & beside & (name == "b")), stopped).otherwise(went)

    def value(pieces: Column) -> Column:
        def chosen(s: Column) -> Column:
            lists = F.when(s["open"] > 0, F.concat(s["lists"], F.array(F.struct(s["open"].alias("a"), s["n"].alias("b"))))).otherwise(s["lists"])
            inner = F.array_join(F.flatten(F.transform(lists, lambda x: F.slice(pieces, x["a"], x["b"] - x["a"] + 1))), "")
            items = F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), _flat_text)
            return F.when(F.size(lists) > 0, F.array_join(items, "\n")).otherwise(_flat_text(F.array_join(F.slice(pieces, 1, s["n"]), "")))

        return bound(F.aggregate(F.transform(pieces, tag), zero, step), chosen)

    return bound(F.split(rest, "(?=<)"), value)


def _flat_text(html: Column) -> Column:
    """Text on one line, a blank for each tag."""
    return strip(F.regexp_replace(html_to_text(F.regexp_replace(html, "<", " <")), r"\s+", " "))


#: How lines of a posting's head begin, and the fields that they give.
HEAD_LINES = {
    "Req ID": ["req_id", "requisition_id"],
    "Team:": ["team"],
    "Entity:": ["entity"],
    "US Citizenship Required for this Position": ["us_citizenship_required", "us_person_required"],
    "Shift:": ["shift"],
    "Relocation:": ["relocation_available"],
    "Virtual/Telework Opportunity": ["remote_status"],
    "Travel Requirement": ["travel_requirement"],
    "Clearance Required": ["clearance_required", "clearance_level_must_possess"],
}


def _last_line(lines: Column, begin: str) -> Column:
    return F.try_element_at(F.filter(lines, lambda x: x.startswith(begin)), F.lit(-1))


def head_fields(text: Column) -> Column:
    """Struct of the fields of a posting's head lines; of equal lines the last counts."""
    lines = F.transform(F.split(text, r"\n"), strip)
    found = {}
    for begin, names in HEAD_LINES.items():
        line = _last_line(lines, begin)
        value = F.when(line.contains(":"), strip(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))).otherwise(line)
        found |= dict.fromkeys(names, value)
    found["full_time_status"] = F.try_element_at(F.filter(lines, lambda x: x.endswith("-Time")), F.lit(-1))
    return F.struct(*[c.alias(n) for n, c in found.items()])


def split_location(raw: Column) -> Column:
    """Struct of city, state and country of a comma-separated place; what follows the second comma is the country."""
    parts = F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")
    at = lambda n: F.try_element_at(parts, F.lit(n))
    return F.struct(at(1).alias("city"), at(2).alias("state"), F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), ", ")).alias("country"))


def pager(text: Column, fallback: int = 25) -> Column:
    """Struct of page size and total of "Results a – b of n"."""
    pattern = r"Results\s+\d+\s*[–-]\s*(\d+)\s+of\s+(\d+)"
    size, total = (F.regexp_extract(text, pattern, n).try_cast("int") for n in (1, 2))
    return F.struct(F.coalesce(F.nullif(size, F.lit(0)), F.lit(fallback)).alias("page_size"), F.coalesce(total, F.lit(fallback)).alias("total"))


def visible_total(text: Column, limit: int) -> Column:
    """Struct of the total of "of 1,234" and the pages of `limit` that it takes."""
    total = F.replace(F.regexp_extract(text, r"\bof\s+(\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("int")
    return F.struct(F.coalesce(total, F.lit(0)).alias("total"), F.ceil(F.coalesce(total, F.lit(0)) / limit).cast("int").alias("pages"))


def last_page(text: Column) -> Column:
    """The largest page number of a pager's links, 1 if there is none."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(1))


#: Marks in a page by which it is told where a posting's data is.
SIGNALS = {"phapp_ddo": "phApp.ddo", "smartapply": "smartApplyData", "next_data": 'id="__NEXT_DATA__"', "nuxt_data": "window.__NUXT__", "initial_state": "__INITIAL_STATE__"}


def signals(html: Column) -> Column:
    """Names of the marks that a page has."""
    ld = html.rlike(r"""(?i)type=["']application/ld\+json["']""") & html.contains('"JobPosting"')
    marks = [F.when(ld, "json_ld"), *[F.when(html.contains(m), n) for n, m in SIGNALS.items()]]
    return F.array_compact(F.array(*marks))


def detail_source(found: Column, in_responses: Column, in_page: Column) -> Column:
    """Where a posting's data comes from, by the first mark of the order."""
    has = lambda n: F.array_contains(found, n)
    return (
        F.when(has("json_ld"), "JSON_LD")
        .when(has("phapp_ddo"), "PHAPP_DDO")
        .when(has("smartapply"), "SMARTAPPLY_EMBED")
        .when(has("next_data") | has("nuxt_data") | has("initial_state"), "APP_STATE_EMBED")
        .when(in_responses, "XHR_JSON_OR_HTML")
        .when(in_page, "SERVER_HTML")
        .otherwise("UNKNOWN")
    )


def highlight_source(found: Column, in_responses: Column, in_page: Column) -> Column:
    return F.when((F.size(found) > 0) | in_page | ~in_responses, "DOM").otherwise("XHR")


def search_source(url: Column, body: Column) -> Column:
    """Which search service a response comes from; null if none is known."""
    u, b = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    oracle = (u.contains("/hcmrestapi/resources/") & u.contains("recruitingce")) | (b.contains("requisitionlist") & b.contains("totaljobscount"))
    return F.when(oracle, "ORACLE_HCM_API")


def matched_patterns(text: Column, patterns: list[str], most: int) -> Column:
    """The patterns that a text matches, in the list's order."""
    return F.slice(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in patterns])), 1, most)


def geo_record(record: Column) -> Column:
    """Struct of a geocoder's record (a variant): place, address parts as a map with titled names, bounding box."""
    get = lambda path, kind: F.try_variant_get(record, path, kind)
    address = get("$.address", "map<string,string>")
    box = get("$.boundingbox", "array<string>")
    side = lambda n: F.when(F.size(box) == 4, F.element_at(box, n).try_cast("double"))
    return F.struct(
        get("$.lat", "double").alias("lat"),
        get("$.lon", "double").alias("lon"),
        get("$.display_name", "string").alias("display_name"),
        F.transform_keys(address, lambda k, v: F.concat(F.lit("Geo "), F.initcap(F.replace(k, F.lit("_"), F.lit(" "))))).alias("address"),
        *[side(n).alias(name) for n, name in enumerate(("south", "north", "west", "east"), 1)],
    )


def repair_bom(xml: Column) -> Column:
    """XML text without a byte order mark, read rightly or as Latin-1."""
    x = F.regexp_replace(xml, "^﻿", "")
    return F.regexp_replace(F.when(x.startswith("ï»¿"), F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")).otherwise(x), "^﻿", "")


