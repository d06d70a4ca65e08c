"""URL expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from postworks.functions.text import strip

#: Parts of a path by which a posting's URL is known.
POSTING_PARTS = ["/job/", "/jobs/", "/careers/job/", "/career/job/", "/vacancy/", "/vacancies/", "/position/", "/positions/", "/opportunity/", "/opportunities/"]


@functools.cache
def stop_words() -> list[str]:
    """English words that tell nothing about a posting: the list that Spark ML's StopWordsRemover has for English."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def _parts(url: Column) -> tuple[Column, Column, Column]:
    u = strip(url)
    part = lambda n: F.regexp_extract(u, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", n)
    return F.lower(part(1)), part(2), part(3)


def normalize_url(url: Column) -> Column:
    """Scheme, host and path of an http(s) URL; parameters, query and fragment go. Anything else is null."""
    scheme, host, path = _parts(url)
    bare = F.regexp_replace(path, r";[^/]*$", "")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, bare))


def base_url(url: Column) -> Column:
    """Scheme and host, https where no scheme is given; "" for blank."""
    u = strip(F.coalesce(url, F.lit("")))
    full = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(u == "", "").otherwise(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def resolve_link(base: Column, href: Column) -> Column:
    """A link as an absolute URL. Dot segments stay."""
    scheme, host, path = _parts(base)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?") | href.startswith("#") | (href == ""), F.concat(root, path, href))
        .otherwise(F.concat(root, folder, href))
    )


def set_query(url: Column, values: dict[str, Column]) -> Column:
    """The URL with query parameters replaced or added; others keep their last value, keys are in order."""
    base, query = F.regexp_extract(url, r"(?s)^([^?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)(#.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    old = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v")))
    new = F.array(*[F.struct(F.lit(k).alias("k"), F.url_encode(v.cast("string")).alias("v")) for k, v in values.items()])
    names = F.array_distinct(F.transform(F.concat(old, new), lambda x: x["k"]))
    last = F.transform(names, lambda n: F.concat(n, F.lit("="), F.element_at(F.filter(F.concat(old, new), lambda x: x["k"] == n), -1)["v"]))
    return F.concat(base, F.lit("?"), F.array_join(last, "&"), fragment)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(_parts(url)[2], "/"), lambda s: s != "")


def posting_id(url: Column) -> Column:
    """The segment after "job", else the last long number, else the last segment."""
    parts = path_segments(url)
    after = F.transform(F.filter(F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("a"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("b")), lambda p: F.lower(p["a"]) == "job"), lambda p: p["b"])
    numbers = F.filter(parts, lambda s: s.rlike("^R?[0-9]{5,}$"))
    return F.coalesce(F.try_element_at(after, F.lit(1)), F.try_element_at(numbers, F.lit(-1)), F.try_element_at(parts, F.lit(-1)))


def last_segment(url: Column, back: int = 1) -> Column:
    return F.try_element_at(path_segments(url), F.lit(-back))


def trailing_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(\d+)/?$", 1), F.lit(""))


def is_posting_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)" + "|".join(POSTING_PARTS)), F.lit(False))


def url_tokens(url: Column, most: int = 12) -> Column:
    """The posting's id and the words of the last segment that tell something."""
    last = F.coalesce(last_segment(url), F.lit(""))
    plain = F.translate(F.coalesce(F.try_url_decode(last), last), "+-_", "   ")
    words = F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(stop_words()))
    return F.struct(posting_id(url).alias("job_id"), F.slice(words, 1, most).alias("slug_words"), last.alias("path_last"))
