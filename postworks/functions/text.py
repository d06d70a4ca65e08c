"""Text expressions: Column to Column, no Python code at run time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postworks.functions import tree

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&ndash;": "–", "&mdash;": "—", "&bull;": "•", "&amp;": "&"}


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often make uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def strip(c: Column) -> Column:
    """White space of all kinds off both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor blank, stripped; "" if there is none."""
    return F.coalesce(*[blank_to_null(c.cast("string")) for c in columns], F.lit(""))


def first_any(*values: Column) -> Column:
    """The first variant that is neither null nor a blank text, as text; of a list its first element counts."""
    one = lambda v: F.coalesce(F.try_element_at(F.try_variant_get(v, "$", "array<string>"), F.lit(1)), F.try_variant_get(v, "$", "string"))
    is_list = lambda v: F.try_variant_get(v, "$", "array<variant>").isNotNull()
    return F.coalesce(*[F.when(is_list(v) | (strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("x"))) != ""), one(v)) for v in values])


def unescape(c: Column) -> Column:
    """Common HTML entities as characters; `&amp;` comes last, so that nothing is unescaped twice."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ENTITIES.items(), c)


def html_to_text(html: Column) -> Column:
    """Readable text of markup: scripts and styles go, breaks and blocks end lines, spaces collapse. Null gives ""."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)<\s*/?\s*br\b[^>]*>|</\s*(p|div|li|h[1-6]|tr|ul|ol)\s*>", "\n")
    x = F.regexp_replace(unescape(F.regexp_replace(x, r"(?s)<[^>]*>", "")), " ", " ")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n ?", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


#: More of them, which descriptions have.
_NAMED = {"&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»"}
#: Tags, comments and declarations.
_TAG = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>"


def description_text(html: Column) -> Column:
    """A posting's description as text: each text between tags is a line, but a list item is one line whatever it holds.

    Items that aren't closed or stand inside one another, and rare entities, are left to the tree. Null gives "".
    """
    plain = [e[1:-1] for e in _ENTITIES | _NAMED]
    odd = F.coalesce(html.rlike(r"(?is)<li\b(?:(?!</li\b).)*<li\b") | (F.regexp_count(html, F.lit(r"(?i)<li\b")) != F.regexp_count(html, F.lit(r"(?i)</li\b"))) | html.rlike(rf"&(?!(?:{'|'.join(plain)});)#?[A-Za-z0-9]+"), F.lit(False))
    ends, named = r"(?U)^\s+|\s+$", {"&nbsp;": "\u00a0"} | _NAMED
    texts = lambda x: F.filter(F.transform(F.split(x, _TAG), lambda t: F.regexp_replace(unescape(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), named.items(), t)), ends, "")), lambda t: t != "")

    def lines(part: Column, i: Column) -> Column:
        halves = F.split(part, r"(?i)</li\s*>", 2)
        item = F.array_join(texts(F.element_at(halves, 1)), " ")
        listed = F.concat(F.filter(F.array(item), lambda t: t != ""), texts(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))))
        return F.when(i == 0, texts(part)).otherwise(listed)

    whole = F.regexp_replace(F.coalesce(F.when(~odd, html), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "<p>")
    joined = F.array_join(F.flatten(F.transform(F.split(whole, r"(?i)<li\b[^>]*>"), lines)), "\n")
    tidy = F.regexp_replace(F.regexp_replace(joined, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.coalesce(tree.description_lines(F.when(odd, html)), F.regexp_replace(F.replace(tidy, F.lit("\u00a0"), F.lit(" ")), ends, ""))


def quoted(text: str) -> str:
    """A pattern for exactly this text."""
    return "\\Q" + text + "\\E"


def labelled_line(text: Column, label: str) -> Column:
    """What follows a label at the start of a line, "" if the label isn't there."""
    return strip(F.regexp_extract(text, rf"(?m)^{quoted(label)}\s*(.+)$", 1))


def excerpt(body: Column, patterns: list[str], context: int = 90, longest: int = 700) -> Column:
    """The text around the first match of the first pattern that matches; without a match the beginning."""
    out = F.substring(body, 1, longest)
    for p in reversed(patterns):
        at = F.regexp_instr(body, F.lit(p))
        size = F.length(F.regexp_substr(body, F.lit(p)))
        start = F.greatest(at - context, F.lit(1))
        end = F.least(at + size + context, F.length(body) + 1)
        cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(body, start, end - start), F.when(end <= F.length(body), "…").otherwise(""))
        cut = F.regexp_replace(F.regexp_replace(cut, r"[ \t]+", " "), r"\n{3,}", "\n\n")
        cut = F.when(F.length(cut) > longest, F.concat(F.substring(cut, 1, longest), F.lit("…"))).otherwise(cut)
        out = F.when(at > 0, cut).otherwise(out)
    return F.coalesce(out, F.lit(""))
