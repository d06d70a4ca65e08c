"""Sections of posting descriptions, by their headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postworks.functions.text import bound, quoted, strip

#: Headings of each kind of section, in the order in which they are looked for.
HEADINGS = {
    "required_education": ["Required Education", "Basic Qualifications", "Minimum Qualifications", "Required Qualifications", "Required Education, Experience, & Skills"],
    "preferred_education": ["Preferred Education", "Preferred Qualifications", "Desired Qualifications", "Preferred Education, Experience, & Skills"],
    "required_skills": ["Required Skills", "Required Experience", "What You Will Need", "Must Have", "Responsibilities", "Required Education, Experience, & Skills"],
    "preferred_skills": ["Preferred Skills", "Nice to Have", "Desired Skills", "Preferred Education, Experience, & Skills"],
}
#: Headings that end a section.
ENDINGS = ["Responsibilities", "Duties", "Benefits", "Pay", "Pay Information", "Salary", "Equal Opportunity", "EEO", "About Us", "About BAE Systems", "About BAE Systems Intelligence & Security", "Travel", "Relocation"]


def section(text: Column, headings: list[str]) -> Column:
    """Text below the first heading of the list that is there, up to a heading that ends it; "" if none is there."""
    end = r"(?im)^\s*(?:" + "|".join(map(quoted, ENDINGS)) + r")\s*:?\s*$"

    def first(s: Column) -> Column:
        out = F.lit("")
        for h in reversed(headings):
            line = rf"(?im)^\s*{quoted(h)}\s*:?\s*$"
            below = F.regexp_extract(s, line + r"((?s:.*))", 1)
            there = F.lower(s).contains(h.lower()) & s.rlike(line)  # the first is cheap, and mostly false
            out = F.when(there, strip(F.element_at(F.split(below, end, 2), 1))).otherwise(out)
        return out

    return bound(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), first)


def _may_hold(text: Column, headings: list[str]) -> Column:
    """Whether a text has the letters of any heading, wherever they stand."""
    return reduce(lambda x, y: x | y, [F.lower(text).contains(h.lower()) for h in headings])


#: What begins or parts the items of a section, and what is taken off their ends.
_ITEMS, _EDGES = r"(?m)^\s*[-*•]\s+|[\n;]+", " \t•-*;"


def bullets(text: Column) -> Column:
    """Items of a bulleted or lined text."""
    items = F.split(text, _ITEMS)
    clean = F.transform(items, lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(_EDGES)))
    return F.filter(clean, lambda x: x != "")


def education_and_skills(description: Column) -> Column:
    """Struct of the four sections; skills one a line. Null where a section isn't there."""
    found = {}
    for name, headings in HEADINGS.items():
        text = section(description, headings)
        if name.endswith("skills"):
            text = bound(text, lambda t: bound(bullets(t), lambda items: F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(t)))
        # Most texts hold no heading at all, which is cheap to tell.
        found[name] = F.when(_may_hold(description, headings), F.nullif(text, F.lit("")))
    return F.struct(*[c.alias(n) for n, c in found.items()])
