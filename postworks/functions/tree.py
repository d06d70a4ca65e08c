"""Markup that expressions can't follow: a small reader of element trees, for the pages that need one.

A page goes to Python only if an expression finds that its tags don't pair up,
that list items stand inside one another, or that it has rare entities; all other
pages are read by expressions alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
#: What a start tag ends if it is still open, and the elements beyond which it doesn't.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BLOCKS = {"p", "div", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "form", "hr", "pre", "blockquote"}
_ENDS |= {name: ({"p"}, {"td", "th", "li", "div", "button"}) for name in _BLOCKS}


#: What may be an entity. A name that no semicolon ends, or that none has, is text; Python's parser would take its beginning for an entity.
_NAME = re.compile(r"&(?=([A-Za-z][A-Za-z0-9]*)(;?))")


class Node:
    """An element: its name, its classes, and what it holds, elements and texts."""

    __slots__ = ("name", "classes", "held")

    def __init__(self, name: str, classes: str = ""):
        self.name, self.classes, self.held = name, classes.split(), []

    def walk(self) -> Iterator[Node | str]:
        """Everything below, in order."""
        todo = list(reversed(self.held))
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(reversed(x.held))

    def text(self) -> str:
        """Its texts, stripped, with single spaces between and in them."""
        return " ".join(" ".join(x for x in self.walk() if isinstance(x, str)).split())


class _Reader(HTMLParser):
    """Builds the tree: end tags that are left out are implied, and those of nothing open are passed over."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]
        self.feed(_NAME.sub(lambda m: "&" if m[2] and m[1] + ";" in html5 else "&amp;", html))
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended, beyond = _ENDS.get(tag, ((), ()))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in beyond:
                break
            if self.open[i].name in ended:
                del self.open[i:]
                break
        node = Node(tag, next((v or "" for k, v in attrs if k == "class"), ""))
        self.open[-1].held.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].held.append(Node("br"))
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        held = self.open[-1].held
        if self.open[-1].name in ("script", "style"):
            return
        if held and isinstance(held[-1], str):  # the parser stops at brackets that are no tags
            data = held.pop() + data
        held.append(data)

    def handle_comment(self, data: str) -> None:
        self.open[-1].held.append(Node("#"))


def read(html: str) -> Node:
    return _Reader(html).open[0]


def _lines(html: str) -> str:
    """A description's text: each text of the tree a line, but a list item is one line whatever it holds."""
    out, todo = [], list(reversed(read(html).held))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x.strip())
        elif x.name == "li":
            out.append(" ".join(y.strip() for y in x.walk() if isinstance(y, str) and y.strip()))
        else:
            todo.extend(reversed(x.held))
    text = re.sub(r"[ \t]+", " ", "\n".join(x for x in out if x))
    return re.sub(r"\n{3,}", "\n\n", text).replace("\xa0", " ").strip()


def _labels(html: str) -> dict[str, str]:
    """Bold labels and what follows them beside them, as `markup.bold_blocks` has them."""
    root = read(html)
    nodes = [x for x in root.walk() if isinstance(x, Node)]
    inside = next((x for x in nodes if "career-detail-description" in x.classes), root)
    found: dict[str, str] = {}
    for parent in [inside, *[x for x in inside.walk() if isinstance(x, Node)]]:
        label, texts, items = None, [], None

        def put() -> None:
            if label:
                value = "\n".join(items) if items is not None else " ".join(t for t in texts if t)
                if label not in found or len(value) > len(found[label]):
                    found[label] = value

        for x in parent.held:
            if isinstance(x, Node) and x.name == "b":
                put()
                label, texts, items = x.text().rstrip(":").strip(), [], None
            elif isinstance(x, Node) and x.name == "ul":
                items = (items or []) + [y.text() for y in x.walk() if isinstance(y, Node) and y.name == "li"]
            else:
                texts.append(x.text() if isinstance(x, Node) else " ".join(x.split()))
        put()
    title = next((x.text() for x in nodes if x.name == "h1"), "")
    return ({"Page Title": title} if title else {}) | found


def _in_python(html: Column, make: Callable[[str], str]) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else make(p))

    return run(html)


def description_lines(html: Column) -> Column:
    """The text of markup by its tree; null for null."""
    return _in_python(html, _lines)


def label_map(html: Column) -> Column:
    """The map of bold labels by a page's tree; null for null."""
    return F.from_json(_in_python(html, lambda p: json.dumps(_labels(p))), "map<string,string>")


#: Elements whose end tags are often left out or misplaced.
_PAIRED = ("b", "p", "li", "ul", "ol", "div", "span", "td", "tr")


def pairs_up(html: Column) -> Column:
    """Whether as many of the usual elements end as begin."""
    names = "|".join(_PAIRED)
    tags = lambda mark: F.sort_array(F.split(F.lower(F.array_join(F.regexp_extract_all(html, F.lit(rf"(?i){mark}({names})\b"), F.lit(1)), " ")), " "))
    return tags("<") == tags("</")
