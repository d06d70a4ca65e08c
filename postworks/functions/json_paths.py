"""JSON documents as variants: paths, and flattening to a long table."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postworks.functions.text import bound

#: Tokens of JSON text: strings (the last one may be cut off), single brackets, and what is between.
TOKENS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[{}\[\]]|[^"{}\[\]]++'

#: Levels of a document that expressions open.
LEVELS = 6


def balanced(text: Column) -> Column:
    """The object that begins at the first brace of a text, up to its closing brace, strings seen as such; null if none closes."""
    tokens = F.regexp_extract_all(F.regexp_extract(text, r"(?s)(\{.*)", 1), F.lit(TOKENS), F.lit(0))
    zero = F.struct(F.lit(0).alias("level"), F.lit(0).alias("n"), F.lit(False).alias("closed"))

    def step(s: Column, t: Column) -> Column:
        level = s["level"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(s["closed"], s).otherwise(F.struct(level.alias("level"), (s["n"] + 1).alias("n"), (level == 0).alias("closed")))

    def cut(tokens: Column) -> Column:
        return bound(F.aggregate(tokens, zero, step), lambda s: F.when(s["closed"], F.array_join(F.slice(tokens, 1, s["n"]), "")))

    return bound(tokens, cut)


def relaxed(text: Column) -> Column:
    """A variant of JSON text whose strings may hold raw line breaks and tabs; null if it doesn't parse."""
    raw = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    tokens = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    clean = F.transform(tokens, lambda t: F.when(t.startswith('"'), reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), raw.items(), t)).otherwise(t))
    return F.coalesce(F.try_parse_json(text), F.when(text.rlike(r"[\n\r\t]"), F.try_parse_json(F.array_join(clean, ""))))


def dig(doc: Column, *names: str, kind: str = "variant") -> Column:
    """Value at a path of names; null if any is missing."""
    return F.try_variant_get(doc, "$" + "".join(f"['{n}']" for n in names), kind)


def unwrap(doc: Column) -> Column:
    """The job inside a vendor's document: jobDetail.data.job, jobDetail.job, data.job, or the whole."""
    return bound(doc, lambda d: F.coalesce(dig(d, "jobDetail", "data", "job"), dig(d, "jobDetail", "job"), dig(d, "data", "job"), d))


#: Keys under which a search page's document may hold the job, one inside the other in this order.
JOB_KEYS = ["job", "jobDetail", "data", "position", "posting"]


def unwrap_job(doc: Column) -> Column:
    """The innermost of a document's nested jobs: each key is followed, in order, where it holds an object."""

    def follow(name: str) -> Callable[[Column], Column]:
        return lambda d: bound(dig(d, name), lambda below: F.when(_object(below).isNotNull(), below).otherwise(d))

    for name in JOB_KEYS:
        doc = bound(doc, follow(name))
    return doc


def strip_prefix(fields: Column, prefix: str) -> Column:
    """Keys of a map without a prefix."""
    return F.transform_keys(fields, lambda k, v: F.when(k.startswith(prefix), F.substring(k, len(prefix) + 1, 1 << 30)).otherwise(k))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _scalars(a: Column) -> Column:
    return F.forall(a, lambda x: _object(x).isNull() & _array(x).isNull())


def _node(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), value.alias("value"))


def _children(node: Column, indexed: bool) -> Column:
    """The nodes below one; a leaf is its own child. indexed: a[0].b instead of a.0.b, and lists of scalars are opened too."""
    path, value = node["path"], node["value"]
    prefix = lambda sep: F.when(path == "", "").otherwise(F.concat(path, F.lit(sep)))
    place = (lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))) if indexed else (lambda i: F.concat(prefix("."), i.cast("string")))

    def below(v: Column) -> Column:
        fields = F.transform(F.map_entries(v["object"]), lambda e: _node(F.concat(prefix("."), e["key"]), e["value"]))
        items = F.transform(v["items"], lambda x, i: _node(place(i), x))
        opened = v["items"].isNotNull() if indexed else v["items"].isNotNull() & ~_scalars(v["items"])
        return F.when(v["object"].isNotNull(), fields).when(opened, items).otherwise(F.array(node))

    return bound(F.struct(_object(value).alias("object"), _array(value).alias("items")), below)


def _leaf(value: Column, indexed: bool) -> Column:
    if indexed:
        return _text(value)
    joined = F.array_join(F.transform(_array(value), lambda x: F.coalesce(_text(x), F.lit(""))), "; ")
    return F.coalesce(F.when(_array(value).isNotNull(), joined), _text(value), F.lit(""))


def _opened_still(value: Column, indexed: bool) -> Column:
    """Whether a node has nodes below it; an empty object counts, as it has no leaf."""
    items = _array(value)
    return _object(value).isNotNull() | (items.isNotNull() if indexed else items.isNotNull() & ~_scalars(items))


def _opened(nodes: Column, indexed: bool, levels: int) -> Column:
    """The nodes so many levels below; where nothing is left to open, no further level is worked on."""
    if not levels:
        return nodes
    below = lambda ns: F.flatten(F.transform(ns, lambda n: _children(n, indexed)))
    return bound(nodes, lambda ns: F.when(F.exists(ns, lambda n: _opened_still(n["value"], indexed)), _opened(below(ns), indexed, levels - 1)).otherwise(ns))


def _unrolled(doc: Column, indexed: bool) -> Column:
    """(entries, rest) of a document: its leaves if LEVELS levels reach them all, else its text."""

    def split(nodes: Column, d: Column) -> Column:
        deep = F.exists(nodes, lambda n: _opened_still(n["value"], indexed))
        leaves = F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), _leaf(n["value"], indexed).alias("value")))
        return F.struct(F.when(~deep, leaves).alias("entries"), F.when(deep, F.to_json(d)).alias("rest"))

    nodes = lambda d: _opened(F.array(_node(F.lit(""), d)), indexed, LEVELS)
    return bound(doc, lambda d: F.when(d.isNotNull(), bound(nodes(d), lambda ns: split(ns, d))))


def _walk(document: str, indexed: bool) -> list[dict]:
    """The leaves of JSON text, in order, by a list of nodes that are still to be opened."""
    out, todo = [], [("", json.loads(document, parse_int=str, parse_float=str))]
    text = lambda x: x if x is None or isinstance(x, str) else str(x).lower()
    while todo:
        path, value = todo.pop()
        dot = f"{path}." if path else ""
        if isinstance(value, dict):
            todo.extend((dot + k, v) for k, v in reversed(value.items()))
        elif isinstance(value, list) and (indexed or any(isinstance(x, (dict, list)) for x in value)):
            todo.extend((f"{path}[{i}]" if indexed else f"{dot}{i}", value[i]) for i in reversed(range(len(value))))
        elif isinstance(value, list):
            out.append({"path": path, "value": "; ".join(text(x) or "" for x in value)})
        else:
            out.append({"path": path, "value": text(value) if indexed else text(value) or ""})
    return out


def _walked(rest: Column, indexed: bool) -> Column:
    """Leaves of the documents that expressions don't reach the ground of; null for null."""

    @F.pandas_udf("string")
    def walk(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else json.dumps(_walk(d, indexed)))

    return F.from_json(walk(rest), "array<struct<path:string,value:string>>")


def with_entries(df: DataFrame, documents: dict[str, Column], *others: str | Column, indexed: bool = False) -> DataFrame:
    """Other columns, and for each name the leaves of a document, however deep, as an array of (path, value); null for null.

    One pass with a plan of fixed size: expressions open LEVELS levels, as nearly
    all documents need; a document that is deeper than that is walked node by node in
    a Python worker, which only gets the texts of those.
    """
    opened = df.select(*others, *[_unrolled(doc, indexed).alias(name) for name, doc in documents.items()])
    kept = opened.columns[: len(opened.columns) - len(documents)]
    at = lambda name: F.col(f"`{name}`")
    return opened.select(*[at(c) for c in kept], *[F.coalesce(at(n)["entries"], _walked(at(n)["rest"], indexed)).alias(n) for n in documents])


def with_fields(df: DataFrame, documents: dict[str, Column], *others: str | Column, indexed: bool = False) -> DataFrame:
    """As with_entries, with the leaves as a map; the last of equal paths counts."""
    found = with_entries(df, documents, *others, indexed=indexed)
    return found.select(*[entries_map(F.col(f"`{c}`")).alias(c) if c in documents else F.col(f"`{c}`") for c in found.columns])


def flatten(df: DataFrame, doc: Column, *ids: str, indexed: bool = False) -> DataFrame:
    """(ids, path, value) of every leaf of a document, however deep.

    Dotted form: lists of scalars are one leaf, joined by "; "; null and the
    empty list are "". Indexed form: each element is a leaf, null stays null,
    empty lists vanish. Empty objects have no leaf in either.
    """
    name = "leaf"
    while name in ids:
        name += "_"
    entries = with_entries(df, {name: doc}, *ids, indexed=indexed)
    # An inner explode would filter by the arrays' sizes before Python has made them.
    return entries.select(*ids, F.explode_outer(name).alias(name)).where(F.col(name).isNotNull()).select(*ids, F.col(name)["path"].alias("path"), F.col(name)["value"].alias("value"))


def flat_entries(doc: Column, depth: int, indexed: bool = False) -> Column:
    """The leaves of one document, of at most so many levels, as an array of (path, value); null for null."""

    def leaves(d: Column) -> Column:
        nodes = _opened(F.array(_node(F.lit(""), d)), indexed, depth)
        return F.when(d.isNotNull(), F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), _leaf(n["value"], indexed).alias("value"))))

    return bound(doc, leaves)


def entries_map(entries: Column) -> Column:
    """A map of (path, value) entries; the last of equal paths counts."""
    placed = F.transform(entries, lambda e, i: F.struct(e["path"].alias("path"), i.alias("i"), e["value"].alias("value")))

    def last(s: Column) -> Column:
        kept = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.try_element_at(s, i + 2)["path"] != x["path"]))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["path"], x["value"])))

    return bound(F.array_sort(placed), lambda s: F.when(s.isNotNull(), last(s)))


def flat_fields(doc: Column, depth: int, indexed: bool = False) -> Column:
    """Map of the paths and values of one document, of at most so many levels."""
    return entries_map(flat_entries(doc, depth, indexed))


def as_map(long: DataFrame, *ids: str) -> DataFrame:
    """One map of paths to values for each id; of equal paths the largest value counts."""
    once = long.groupBy(*ids, "path").agg(F.max("value").alias("value"))
    return once.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("fields"))
