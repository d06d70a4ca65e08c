"""Operator 9: benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of whole texts and builds the suffix
array of each: all places of the shard, sorted by the words that follow, by
doubling (ranks of 1, 2, 4, ... words) up to a few words more than a window has.
Every suffix of every test item is searched in the array by bisection, which
gives the range of training suffixes that begin with the same window (a suffix
with a word that the shard doesn't have needs no steps); from there matches are
lengthened word by word to the longest verbatim ones.

A window is `window` consecutive words of an item, or all words of an item that
has fewer. A document word inside any occurrence of a window is hit.

The benchmark is sent to the tasks in blocks of bounded size, one block in a
pass over the documents, so that no task and no driver holds more than a block.
With several blocks each pass writes what it has found, by a digest of the
text, and the passes are put together for each document. A document never
leaves its task to be searched, so a passage that many documents share moves no
rows.

Defined results: null and empty texts have no words and no hits; a null item id
or text, or an item without words, gives no windows; items that repeat an id
count once. Rows keep all their columns, which may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postworks.llm.scratch import small_batches, written
from postworks.llm.words import ALNUM, split_words, text_chunks

#: Bytes of test items that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "stop")]))),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_start", "doc_start", "n_words")]]))),
])


class Tests:
    """The windows of a block of test items: words of all items, and where each suffix to search begins."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        data = "".join(texts).encode()
        ends = np.cumsum([len(t.encode()) for t in texts])
        self.ids = np.array(ids, object)
        self.names, self.name = np.unique(self.ids, return_inverse=True)  # rows that repeat an id count once
        self.words, counts = split_words(np.frombuffer(data, np.uint8), ends, ALNUM)
        n = np.diff(counts)
        size = np.minimum(n, window)
        suffixes = np.where(n > 0, n - size + 1, 0)
        self.item = np.repeat(np.arange(len(n)), suffixes)
        self.start = np.arange(len(self.item)) - np.repeat(np.cumsum(suffixes) - suffixes, suffixes)
        self.at = counts[self.item] + self.start
        self.end = counts[self.item + 1] if len(self.item) else np.zeros(0, np.int64)
        self.size = size[self.item]


class Shard:
    """The words of texts and their suffix array: places sorted by the words that follow, at least `depth` of them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, depth: int):
        self.words, self.counts = words, counts
        self.known, codes = np.unique(words, return_inverse=True)
        # Texts are parted by code 0, which no item has, so that no match crosses into another text.
        self.text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
        self.codes = np.zeros(len(words) + len(counts) - 1, np.int64)
        self.codes[np.arange(len(words)) + self.text] = codes + 1
        rank, n = self.codes, 1
        while n < depth and len(rank):
            after = np.zeros_like(rank)
            after[:-n] = rank[n:]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1]
            n *= 2
        self.array = np.argsort(rank, kind="stable")
        self.words_before = np.cumsum(self.codes > 0) - 1  # the number of the word at a place

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """(suffix number, place in words) of each occurrence of a window in the shard."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.words) or not len(tests.at):
            return none
        code = np.minimum(np.searchsorted(self.known, tests.words), len(self.known) - 1)
        code = np.where(self.known[code] == tests.words, code + 1, 0)
        # Suffixes whose window has unknown words are in no training text.
        missing = np.concatenate(([0], np.cumsum(code == 0)))
        suffix = np.flatnonzero(missing[tests.at + tests.size] == missing[tests.at])
        if not len(suffix):
            return none
        size = tests.size[suffix]
        places = tests.at[suffix][:, None] + np.minimum(np.arange(int(size.max())), size[:, None] - 1)
        rows = code[places]
        lo, hi = (self._bisect(rows, size, after) for after in (False, True))
        found = hi - lo
        inner = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
        return np.repeat(suffix, found), self.words_before[self.array[np.repeat(lo, found) + inner]]

    def _bisect(self, rows: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        """For each row the first place of the array whose first `size` words are not less (after: greater) than the row's."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.array))
        step = np.arange(rows.shape[1])
        counted = step < size[:, None]
        each = np.arange(len(rows))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = self.array[np.minimum(mid, len(self.array) - 1)][:, None] + step
            there = np.where(at < len(self.codes), self.codes[np.minimum(at, len(self.codes) - 1)], 0)
            differs = (there != rows) & counted
            first = differs.argmax(1)
            less = np.where(differs[each, first], there[each, first] < rows[each, first], after)
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo


def longest(words: np.ndarray, counts: np.ndarray, tests: Tests, suffix: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences that no equal word precedes, and how far each goes."""
    text = np.searchsorted(counts, place, "right") - 1
    at = tests.at[suffix]
    inside = (place > counts[text]) & (tests.start[suffix] > 0)
    maximal = ~(inside & (words[place - 1] == tests.words[at - 1]))
    suffix, place, text, at = suffix[maximal], place[maximal], text[maximal], at[maximal]
    most = np.minimum(counts[text + 1] - place, tests.end[suffix] - at)
    n = tests.size[suffix].copy()
    going = np.flatnonzero(n < most)
    while len(going):
        same = words[place[going] + n[going]] == tests.words[at[going] + n[going]]
        going = going[same]
        n[going] += 1
        going = going[n[going] < most[going]]
    return suffix, place, n


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _spans(edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hit words (text, start, stop) where windows begin (1) and end (-1)."""
    hit = np.cumsum(edges[:-1]) > 0
    of = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    new, last = hit.copy(), hit.copy()
    new[1:] &= ~(hit[:-1] & (of[1:] == of[:-1]))
    last[:-1] &= ~(hit[1:] & (of[1:] == of[:-1]))
    begin, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    text = of[begin]
    return text, begin - counts[text], stop - counts[text]


def _found(data: np.ndarray, ends: np.ndarray, tests: Tests, depth: int) -> pa.StructArray:
    words, counts = split_words(data, ends, ALNUM)
    n = len(ends)
    suffix, place = Shard(words, counts, depth).search(tests)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + tests.size[suffix], -1)
    pair = np.unique((np.searchsorted(counts, place, "right") - 1) * len(tests.names) + tests.name[tests.item[suffix]])
    item_text, item_id = pair // max(len(tests.names), 1), tests.names[pair % max(len(tests.names), 1)]
    s, p, length = longest(words, counts, tests, suffix, place)
    match_text = np.searchsorted(counts, p, "right") - 1
    order = np.lexsort((p, match_text))
    s, p, length, match_text = s[order], p[order], length[order], match_text[order]
    text, start, stop = _spans(edges, counts)
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"])
    match = pa.StructArray.from_arrays([pa.array(tests.ids[tests.item[s]], pa.string()), pa.array(tests.start[s], pa.int64()), pa.array(p - counts[match_text], pa.int64()), pa.array(length, pa.int64())], ["item_id", "item_start", "doc_start", "n_words"])
    count = lambda x: np.bincount(x, minlength=n)
    hits = np.bincount(text, stop - start, n).astype(np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(counts), pa.int64()), pa.array(hits), _lists(pa.array(item_id, pa.string()), count(item_text)), _lists(spans, count(text)), _lists(match, count(match_text))],
        RESULT.names,
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """Two columns for each document: `row`, a struct of all its columns, and `found`.

    found: n_words; n_hit; items, the ids of those with an occurring window;
    spans, the runs of hit words (start, stop); matches, the longest verbatim
    matches (item_id, item_start, doc_start, n_words).
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def searched(rows: DataFrame, k: int) -> DataFrame:
        """rows (row, text) with what is found of a block."""
        own = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id", "text").toArrow()
        sent = spark.sparkContext.broadcast((own["id"].to_pylist(), own["text"].to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(*sent.value, window)
            for whole in batches:
                for batch, data, ends in text_chunks(whole, "text", SHARD_BYTES):
                    yield pa.RecordBatch.from_arrays([batch.column(0), _found(data, ends, tests, window)], ["row", "found"])

        return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("found", RESULT)]))

    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    if blocks == 1:
        return searched(rows, 0)
    # What a text holds depends on the text alone, so passes are told apart and put together by its digest.
    digest = F.sha2(F.coalesce(text_column, F.lit("")), 256)
    keyed = docs.select(F.struct(digest.alias("digest")).alias("row"), F.col(text_column).alias("text"))
    passes = [written(searched(keyed, k).where("found.n_hit > 0").select("row.digest", "found").dropDuplicates(["digest"]), "hits") for k in range(blocks)]
    union = passes[0]
    for p in passes[1:]:
        union = union.union(p)
    lists = [F.flatten(F.collect_list(f"found.{c}")).alias(c) for c in ("items", "spans", "matches")]
    merged = written(union.groupBy("digest").agg(F.max("found.n_words").alias("n_words"), *lists), "found")
    joined = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"), digest.alias("digest")).join(merged, "digest", "left")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, data, ends in text_chunks(whole, "text", SHARD_BYTES):
                counts = split_words(data, ends, ALNUM)[1]
                edges = np.zeros(counts[-1] + 1, np.int64)
                found = b.column(3)
                of = np.repeat(np.arange(b.num_rows), found.value_lengths().fill_null(0).to_numpy())
                flat = found.flatten()
                np.add.at(edges, counts[of] + flat.field("start").to_numpy(), 1)
                np.add.at(edges, counts[of] + flat.field("stop").to_numpy(), -1)
                text, start, stop = _spans(edges, counts)
                spans = _lists(pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"]), np.bincount(text, minlength=b.num_rows))
                hits = np.bincount(text, stop - start, b.num_rows).astype(np.int64)
                items_, matches = (_filled(b.column(c)) for c in (2, 4))
                out = pa.StructArray.from_arrays([pa.array(np.diff(counts), pa.int64()), pa.array(hits), items_, spans, matches], RESULT.names)
                yield pa.RecordBatch.from_arrays([b.column(0), out], ["row", "found"])

    def _filled(lists: pa.ListArray) -> pa.ListArray:
        return _lists(lists.flatten(), lists.value_lengths().fill_null(0).to_numpy())

    order = F.array_sort("matches", lambda a, b: F.when(a["doc_start"] < b["doc_start"], -1).when(a["doc_start"] > b["doc_start"], 1).otherwise(0))
    ready = joined.select("row", "text", F.array_distinct("items").alias("items"), "spans", order.alias("matches"))
    return ready.mapInArrow(together, T.StructType([ready.schema["row"], T.StructField("found", RESULT)]))


def is_contaminated(found: Column, part: float = 20) -> Column:
    """At least one word in `part` is hit."""
    return (found["n_hit"] > 0) & (found["n_hit"] * part >= found["n_words"])
