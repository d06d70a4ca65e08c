"""Operator 8: languages of a document by multilingual mixture inference.

A language is a distribution of letter trigrams, counted from labelled texts. A
document is a mixture of languages: expectation-maximisation estimates the
share of each from the likelihoods of the document's trigrams. It first runs a
few rounds over all languages, one after another, so that no task holds more
than a few numbers for each trigram however many languages there are; then, to
convergence, over those that still have a share worth telling. The set of the
document's languages is grown, largest share first, as long as the
log-likelihood gains more than the penalty for another language. The result is
that set with its shares; the prediction is the language with the largest one,
and the score is that share.

Trigrams are centred at letters, lower-cased; what isn't a letter is a blank.
They are hashed to a fixed number of buckets. Counting trigrams, and all of the
inference, is numpy over whole Arrow batches inside the tasks; what the driver
gets is one count for each language and bucket.

Defined results: null texts and texts without a letter are `und`, with score 0;
so are all texts if there is nothing to learn from. Of equal shares the
language that sorts first wins. Rows keep all their columns, which may have any
names; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postworks.llm.scratch import small_batches
from postworks.llm.words import text_chunks

UNKNOWN = "und"
BITS = 14
BUCKETS = 1 << BITS
#: Labelled rows that the trigram model is fitted on, at most (chosen by a hash of the text).
FIT_ROWS = 60_000
#: Languages whose counts a task holds before it hands them on.
HELD_LANGUAGES = 100
#: Log-likelihood that another language must add, for each half of a doubling of the text's trigrams.
PENALTY = 6.0
#: Rounds over all languages; the share that a language then needs to go on; the change of a share that ends EM, and the most rounds.
FIRST_ROUNDS, LEAST_SHARE, CONVERGED, ROUNDS = 4, 0.003, 1e-4, 200
_CHUNK_BYTES = 2 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for other characters."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each letter, and the text that it stands in."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    char_ends = whole[ends]
    c = _letters()[codes].astype(np.uint64)
    of = np.repeat(np.arange(len(ends)), np.diff(char_ends, prepend=0))
    before, after = np.zeros_like(c), np.zeros_like(c)
    same = of[1:] == of[:-1]
    before[1:][same] = c[:-1][same]
    after[:-1][same] = c[1:][same]
    h = ((before * np.uint64(0x1F123BB5) + c) * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(0xD6E8FEB86659FD93)
    at = c > 0
    return (h[at] >> np.uint64(64 - BITS)).astype(np.int64), of[at]


def fit(labelled: DataFrame, text: Column, language: Column) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the logarithm of each one's distribution over the buckets."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(text.alias("text"), language.alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    n = rows.count()
    if n > FIT_ROWS:
        share = FIT_ROWS / n
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch, data, ends in text_chunks(whole, "text", _CHUNK_BYTES):
                buckets, of = trigrams(data, ends)
                names = np.array(batch.column(1).to_pylist(), object)
                for name in set(names):
                    mine = (names == name)[of]
                    seen[name] = seen.get(name, 0) + np.bincount(buckets[mine], minlength=BUCKETS)
                if len(seen) > HELD_LANGUAGES:
                    yield from told(seen)
                    seen.clear()
        yield from told(seen)

    def told(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    table = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    code = table["lang"].combine_chunks().dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()
    found = code.dictionary.to_pylist()
    names = sorted(found)
    counts = np.full((len(names), BUCKETS), 0.05)
    place = np.array([names.index(x) for x in found], np.int64)
    counts[place[code.indices.to_numpy()], table["bucket"].to_numpy()] += table["n"].to_numpy()
    return names, np.log(counts / counts.sum(1, keepdims=True))


class _Trigrams:
    """Distinct trigrams of texts, one text after another: bucket and how often it occurs; and where each text's begin."""

    def __init__(self, buckets: np.ndarray, times: np.ndarray, counts: np.ndarray):
        self.buckets, self.times, self.counts = buckets, times, counts
        self.starts = np.cumsum(counts) - counts

    def take(self, at: np.ndarray) -> _Trigrams:
        n = self.counts[at]
        rows = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return _Trigrams(self.buckets[rows], self.times[rows], n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)


def _mixture(t: _Trigrams, langs: np.ndarray, shares: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares at which EM converges, and the log-likelihoods there. langs, shares: k for each text (-1: none, with share 0)."""
    shares = shares / shares.sum(1, keepdims=True)
    likely = np.zeros(len(langs))
    left, own, own_langs, own_shares = np.arange(len(langs)), t, langs, shares
    likelihood = None
    for n in range(ROUNDS + 1):
        if likelihood is None:  # anew, as fewer texts go on
            likelihood = [p[np.repeat(np.maximum(own_langs[:, j], 0), own.counts), own.buckets] for j in range(langs.shape[1])]
        parts = [np.repeat(own_shares[:, j], own.counts) * x for j, x in enumerate(likelihood)]
        mixed = np.maximum(functools.reduce(np.add, parts), 1e-300)
        weight = own.times / mixed
        total = own.sums(own.times)
        new = np.stack([own.sums(weight * x) for x in parts], 1) / total[:, None]
        done = (np.abs(new - own_shares).max(1) < CONVERGED) | (n == ROUNDS)
        if done.any():
            shares[left[done]] = own_shares[done]
            likely[left[done]] = own.sums(own.times * np.log(mixed))[done]
            keep = np.flatnonzero(~done)
            if not len(keep):
                break
            left, own, own_langs, new = left[keep], own.take(keep), own_langs[keep], new[keep]
            likelihood = None
        own_shares = new
    return shares, likely


def _first_shares(t: _Trigrams, p: np.ndarray) -> np.ndarray:
    """Shares (texts by languages) after a few rounds from equal ones: a pass over the languages sums them up, another one updates each."""
    shares = np.full((len(t.counts), len(p)), 1 / len(p))
    total = t.sums(t.times)[:, None]
    for _ in range(FIRST_ROUNDS):
        mixed = np.zeros(len(t.buckets))
        for j, own in enumerate(p):
            mixed += np.repeat(shares[:, j], t.counts) * own[t.buckets]
        weight = t.times / np.maximum(mixed, 1e-300)
        for j, own in enumerate(p):
            shares[:, j] *= t.sums(weight * own[t.buckets])
        shares /= total
    return shares


def infer(data: np.ndarray, ends: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the chosen languages, largest share first (-1: none), their shares, and the log-likelihood of a trigram, on average."""
    n, languages = len(ends), len(log_p)
    nothing = np.full((n, 1), -1), np.zeros((n, 1)), np.zeros(n)
    buckets, of = trigrams(data, ends)
    if not len(of) or not languages:
        return nothing
    keys, times = np.unique(of << BITS | buckets, return_counts=True)
    texts, counts = np.unique(keys >> BITS, return_counts=True)
    t = _Trigrams(keys & (BUCKETS - 1), times.astype(np.float64), counts)
    p = np.exp(log_p)
    letters = t.sums(t.times)
    # The best single language to start with; sums are taken language by language.
    single = np.stack([t.sums(t.times * own[t.buckets]) for own in log_p], 1)
    langs, shares, likely = single.argmax(1)[:, None], np.ones((len(texts), 1)), single.max(1)
    if languages > 1:
        first = _first_shares(t, p)
        worth = max(2, int((first >= LEAST_SHARE).sum(1).max()))
        order = np.argsort(-first, 1, kind="stable")[:, :worth]
        start = np.take_along_axis(first, order, 1)
        order = np.where((start >= LEAST_SHARE) | (np.arange(worth) < 2), order, -1)
        found, _ = _mixture(t, order, np.where(order >= 0, start, 0), p)
        rank = np.argsort(-np.where(order >= 0, found, -1), 1, kind="stable")
        order, found = np.take_along_axis(order, rank, 1), np.take_along_axis(found, rank, 1)
        penalty = PENALTY * np.log2(letters + 1)
        left = np.arange(len(texts))
        for k in range(2, worth + 1):
            # Only texts that the set before last was not enough for go on, while they have another language.
            left = left[order[left, k - 1] >= 0]
            if not len(left):
                break
            picks = order[left, :k]
            mixed, gained = _mixture(t.take(left), picks, np.maximum(found[left, :k], 1e-6), p)
            better = gained - likely[left] > penalty[left]
            done = left[better]
            if not len(done):
                break
            if langs.shape[1] < k:
                langs = np.pad(langs, ((0, 0), (0, k - langs.shape[1])), constant_values=-1)
                shares = np.pad(shares, ((0, 0), (0, k - shares.shape[1])))
            langs[done, :k], shares[done, :k], likely[done] = picks[better], mixed[better], gained[better]
            left = done
        # Largest share first; of equal ones the language that sorts first.
        rank = np.lexsort((langs, -np.where(langs >= 0, shares, -1)))
        langs, shares = np.take_along_axis(langs, rank, 1), np.take_along_axis(shares, rank, 1)
    width = langs.shape[1]
    out_langs, out_shares, average = np.full((n, width), -1), np.zeros((n, width)), np.zeros(n)
    out_langs[texts], out_shares[texts], average[texts] = langs, shares, likely / letters
    return out_langs, out_shares, average


FOUND = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))),
    T.StructField("fit", T.DoubleType()),
])
#: The log-likelihood of a trigram if all buckets were alike: a `fit` of less means that no language explains the text.
CHANCE = -BITS * float(np.log(2))


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_column: str = "text") -> DataFrame:
    """Two columns for each row: `row`, a struct of all its columns, and `found`.

    found: lang_pred; score; languages, the chosen set with its shares, largest
    first; fit, the average log-likelihood of the text's trigrams (0: it has none).
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = sent.value
        words = np.array([*names, UNKNOWN], object)
        for whole in batches:
            for batch, data, ends in text_chunks(whole, "text", _CHUNK_BYTES):
                langs, shares, average = infer(data, ends, log_p)
                known = langs >= 0
                offsets = pa.array(np.concatenate(([0], np.cumsum(known.sum(1)))), pa.int32())
                sets = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(words[langs[known]], pa.string()), pa.array(shares[known])], ["lang", "share"]))
                found = pa.StructArray.from_arrays([pa.array(words[langs[:, 0]], pa.string()), pa.array(np.minimum(shares[:, 0], 1.0)), sets, pa.array(average)], FOUND.names)
                yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "found"])

    rows = df.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("found", FOUND)]))


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 2 mod 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
