"""Operator 13: importance resampling towards a target distribution.

Texts are bags of hashed word runs. Two counts, of the corpus and of the target
set, give each bucket a gain (how much likelier the target is to hold it); the
gains are one array of fixed size, from which tasks score whole batches of
texts. A document's score is its mean gain plus Gumbel noise from its id, so the
highest scores are a weighted sample without replacement.

The cutoff is found without a sort of all rows. Blocks of keys each give their
median; of these the median weighted by the blocks' sizes is the pivot, which at
least a quarter of the keys left stand on either side of. Counting the keys on
both sides tells which side holds the cutoff, the other one is discarded, and
the same job that counts has the medians of both sides ready for the next round.
Keys that are left are written anew whenever most of the written ones are gone,
so all rounds together read a few times the first one's keys. Only winners are
sorted.

Defined results: a null or wordless text has no features and weight 0. A row
with a null id has no score: it is neither counted nor drawn. Rows that repeat an
id are rows of their own; where equal scores of one id straddle the cutoff, rows
with fewer features come first, and equal ones are exchangeable. With no target
or no corpus the counts are 0, which the formula allows. Other columns are not
read. Words of any length count whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.llm.scratch import keep, passing_tables, small_batches, written
from postworks.llm.words import ALNUM, text_chunks

#: Buckets of features; longest run of words that is a feature; words that a document to be drawn has at least.
BUCKETS, RUN, LEAST_WORDS = 10_000, 2, 20
#: Words up to this length are hashed column by column, longer ones one by one.
SHORT = 48
#: Keys whose median a task takes at once; keys are written anew when fewer than one in so many is left; so few keys are put in order as they are.
BLOCK, SHRINK, LAST = 1 << 18, 8, 500

_POLYNOMIAL = 0xEDB88320


def _crc_steps() -> np.ndarray:
    """What one byte does to a CRC-32, for each value of the last byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out


_STEP = _crc_steps()


def _push(crc: np.ndarray, byte) -> np.ndarray:
    """CRC-32 values of texts with one more byte each."""
    x = ~crc
    return ~(_STEP[(x ^ byte) & 0xFF] ^ (x >> np.uint32(8)))


def _shifts(most: int) -> np.ndarray:
    """For each length up to `most`: what so many zero bytes do to each byte of a CRC-32 register."""
    register = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    out = [register]
    for _ in range(most):
        register = _STEP[register & 0xFF] ^ (register >> np.uint32(8))
        out.append(register)
    return np.stack(out)


_SHIFT = _shifts(SHORT)


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where words begin, their lengths, and the words of each text as cumulative counts."""
    c = ALNUM[data].astype(np.uint16)
    inside = c > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    stop = ~inside
    stop[begins] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    lengths = stops[np.searchsorted(stops, starts, "right")] - starts
    return (c - inside).astype(np.uint8), starts, lengths, np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)


def _word_crcs(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, as zlib's."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    long = int((lengths > SHORT).sum())
    for i in order[:long]:
        out[i] = zlib.crc32(low[starts[i] : starts[i] + lengths[i]])
    at, size = starts[order[long:]], lengths[order[long:]]
    crc = np.zeros(len(at), np.uint32)
    # Words are in descending order of length: those with a byte at place k are the first ones.
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for k, n in enumerate(alive):
        crc[:n] = _push(crc[:n], low[at[:n] + k])
    out[order[long:]] = crc
    return out


def _followed(before: np.ndarray, crc: np.ndarray, lengths: np.ndarray, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of texts (given by theirs) followed by words."""
    size = np.minimum(lengths, SHORT)
    out = crc.copy()
    for k in range(4):
        out ^= _SHIFT[size, k, (before >> np.uint32(8 * k)) & 0xFF]
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(low[starts[i] : starts[i] + lengths[i]], int(before[i]))
    return out


def features(data: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature of the texts, the number of the text it stands in, and the words of each text."""
    low, starts, lengths, counts = _words(data, ends)
    words = np.diff(counts)
    of = np.repeat(np.arange(len(words)), words)
    crc = _word_crcs(low, starts, lengths)
    found, texts, current = [crc], [of], crc
    for n in range(1, run):
        # Runs of n words at i go on with word i + n, if that is in the same text.
        current = _followed(_push(current[:-1], 0x20), crc[n:], lengths[n:], low, starts[n:]) if len(current) else current
        same = of[: len(current)] == of[n : n + len(current)]
        found.append(current[same])
        texts.append(of[: len(current)][same])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(texts), words


def feature_counts(rows: DataFrame, text_column: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks send one array of sums each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for _, data, ends in text_chunks(whole, "text"):
                total += np.bincount(features(data, ends, buckets, run)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = rows.select(F.col(text_column).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket a thousand times the logarithm of how much likelier it is in the target, rounded down."""
    all_s, all_t, buckets = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in zip(corpus.astype(float), target.astype(float), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """(id, n_words, n_features, weight, score) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, ends in text_chunks(whole, "text"):
                bucket, of, words = features(data, ends, len(sent.value), run)
                n = np.bincount(of, minlength=len(ends))
                total = np.zeros(len(ends), np.int64)
                np.add.at(total, of, sent.value[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    weighed = rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def _middle(score: np.ndarray, id_: np.ndarray) -> tuple[int, int]:
    """The median of keys, which are ordered by score, the highest first, and then by id."""
    m = len(score) // 2
    s = -np.partition(-score, m)[m]
    ties = id_[score == s]
    k = m - int((score > s).sum())
    return int(s), int(np.partition(ties, k)[k])


_SIDES = ("above", "below")
_MEDIANS = "side string, n long, score long, id long"


def _round(keys: DataFrame, pivot: tuple[int, int] | None, bounds: tuple) -> pa.Table:
    """One round's job: for each block of keys within the bounds, size and median of what is above the pivot and below it.

    A row for each side of each block, some numbers only; without a pivot all keys are below.
    """
    hi, lo = bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def medians() -> pa.RecordBatch:
            s, i = (np.concatenate(c) for c in zip(*held, strict=True))
            above = np.zeros(len(s), bool) if pivot is None else (s > pivot[0]) | (s == pivot[0]) & (i < pivot[1])
            equal = np.zeros(len(s), bool) if pivot is None else (s == pivot[0]) & (i == pivot[1])
            out = [("equal", int(equal.sum()), 0, 0)]
            for side, which in zip(_SIDES, (above, ~above & ~equal), strict=True):
                if which.any():
                    out.append((side, int(which.sum()), *_middle(s[which], i[which])))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["side", "n", "score", "id"])

        for b in batches:
            s, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            within = np.ones(len(s), bool)
            if hi is not None:  # strictly after the upper bound
                within &= (s < hi[0]) | (s == hi[0]) & (i > hi[1])
            if lo is not None:
                within &= (s > lo[0]) | (s == lo[0]) & (i < lo[1])
            held.append((s[within], i[within]))
            n += int(within.sum())
            if n >= BLOCK:
                yield medians()
                held, n = [], 0
        if held:
            yield medians()

    # The bounds on scores reach the Parquet scan too.
    near = keys
    if hi is not None:
        near = near.where(F.col("score") <= hi[0])
    if lo is not None:
        near = near.where(F.col("score") >= lo[0])
    return near.select("score", "id").mapInArrow(run, _MEDIANS).toArrow()


def _weighted_median(found: pa.Table, side: str) -> tuple[tuple[int, int] | None, int]:
    """Of the blocks' medians on a side the one that half of the keys' weight comes up to, and the number of keys."""
    rows = sorted(((-s, i, n) for sd, n, s, i in zip(*(found[c].to_pylist() for c in ("side", "n", "score", "id")), strict=True) if sd == side))
    total, passed = sum(n for _, _, n in rows), 0
    for s, i, n in rows:
        passed += n
        if 2 * passed >= total:
            return (-s, i), total
    return None, 0


def cutoff(keys: DataFrame, k: int) -> tuple[tuple[int, int] | None, int]:
    """The k-th key (score descending, id ascending) of a written table, and how many keys come before it."""
    if k <= 0:
        return None, 0
    bounds: tuple = (None, None)
    pivot, left = _weighted_median(_round(keys, None, bounds), "below")
    stored, before = left, 0
    while left > LAST:
        found = _round(keys, pivot, bounds)
        (up, n_above), (down, n_below) = (_weighted_median(found, side) for side in _SIDES)
        n_equal = sum(n for side, n in zip(found["side"].to_pylist(), found["n"].to_pylist(), strict=True) if side == "equal")
        if before + n_above < k <= before + n_above + n_equal:
            return pivot, before + n_above
        if k <= before + n_above:
            bounds, pivot, left = (bounds[0], pivot), up, n_above
        else:
            before += n_above + n_equal
            bounds, pivot, left = (pivot, bounds[1]), down, n_below
        if left * SHRINK < stored and stored > BLOCK:
            keys, stored = written(keys.where(_within(bounds)), "keys"), left
    rest = sorted((-s, i) for s, i in keys.where(_within(bounds)).select("score", "id").limit(LAST).collect())
    if k - before > len(rest):
        return None, before
    score, id_ = rest[k - before - 1]
    return (-score, id_), before + rest.index((score, id_))


def _before(key: tuple[int, int]) -> Column:
    return (F.col("score") > key[0]) | ((F.col("score") == key[0]) & (F.col("id") < key[1]))


def _within(bounds: tuple) -> Column:
    out = F.lit(True)
    if bounds[0] is not None:
        hi = bounds[0]
        out &= (F.col("score") < hi[0]) | ((F.col("score") == hi[0]) & (F.col("id") > hi[1]))
    return out & _before(bounds[1]) if bounds[1] is not None else out


def _ranked(winners: DataFrame) -> DataFrame:
    """Winners with their place in the order of keys, from 1: a sort over ranges, and a count for each range."""
    place = F.monotonically_increasing_id()
    ordered = keep(written(winners.orderBy(F.desc("score"), "id", "n_features").withColumn("place", place), "winners"))
    part = F.shiftright("place", 33)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, at = [], 1
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = winners.sparkSession.createDataFrame(starts, "part long, start long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")  # a row for each range of the sort
    return ranked.withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "start")


def resample(docs: DataFrame, target: DataFrame, share: Fraction, seed: int, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of each document; rank is null for those that aren't drawn.

    Of the documents with enough words the given share is drawn, rounded down.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    gain = gains(feature_counts(docs, text_column), feature_counts(target, text_column))
    columns = ("id", "n_features", "weight", "score")
    with passing_tables(spark):
        rows = keep(written(scored(docs, gain, seed, id_column, text_column), "scored"))
        fit = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
        with passing_tables(spark):
            keys = written(rows.where(fit).select("score", "id"), "keys")
            k = keys.count() * share.numerator // share.denominator
            last, before = cutoff(keys, k)
        if last is None:
            drawn, won = F.lit(False), rows.limit(0)
        else:
            at = (F.col("score") == last[0]) & (F.col("id") == last[1])
            drawn = F.coalesce(fit & (_before(last) | at), F.lit(False))
            won = rows.where(drawn)
        ranked = _ranked(won)
        # Only where rows repeat the last key, some of them may be beyond the cutoff.
        over = F.when(F.col("rank") <= k, F.col("rank")).alias("rank")
    return ranked.select(*columns, over).union(rows.where(~drawn).select(*columns, F.lit(None).cast("long"))).withColumnRenamed("id", id_column)
