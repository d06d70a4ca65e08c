"""Operator 4: toxicity by a classifier chain.

Categories are predicted one after another by logistic models on the words of a
document and on how they begin (how often each occurs, and in what part of the
text); each model also gets the probabilities of the categories before it.
It is trained on out-of-fold ones: the labelled rows are dealt into folds, and a
row's earlier probabilities come from models that were fitted without its fold,
so that a later model learns how far earlier ones can be trusted on new text.

A last category can be derived from the rows themselves: of the rows of one
category those in which the words that tell it make up at least the median part
of the text (its severe ones).

The models are fitted on at most `fit_rows` labelled rows, chosen by a hash of
the id; only numbers of their words, no texts, reach the driver. Every document
is then scored, in whole, inside the tasks.

Defined results: null and empty texts have no words and get the probabilities of
such a text; labels that are null, or of unknown documents, are ignored; of
labels that repeat an id the largest counts. Without positive labels of a
category its probability is 0. Rows keep all their columns, which may have any
names; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postworks.llm.scratch import small_batches, written
from postworks.llm.words import ALNUM, mix, split_prefixes, text_chunks

#: Labelled rows that the chain is fitted on, at most; hash buckets of words; words a model uses, at most; folds.
FIT_ROWS, BUCKETS, FEATURES, FOLDS = 20_000, 1 << 18, 120, 5
#: Beginnings of words, in bytes, that count like words.
PREFIXES = (5, 6, 8)
#: The least chi-square with a category that a word needs: with this many words hardly any gets there by chance. Where
#: rows are too few for any word to reach it, a part of what so many rows can show.
TELLING, TELLING_PART, TELLING_LEAST = 40.0, 0.2, 4.0
_U = np.uint64


@dataclass
class Linear:
    """Buckets of words with their weights, weights of earlier categories' log-odds, and the intercept."""

    buckets: np.ndarray
    words: np.ndarray
    earlier: np.ndarray
    intercept: float


@dataclass
class Rows:
    """Distinct word buckets of texts, one text after another, with how often each occurs; and the words of each text."""

    buckets: np.ndarray
    times: np.ndarray
    counts: np.ndarray
    n_words: np.ndarray

    def take(self, at: np.ndarray) -> Rows:
        starts = np.cumsum(self.counts) - self.counts
        n = self.counts[at]
        places = np.repeat(starts[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Rows(self.buckets[places], self.times[places], n, self.n_words[at])

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        """A column for each chosen bucket's occurrences, and one for their part of the text."""
        place = np.full(BUCKETS, -1)
        place[chosen] = np.arange(len(chosen))
        of = np.repeat(np.arange(len(self.counts)), self.counts)
        use = place[self.buckets] >= 0
        out = np.zeros((len(self.counts), 2 * len(chosen)))
        out[of[use], place[self.buckets[use]]] = np.log1p(self.times[use])
        out[of[use], len(chosen) + place[self.buckets[use]]] = np.log1p(100 * self.times[use] / self.n_words[of[use]])
        return out


def _buckets(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray | None = None) -> Rows:
    hashes, counts = split_prefixes(data, ends, ALNUM, (None, *PREFIXES))
    text = np.repeat(np.arange(len(ends)), np.diff(counts))
    pairs = []
    for k, h in enumerate(hashes):
        bucket = (mix(h + _U(k)) % _U(BUCKETS)).astype(np.int64)
        use = slice(None) if wanted is None else wanted[bucket]
        pairs.append(text[use] * BUCKETS + bucket[use])
    pairs, times = np.unique(np.concatenate(pairs), return_counts=True)
    return Rows(pairs % BUCKETS, times, np.bincount(pairs // BUCKETS, minlength=len(ends)), np.diff(counts))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def probability(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    """earlier: log-odds of earlier categories, a column each."""
    z = rows.matrix(model.buckets) @ model.words + earlier @ model.earlier + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling_bound(n: float) -> float:
    """The chi-square that a word needs among n rows."""
    return min(TELLING, max(TELLING_LEAST, TELLING_PART * n))


def _choose(seen: np.ndarray, hit: np.ndarray, positive: float, n: int) -> np.ndarray:
    """The buckets whose words tell most: seen in so many of n texts, and in so many of the positive ones."""
    expected = seen * positive / n
    tells = np.where(seen >= 3, (hit - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9), 0)
    chosen = np.sort(np.argsort(-tells, kind="stable")[:FEATURES])
    return chosen[tells[chosen] > telling_bound(n)]


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 25) -> Linear:
    """Logistic regression with a squared penalty, by Newton's method, on the words that tell most."""
    n, positive = len(y), y.sum()
    if not positive or positive == n:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), -30.0 if not positive else 30.0)
    of = np.repeat(np.arange(n), rows.counts)
    seen, hit = np.bincount(rows.buckets, minlength=BUCKETS), np.bincount(rows.buckets, y[of], minlength=BUCKETS)
    chosen = _choose(seen, hit, positive, n)
    x = np.column_stack((rows.matrix(chosen), earlier, np.ones(n)))
    w = np.zeros(x.shape[1])
    w[-1] = np.log(positive / (n - positive))
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)).sum() + (ridge * v**2).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), g)
        scale = 1.0
        while (new := loss(w - scale * step)) > now and scale > 1e-6:
            scale /= 2
        w = w - scale * step
        if now - new < 1e-7 * max(1.0, now):
            break
        now = new
    k = 2 * len(chosen)
    return Linear(chosen, w[:k], w[k:-1], float(w[-1]))


def fit_chain(rows: Rows, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model for each column of labels, in order."""
    chain, earlier = [], np.zeros((len(labels), 0))
    for c in range(labels.shape[1]):
        out_of_fold = np.zeros(len(labels))
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inside) and len(outside):
                model = fit_linear(rows.take(inside), earlier[inside], labels[inside, c])
                out_of_fold[outside] = probability(model, rows.take(outside), earlier[outside])
        chain.append(fit_linear(rows, earlier, labels[:, c]))
        earlier = np.column_stack((earlier, _log_odds(out_of_fold)))
    return chain


def predict(chain: list[Linear], rows: Rows) -> np.ndarray:
    out = np.zeros((len(rows.counts), 0))
    for model in chain:
        out = np.column_stack((out, probability(model, rows, _log_odds(out))))
    return out


def severe(rows: Rows, model: Linear, y: np.ndarray) -> np.ndarray:
    """Of the rows with y those whose telling words (of positive weight) make up at least the median part of the text."""
    known = np.zeros(BUCKETS, bool)
    half = len(model.buckets)
    known[model.buckets[model.words[:half] + model.words[half:] > 0]] = True
    of = np.repeat(np.arange(len(rows.counts)), rows.counts)
    part = np.bincount(of, rows.times * known[rows.buckets], len(rows.counts)) / np.maximum(rows.n_words, 1)
    own = part[y > 0]
    return ((y > 0) & (part > 0) & (part >= (np.median(own) if len(own) else 0))).astype(float)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", fit_rows: int = FIT_ROWS, severe_of: str | None = None) -> tuple[list[str], list[Linear]]:
    """A chain of the categories, in order: conditions on `text`, on `label` (label_column), and on `label_x` for any column x of the labels.

    severe_of: the category of which the severe rows are another, last one.
    """
    small_batches(docs.sparkSession)
    own = [c for c in labels.columns if c != id_column]
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"), *[F.max(c).alias(f"label_{c}") for c in own])
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    # At most about fit_rows rows of a few numbers.
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    labelled = rows.select("text", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold"), F.array(*[F.coalesce(c, F.lit(False)).cast("double") for c in categories.values()]).alias("y"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, data, ends in text_chunks(whole, "text"):
                r = _buckets(data, ends)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(r.counts))), pa.int32()), pa.array(x, pa.int32())) for x in (r.buckets, r.times)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *lists, pa.array(r.n_words, pa.int64())], ["fold", "y", "buckets", "times", "n_words"])

    sample = written(labelled.mapInArrow(words, "fold int, y array<double>, buckets array<int>, times array<int>, n_words long"), "labelled")
    wanted = _telling(sample, len(categories))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            bucket, times = (b.column(c).flatten().to_numpy() for c in (2, 3))
            use = wanted[bucket]
            ends = np.concatenate(([0], np.cumsum(np.bincount(of[use], minlength=b.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[use])) for x in (bucket, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, b.column(4)], b.schema.names)

    table = sample.mapInArrow(keep, sample.schema).toArrow().combine_chunks()
    buckets, times = (table[c].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32())) for c in ("buckets", "times"))
    rows_ = Rows(*(x.flatten().to_numpy().astype(np.int64) for x in (buckets, times)), buckets.value_lengths().to_numpy().astype(np.int64), table["n_words"].to_numpy())
    y = np.array(table["y"].to_pylist(), float).reshape(-1, len(categories))
    # Sums don't depend on the order of rows beyond rounding; sorting makes the fit repeatable.
    order = np.lexsort((rows_.counts, *y.T, np.bincount(np.repeat(np.arange(len(y)), rows_.counts), rows_.buckets, len(y))))
    rows_, y, fold = rows_.take(order), y[order], table["fold"].to_numpy()[order]
    names = list(categories)
    if severe_of:
        own_y = y[:, names.index(severe_of)]
        y = np.column_stack((y, severe(rows_, fit_linear(rows_, np.zeros((len(y), 0)), own_y), own_y)))
        names.append(f"severe_{severe_of}")
    return names, fit_chain(rows_, y, fold)


def _telling(sample: DataFrame, n_categories: int) -> np.ndarray:
    """Buckets that a model of the chain chooses, of all rows or of those without a fold: no others leave the tasks."""
    of_fold = [(F.col("fold") == f).cast("double") for f in range(FOLDS)]
    # Of each fold: rows, and rows of each category.
    sums = lambda: [F.sum(w if c is None else w * F.col("y")[c]) for w in of_fold for c in (None, *range(n_categories))]
    n_sums = FOLDS * (1 + n_categories)
    names = [f"s{i}" for i in range(n_sums)]
    totals = np.array([x or 0 for x in sample.agg(*sums()).first()], float).reshape(FOLDS, -1)
    out = np.zeros(BUCKETS, bool)
    inside = [[f for f in range(FOLDS) if f != without] for without in (None, *range(FOLDS))]
    models = [(folds, c) for folds in inside for c in range(1, 1 + n_categories) if 0 < totals[folds, c].sum() < totals[folds, 0].sum()]
    if not models:
        return out
    counts = sample.select(F.explode("buckets").alias("bucket"), "fold", "y").groupBy("bucket").agg(*[x.alias(name) for x, name in zip(sums(), names, strict=True)])
    tells = F.lit(False)
    for folds, c in models:
        seen, hit = (sum(F.col(names[f * (1 + n_categories) + k]) for f in folds) for k in (0, c))
        part = float(totals[folds, c].sum() / totals[folds, 0].sum())
        # A little below the bound, as rounding may differ from that of the choice.
        tells = tells | ((seen >= 3) & ((hit - seen * part) ** 2 > 0.99 * telling_bound(float(totals[folds, 0].sum())) * seen * part * (1 - part)))
    # A number for each fold and category of each bucket, at most.
    found = counts.where(tells).toArrow()
    sums_ = np.zeros((BUCKETS, n_sums), np.float32)
    for k, name in enumerate(names):
        sums_[found["bucket"].to_numpy(), k] = found[name].to_numpy()
    sums_ = sums_.reshape(BUCKETS, FOLDS, -1)
    for folds, c in models:
        seen, hit = (sums_[:, folds, k].sum(1, dtype=float) for k in (0, c))
        out[_choose(seen, hit, totals[folds, c].sum(), int(totals[folds, 0].sum()))] = True
    return out


def score(df: DataFrame, model: tuple[list[str], list[Linear]], text_column: str = "text") -> DataFrame:
    """Two columns for each row: `row`, a struct of all its columns, and `toxicity`, the probability of each category."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, chain = sent.value
        wanted = np.zeros(BUCKETS, bool)
        for m in chain:
            wanted[m.buckets] = True
        for whole in batches:
            for b, data, ends in text_chunks(whole, "text"):
                p = predict(chain, _buckets(data, ends, wanted))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays([pa.array(c) for c in p.T], names)], ["row", "toxicity"])

    rows = df.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in model[0]])
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("toxicity", schema)]))
