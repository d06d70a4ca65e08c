"""Operator 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from postworks.llm import target_resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(g.encode()) % 10_000 for g in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target, share, seed=7):
    s, t = [0] * 10_000, [0] * 10_000
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for b in buckets_of(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        b = buckets_of(text)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r, (_, text) in zip(out, docs, strict=True) if len(words_of(text)) >= 20), key=lambda r: (-r[3], r[0], r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: int(len(fit) * share)])}
    return sorted(((*r, drawn.get(id(r))) for r in out), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgÉé9", k=rng.randint(1, 7))) for _ in range(120)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 21, 60]))) for _ in range(n)]
    texts[3] = texts[4] = texts[5] = " ".join(words[:30])
    return list(enumerate(texts)), [" ".join(rng.choices(words[:40], k=30)) for _ in range(12)]


@pytest.mark.parametrize(("block", "shrink", "share"), [(1 << 18, 8, Fraction(1, 4)), (16, 2, Fraction(1, 4)), (3, 2, Fraction(1, 100)), (16, 2, Fraction(0)), (16, 2, Fraction(1))])
def test_against_brute_force(spark, monkeypatch, block, shrink, share):
    monkeypatch.setattr(target_resampling, "BLOCK", block)
    monkeypatch.setattr(target_resampling, "SHRINK", shrink)
    monkeypatch.setattr(target_resampling, "LAST", block % 8)
    docs, target = corpus(block)
    docs += [(1000, None), (1001, ""), (1002, "x" * 100_000), (1003, "É" * 60 + " " + "w" * 49 + " b " + "ab " * 40_000), (-5, "Mixed CASE, punctuated; " * 9)]
    rows = spark.createDataFrame([(*r, 1.5) for r in docs], "doc_id long, text string, score double").repartition(7)
    found = target_resampling.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), share, 7)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, target, share)


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(20))
    # Rows that repeat an id share a score if they share a text; of four, two are drawn, whichever they are.
    rows = spark.createDataFrame([(1, text)] * 4 + [(None, text)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "text string")
    found = [tuple(r) for r in target_resampling.resample(rows, nothing, Fraction(1, 2), 7).collect()]
    assert sorted(r[4] for r in found if r[4]) == [1, 2] and len(found) == 5
    assert [r[3:] for r in found if r[0] is None] == [(None, None)]
    assert target_resampling.resample(rows.limit(0), nothing, Fraction(1, 2), 7).count() == 0


def test_crc_of_runs(rng=random.Random(5)):
    texts = ["", "a", " ".join("".join(rng.choices("abÉ漢0", k=rng.choice([1, 2, 7, 30, 47, 48, 49, 90]))) for _ in range(300)), "--", "End", "begin"]
    data = [t.encode() for t in texts]
    bucket, of, words = target_resampling.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
    for k, t in enumerate(texts):
        assert sorted(bucket[of == k].tolist()) == sorted(buckets_of(t)) and words[k] == len(words_of(t))


def test_cutoff_is_the_kth_key(spark, monkeypatch):
    monkeypatch.setattr(target_resampling, "BLOCK", 8)
    monkeypatch.setattr(target_resampling, "LAST", 4)
    rng = random.Random(1)
    keys = [(rng.choice([5, 6, 7, -3]), i) for i in range(150)]
    table = spark.createDataFrame(keys, "score long, id long").repartition(5)
    order = sorted(keys, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 75, 149, 150):
        assert target_resampling.cutoff(table, k) == (order[k - 1], k - 1)
    assert target_resampling.cutoff(table, 0) == (None, 0)
