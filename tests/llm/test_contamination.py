"""Operator 9 against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from postworks.llm import contamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORDS.findall((t or "").translate(LOWER))


def brute(docs, items, size=13):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(size, len(w))
        if i is not None and k:
            for j in range(len(w) - k + 1):
                windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = {}
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    found |= own
                    hit[j : j + k] = [True] * k
        spans, j = [], 0
        while j < len(w):
            if hit[j]:
                stop = j
                while stop < len(w) and hit[stop]:
                    stop += 1
                spans.append((j, stop))
                j = stop
            else:
                j += 1
        out[(i, t)] = (len(w), sum(hit), sorted(found), spans)
    return out


def rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["é", "ÀB", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(25)]
    items += [(3, items[4][1]), (None, "w1"), (40, None), (41, " - ")]
    docs = []
    for i in range(80):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            w[rng.randint(0, len(w)) : 0] = words(rng.choice(items)[1])[rng.randint(0, 3) :]
        docs.append((i, ", ".join(w).upper() if rng.random() < 0.2 else "; ".join(w)))
    docs += [(100, None), (101, ""), (102, "..."), docs[0], (None, docs[1][1]), (103, "w1 " * 30000)]
    return docs, items


def test_operator(spark, monkeypatch):
    for seed, block in ((1, 32 << 20), (2, 300)):
        monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
        docs, items = rows(seed)
        expected = brute(docs, items)
        df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, found string").repartition(4)
        found = contamination.find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert len(found) == len(docs)
        for r in found:
            got = (r.found.n_words, r.found.n_hit, sorted(set(r.found["items"])), [tuple(s) for s in r.found.spans])
            assert got == expected[(r.row.doc_id, r.row.text)]
            assert len(r.found["items"]) == len(set(r.found["items"]))
            starts = [m.doc_start for m in r.found.matches]
            assert starts == sorted(starts) and bool(starts) == (r.found.n_hit > 0)


def test_suffix_array_is_sorted():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 40))) for _ in range(30)]
    data = "".join(texts).encode()
    words_, counts = contamination.split_words(np.frombuffer(data, np.uint8), np.cumsum([len(t) for t in texts]), contamination.ALNUM)
    shard = contamination.Shard(words_, counts, 13)
    assert sorted(shard.array.tolist()) == list(range(len(shard.codes)))
    suffixes = [shard.codes[i : i + 13].tolist() for i in shard.array]
    assert suffixes == sorted(suffixes)


def test_longest_matches(spark):
    item = " ".join(f"t{i}" for i in range(40))
    doc = "a b " + " ".join(f"t{i}" for i in range(5, 30)) + " c"
    found = contamination.find_contamination(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first().found
    assert [tuple(m) for m in found.matches] == [("7", 5, 2, 25)] and [tuple(s) for s in found.spans] == [(2, 27)]


def test_verdict_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y z " + "a " * 57), (2, "x y z " + "a " * 58), (3, "a")], "doc_id long, text string")
    judged = contamination.find_contamination(docs, items).select("row.doc_id", contamination.is_contaminated(F.col("found")).alias("bad")).collect()
    assert {r.doc_id: r.bad for r in judged} == {1: True, 2: False, 3: False}
    assert contamination.find_contamination(docs.limit(0), items).count() == 0
    assert {r.found.n_hit for r in contamination.find_contamination(docs, items.limit(0)).collect()} == {0}
