"""Operator 5 against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from postworks.llm import jaccard_join
from postworks.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * common >= 75 * union:
            x, y = sorted((root(a), root(b)))
            of[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgÉé", k=4)) for _ in range(300)]
    passage = rng.choices(words, k=50)
    base = [rng.choices(words, k=rng.randint(3, 120)) for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(words, k=rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = w[:10] + passage
        text = " ".join(w)
        rows.append((i * 7 % 260, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("seed", "small", "local"), [(1, 32, 16), (2, 4, 2), (3, 2, 100)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, small, local):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "LOCAL", local)
    rows = [*corpus(seed), (1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE\ntwo"), (1005, "one"), (1006, "x " * 30000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component string").repartition(6)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df).collect()}
    assert found == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in jaccard_join.join_components(df).collect()), key=repr)
    assert found == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (None, None, None)]
    assert jaccard_join.join_components(df.limit(0)).count() == 0


def test_chains_of_links(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (110, 120), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 110: 100, 120: 100}


def test_texts_of_one_document_are_not_compared(spark, monkeypatch):
    """Ids 2d and 2d + 1 are texts of document d: what one of them links with is the other's too, and no pair of one document is made."""
    words = [[f"w{k}x{i}" for i in range(60)] for k in range(4)]
    texts = {2: words[0], 3: words[0][:-1], 4: words[0][:-2], 5: words[1], 6: words[2], 7: words[1], 8: words[3], 11: words[3][:-1] + ["z"], 10: words[2][1:]}
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    made, links = [], jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *more: made.extend(tuple(r) for r in pairs.collect()) or links(pairs, *more))
    found = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), document=lambda c: F.shiftright(c, 1))
    # 1 and 2 by the first words, 2 and 3 by the second, 3 and 5 by the third, 5 and 4 by the last.
    assert {r.doc_id: r.component_id for r in found.collect()} == dict.fromkeys(texts, 1)
    assert made and all(a >> 1 != b >> 1 for a, b in made)


def test_sets_are_moved_only_where_signatures_leave_a_link_open(spark, monkeypatch):
    import numpy as np

    words = [f"w{i}" for i in range(80)]
    texts = {1: words, 2: [*words[:78], "x", "y"], 3: [*words[:20], *[f"v{i}" for i in range(60)]], 4: [*words[:20], *[f"u{i}" for i in range(60)]]}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a long, b long")
    moved, of_ids = [], jaccard_join._of_ids
    monkeypatch.setattr(jaccard_join, "_of_ids", lambda ids, *more: moved.extend(r.id for r in ids.collect() if more[3] is jaccard_join._elements) or of_ids(ids, *more))
    frequency = spark.sparkContext.broadcast(np.zeros(jaccard_join.SLOTS, np.uint8))
    assert [tuple(r) for r in jaccard_join._links(pairs, rows, 5, frequency).collect()] == [(1, 2)]
    assert sorted(moved) == [1, 2]


def test_long_texts_that_share_few_large_columns_move_no_sets(spark, monkeypatch):
    """Of texts whose sets are too large for their signatures, any two share a third at most; all n-grams are in 17 texts, which make large columns in one task."""
    n = 17
    assert n > jaccard_join.LOCAL
    passage = [[" ".join(f"{kind}{k}x{i}" for i in range(800)) for k in range(n)] for kind in "abc"]
    texts = [(n * r + c, "\n".join((passage[0][r], passage[1][c], passage[2][(r + c) % n]))) for r in range(n) for c in range(n)]
    moved, of_ids = [], jaccard_join._of_ids
    monkeypatch.setattr(jaccard_join, "_of_ids", lambda ids, *more: moved.extend(r.id for r in ids.collect() if more[3] is jaccard_join._elements) or of_ids(ids, *more))
    found = jaccard_join.join_components(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i for i, _ in texts}
    assert moved == []


def test_pairs_of_one_document_are_not_made(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(2, " ".join(words)), (3, " ".join(words[:-1])), (8, " ".join(words[:-2])), (9, " ".join(words[1:]))]
    made, written = [], jaccard_join.written

    def spied(df, name, *more):
        if name == "product":
            made.extend(tuple(r) for r in df.where(f"kind = {jaccard_join.PAIR}").select("a", "b").collect())
        return written(df, name, *more)

    monkeypatch.setattr(jaccard_join, "written", spied)
    found = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), document=lambda c: F.shiftright(c, 1), document_of=lambda ids: ids >> 1)
    assert {r.doc_id: r.component_id for r in found.collect()} == {2: 1, 3: 1, 8: 1, 9: 1}
    assert set(made) == {(2, 8), (2, 9), (3, 8), (3, 9)}
