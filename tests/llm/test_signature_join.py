"""Operator 12 against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from postworks.llm import signature_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) >= 2 else {tuple(words)} - {()}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if union and 100 * common >= 80 * union:
            x, y = sorted((root(a), root(b)))
            of[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgÉé", k=4)) for _ in range(300)]
    common = rng.choices(words, k=4)
    base = [rng.choices(words, k=rng.randint(2, 120)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base)) if rng.random() < 0.7 else rng.choices(words, k=rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.4:
            w = common + w
        text = " ".join(w)
        rows.append((i * 7 % n, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("seed", "short"), [(1, 32), (3, 1)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, short):
    monkeypatch.setattr(signature_join, "SHORT", short)
    rows = [*corpus(seed), (1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE\ntwo"), (1005, "one"), (1006, "ONE"), (1007, "x " * 30000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(6)
    found = signature_join.near_copies(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in signature_join.near_copies(df).collect()), key=repr)
    assert found == [(3, 5, 3, True), (5, 5, 3, False), (5, 5, 3, False), (None, None, None, None)]
    assert signature_join.near_copies(df.limit(0)).count() == 0
    # An id with two texts is one node, so it links the copies of both.
    df = spark.createDataFrame([(1, "a b c"), (7, "a b c"), (7, "u v w"), (4, "u v w")], "doc_id long, text string")
    assert {r.component_id for r in signature_join.near_copies(df).collect()} == {1}


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(4)
    both, own = rng.integers(0, 2**63, 8000, np.uint64), rng.integers(0, 2**63, (2, 1000), np.uint64)
    agree = []
    for k in range(40):
        x, y = (np.concatenate((both[200 * k : 200 * k + 200], o[25 * k : 25 * k + 25])) for o in own)
        rows = signature_join._least_hashes(np.concatenate((x, y)), np.array([0, len(x)]))
        agree.append((rows[0] == rows[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03 and min(agree) * signature_join.COORDINATES >= signature_join.MATCHES


def test_a_pair_leaves_the_join_where_it_first_meets(spark):
    """Not from every list that both are in, else rows are the square of a group times its lists; a pair with one late list comes too."""
    signed = spark.createDataFrame([(i, 10, bytes(4 * signature_join.COORDINATES + signature_join.PARITIES // 8)) for i in range(1, 9)], "id long, n long, signature binary")
    rows = [(v, i, i, 6) for i in range(1, 7) for v in range(100, 120)] + [(v, i, i, 2) for i in (7, 8) for v in [*range(10 * i, 10 * i + 6), 900]]
    lists = spark.createDataFrame(rows, "value long, id long, g long, size long")
    skipped = spark.createDataFrame([], "id long, skipped long")
    found = sorted(tuple(r) for r in signature_join._meetings(lists, skipped, signed).collect())
    assert found == sorted([(b, a) for a, b in combinations(range(1, 7), 2)] + [(8, 7)])
