"""Operator 3: exact scores, and recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postworks.llm import ann_forest


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    return [int(i) for i in ids[np.lexsort((ids, d))][:k]], d


def test_votes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 20):
        bits = rng.integers(0, 2, (n, 8, 4)).astype(np.uint8)
        packed = [np.packbits(b, axis=0) for b in bits]
        for votes in (1, 2, 3, 4, 5, 8):
            found = np.unpackbits(ann_forest.at_least(iter(packed), votes), axis=0)
            assert (found == (bits.sum(0) >= votes)).all()


@pytest.mark.parametrize("blocks", [False, True])
def test_recall(spark, monkeypatch, blocks):
    if blocks:  # several blocks of queries, in several jobs, and a sample that is cut by its bytes
        monkeypatch.setattr(ann_forest, "QUERY_BLOCK", 4)
        monkeypatch.setattr(ann_forest, "JOB_BLOCKS", 2)
        monkeypatch.setattr(ann_forest, "VECTOR_BLOCK", 100)
        monkeypatch.setattr(ann_forest, "SAMPLE_BYTES", 8 * 32 * 900)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = ann_forest.nearest_neighbours(df, F.col("vec_id") % 100 == 0, sample=1000, trees=48).collect()
    hits = 0
    for q in range(0, 3000, 100):
        top, d = brute(x, np.arange(3000), q, 10)
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in own)
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hits += len(set(top) & {v for _, v, _ in own})
    assert hits / 300 >= 0.9


def test_ties_repeats_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (7, [1.0, 0.5]), (8, None), (9, [0.0, 0.0]), (10, [1.0, None]), (11, [float("nan"), 1.0]), (12, [float("inf"), 1.0]), (13, [1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, leaves int")
    found = [tuple(r) for r in ann_forest.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 7, 0.5), (0, 2, 3, 2**0.5), (0, 3, 5, 2**0.5)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann_forest.nearest_neighbours(df, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert ann_forest.nearest_neighbours(one, F.col("vec_id") % 100 == 0).count() == 0
    assert ann_forest.nearest_neighbours(one, F.col("vec_id") == 1).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)]
    found = ann_forest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") == 0, leaf=8).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(i, i, 0.0) for i in range(1, 11)]


def test_few_distances_are_computed():
    """Of vectors in groups, the candidates are a small part, and hold the nearest."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 24))[rng.integers(0, 50, 4000)] + 0.3 * rng.standard_normal((4000, 24))
    grown = [ann_forest.grow_tree(x[:2000], 16, (1, t)) for t in range(32)]
    forest = ann_forest.Forest(*map(list, zip(*grown, strict=True)))
    leaves = forest.leaves(x) + forest.firsts()[:-1]
    share, recall = [], []
    for q in range(0, 4000, 200):
        visited = np.isin(leaves, forest.search(x[q], 0.1 * 2000)).sum(1) >= 2
        top, _ = brute(x, np.arange(4000), q, 10)
        share.append(visited.mean())
        recall.append(np.mean(visited[top]))
    assert np.mean(recall) > 0.9 and np.mean(share) < 0.05
