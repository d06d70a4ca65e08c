"""Operator 4: held-out accuracy, and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from postworks.llm import queries, toxicity_chain


def corpus(n=1500):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 80))
        toxic = rng.random() < 0.2
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    labels = df.where("doc_id % 3 != 0").select("doc_id", "toxic")
    toxic = F.col("label") == 1
    model = toxicity_chain.fit(df.drop("toxic"), labels, {"insult": toxic & F.col("text").contains("idiot"), "toxic": toxic})
    assert len(model[1]) == 2 and len(model[1][1].earlier) == 1
    found = toxicity_chain.score(df, model).select("row.doc_id", "row.toxic", "toxicity.toxic").collect()
    held = [(r[1], r[2] >= 0.5) for r in found if r[0] % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.98


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (1, None, 0), (None, "x", 1), (3, "w " * 100000, 0)], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity_chain.fit(df, labels, {"toxic": F.col("label") == 1})
    assert toxicity_chain.score(df, model).count() == 5
    none = toxicity_chain.fit(df.limit(0), labels, {"toxic": F.col("label") == 1})
    assert [round(r.toxicity.toxic, 6) for r in toxicity_chain.score(df.limit(1), none).collect()] == [0.0]
    assert toxicity_chain.score(df.limit(0), model).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity_chain.fit(df, labels, {"low_quality": F.col("label_quality") == 0, "toxic": F.col("label") == 1}, severe_of="toxic")
    found = toxicity_chain.score(df, model).select("toxicity.*").first()
    assert found.asDict() == {"low_quality": found.low_quality, "toxic": found.toxic, "severe_toxic": found.severe_toxic} and max(found) < 1e-9


def test_registered_query_chains_its_categories(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i, (_, text, _) in enumerate(corpus()):
        clean = [w for w in text.split(" ") if w not in ("idiot", "scum")]
        toxic, low = rng.random() < 0.25, rng.random() < 0.2
        bad = rng.choices(["idiot", "scum"], k=rng.choice([1, 20])) if toxic else []
        rows.append((i, " ".join([*clean, *bad, *(["lorem"] if low else [])]), int(toxic), int(not low), len(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int, bad int")
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    df.where("doc_id % 3 > 0").select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    names, chain = queries.toxicity_model(spark, str(tmp_path))
    assert names == ["low_quality", "toxic", "severe_toxic"]
    assert all(len(m.buckets) for m in chain)
    assert len(chain[2].earlier) == 2 and chain[2].earlier.any()
    found = {r.doc_id: r for r in queries.op4_toxicity_chain(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum((found[i].p_low_quality >= 0.5) == (q == 0) for i, _, _, q, _ in held) / len(held) > 0.98
    assert sum(found[i].toxic == (t == 1) for i, _, t, _, _ in held) / len(held) > 0.98
    assert sum((found[i].p_severe_toxic >= 0.5) == (b == 20) for i, _, _, _, b in held) / len(held) > 0.9


def test_against_plain_loops(spark):
    """The chain with its folds, computed from a matrix of words that is made by counting."""
    rng = random.Random(6)
    words = ["w" + "".join(rng.choices("abcdefgh", k=2)) for _ in range(25)]
    rows = []
    for i in range(400):
        first, second = rng.random() < 0.3, rng.random() < 0.3
        text = rng.choices(words, k=rng.randint(3, 15)) + (["xone"] if first and rng.random() < 0.9 else []) + (["ytwo"] if second and rng.random() < 0.8 else [])
        rows.append((i, " ".join(text), int(second), int(first)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, other int")
    folds = {r.doc_id: r.fold for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(toxicity_chain.FOLDS)).alias("fold")).collect()}
    labels = df.select("doc_id", "toxic", "other")
    model = toxicity_chain.fit(df.select("doc_id", "text"), labels, {"other": F.col("label_other") == 1, "toxic": F.col("label") == 1})
    found = {r[0]: (r[1], r[2]) for r in toxicity_chain.score(df, model).select("row.doc_id", "toxicity.other", "toxicity.toxic").collect()}

    # All words have four bytes at most, so each is its own beginning in all three sizes: four equal columns each.
    counted = [{w: t.split(" ").count(w) for w in set(t.split(" "))} for _, t, _, _ in rows]
    totals = [len(t.split(" ")) for _, t, _, _ in rows]

    def train(at, y, earlier):
        n, positive = len(at), sum(y[i] for i in at)
        chosen = []
        for w in sorted({w for i in at for w in counted[i]}):
            seen = sum(w in counted[i] for i in at)
            hit = sum(w in counted[i] and y[i] for i in at)
            expected = seen * positive / n
            if seen >= 3 and (hit - expected) ** 2 / (expected * (1 - positive / n)) > toxicity_chain.telling_bound(n):
                chosen.append(w)

        def matrix(which):
            out = []
            for i in which:
                k = [counted[i].get(w, 0) for w in chosen]
                out.append([np.log1p(x) for x in k for _ in range(4)] + [np.log1p(100 * x / totals[i]) for x in k for _ in range(4)] + [e[i] for e in earlier] + [1.0])
            return np.array(out)

        x, target = matrix(at), np.array([y[i] for i in at], float)
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), 0.1)
        ridge[-1] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w -= 0.5 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (p - target) + ridge * w)
        return lambda which, e=None: 1 / (1 + np.exp(-matrix(which) @ w))

    everything, earlier, expected = list(range(len(rows))), [], []
    logit = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    for column in (3, 2):
        y = [r[column] for r in rows]
        out = np.zeros(len(rows))
        for f in range(toxicity_chain.FOLDS):
            inside, outside = [i for i in everything if folds[i] != f], [i for i in everything if folds[i] == f]
            out[outside] = train(inside, y, earlier)(outside)
        whole = train(everything, y, earlier)
        if column == 2:
            earlier[0] = logit(expected[0])  # at prediction the earlier model is the whole one
        expected.append(whole(everything))
        earlier.append(logit(out))
    for i in everything:
        assert abs(found[i][0] - expected[0][i]) < 1e-3 and abs(found[i][1] - expected[1][i]) < 1e-3
