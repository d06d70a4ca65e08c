"""Operator 8: held-out accuracy, mixtures, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from postworks.llm import language_mixture as lm

SYLLABLES = {"aa": ["tha", "ing", "ion", "ers", "wh"], "bb": ["eau", "oui", "que", "lle", "é"], "cc": ["sch", "ung", "ö", "ber", "ich"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_held_out_and_mixtures(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, lang, rng.randint(5, 60)), lang) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = lm.fit(df.where(~lm.is_held_out(F.col("doc_id"))), F.col("text"), F.col("lang"))
    assert model[0] == ["aa", "bb", "cc"] and np.allclose(np.exp(model[1]).sum(1), 1)
    found = lm.identify(df, model).where(lm.is_held_out(F.col("row.doc_id"))).select("row.lang", "found.*").collect()
    assert len(found) > 100 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.98
    mixed = [(1, text(rng, "aa", 200) + " " + text(rng, "bb", 100)), (2, text(rng, "cc", 100)), (3, text(rng, "aa", 100) + text(rng, "bb", 90) + text(rng, "cc", 80))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lm.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).select("row.doc_id", "found.*").collect()}
    assert got[1][0] == "aa" and 0.5 < got[1][1] < 0.8
    assert got[2] == ("cc", 1.0)
    assert got[3][0] == "aa" and 0.3 < got[3][1] < 0.5
    sets = {r.doc_id: r for r in lm.identify(spark.createDataFrame([*mixed, (4, "qxzj vwqx kzqj " * 20)], "doc_id long, text string"), model).select("row.doc_id", "found.*").collect()}
    assert [x.lang for x in sets[3].languages] == ["aa", "bb", "cc"] and abs(sum(x.share for x in sets[3].languages) - 1) < 1e-6
    assert [x.lang for x in sets[2].languages] == ["cc"] and sets[2].languages[0].share == 1
    assert min(sets[i].fit for i in (1, 2, 3)) > lm.CHANCE > sets[4].fit


def brute(text, log_p):
    """EM in plain loops, over all sets of languages that the rule looks at."""
    codes = [c.lower() if c.isalpha() else " " for c in text]
    data = text.encode()
    buckets, _ = lm.trigrams(np.frombuffer(data, np.uint8), np.array([len(data)]))
    assert len(buckets) == sum(c != " " for c in codes)
    p = np.exp(log_p)[:, buckets]

    def em(langs):
        w = {i: 1 / len(langs) for i in langs}
        for _ in range(5000):
            new = dict.fromkeys(langs, 0.0)
            for b in range(len(buckets)):
                mixed = sum(w[i] * p[i, b] for i in langs)
                for i in langs:
                    new[i] += w[i] * p[i, b] / mixed / len(buckets)
            change = max(abs(new[i] - w[i]) for i in langs)
            w = new
            if change < 1e-9:
                break
        return w, sum(np.log(sum(w[i] * p[i, b] for i in langs)) for b in range(len(buckets)))

    everything, _ = em(range(len(p)))
    order = sorted(everything, key=lambda i: -everything[i])
    best, likely = {int(np.log(p).sum(1).argmax()): 1.0}, np.log(p).sum(1).max()
    for k in range(2, len(p) + 1):
        w, gained = em(order[:k])
        if gained - likely <= lm.PENALTY * np.log2(len(buckets) + 1):
            break
        best, likely = w, gained
    return best, likely / len(buckets)


def test_against_plain_loops():
    rng = random.Random(11)
    names = ["aa", "bb", "cc", "dd"]
    syllables = {**SYLLABLES, "dd": ["tha", "que", "ung", "zo"]}
    counts = np.full((4, lm.BUCKETS), 0.05)
    for i, name in enumerate(names):
        data = " ".join("".join(rng.choices(syllables[name], k=rng.randint(1, 4))) for _ in range(400)).encode()
        np.add.at(counts[i], lm.trigrams(np.frombuffer(data, np.uint8), np.array([len(data)]))[0], 1)
    log_p = np.log(counts / counts.sum(1, keepdims=True))
    texts = []
    for _ in range(12):
        chosen = rng.sample(names, rng.choice([1, 2, 2, 3]))
        texts.append(" ".join("".join(rng.choices(syllables[x], k=rng.randint(1, 4))) for x in chosen for _ in range(rng.randint(5, 40))))
    data = [t.encode() for t in texts]
    langs, shares, fits = lm.infer(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), log_p)
    assert (langs >= 0).sum(1).max() > 1
    for text, own, share, fit in zip(texts, langs, shares, fits, strict=True):
        expected, likely = brute(text, log_p)
        assert set(own[own >= 0]) == set(expected)
        assert all(abs(expected[i] - s) < 0.01 for i, s in zip(own, share, strict=True) if i >= 0)
        assert abs(likely - fit) < 1e-3


def test_many_languages_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(12)
    log_p = np.log(rng.dirichlet(np.full(lm.BUCKETS, 0.1), 150) + 1e-9)
    data = b" ".join(bytes(x) for x in rng.integers(97, 123, (40_000, 5), dtype=np.uint8))
    ends = np.linspace(0, len(data), 101).astype(np.int64)[1:]
    tracemalloc.start()
    lm.infer(np.frombuffer(data, np.uint8), ends, log_p)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_odd_rows(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, text(rng, "aa", 20), "aa") for i in range(20)] + [(21, None, "bb"), (22, "bb", None)], "doc_id long, text string, lang string")
    model = lm.fit(docs, F.col("text"), F.col("lang"))
    assert model[0] == ["aa"]
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !?", 1), (4, "tha", 1), (4, "tha", 1), (None, "Ⅷ ß" * 50000, 1)], "doc_id long, text string, found int")
    found = sorted((tuple(r) for r in lm.identify(odd, model).select("row.doc_id", "found.lang_pred", "found.score").collect()), key=repr)
    assert found == sorted([(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "aa", 1.0), (4, "aa", 1.0), (None, "aa", 1.0)], key=repr)
    none = lm.fit(docs.limit(0), F.col("text"), F.col("lang"))
    assert {r.found.lang_pred for r in lm.identify(odd, none).collect()} == {"und"}
    assert lm.identify(odd.limit(0), model).count() == 0


def test_held_out_rows(spark):
    import zlib

    df = spark.range(50).select(F.col("id").alias("doc_id"), lm.is_held_out(F.col("id")).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())
