"""The corpus pipeline's stages on a small table, each against what it must keep, drop and change."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postworks.llm import queries

sentencepiece = pytest.importorskip("sentencepiece")

SYLLABLES = {"en": ["tha", "ing", "ion", "ers", "wh"], "fr": ["eau", "oui", "que", "lle", "é"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(10)
    path = tmp_path_factory.mktemp("tables")
    clean = [(i, "\n".join(prose(rng, lang, 25) for _ in range(4)), lang, "s", 1) for i in range(60) for lang in [rng.choice(["en", "fr"])]]
    item = prose(rng, "en", 40)
    line = prose(rng, "en", 30)
    body = prose(rng, "en", 120)
    odd = [
        (100, "123 456 !!", "en", "s", 1),
        (101, None, "en", "s", 1),
        (102, prose(rng, "en", 30) + "\n" + item, "en", "s", 1),
        (103, clean[3][1], clean[3][2], "t", 1),
        (104, prose(rng, "fr", 30) + "\n" + line + "\n" + prose(rng, "fr", 30), None, "s", 1),
        (105, prose(rng, "en", 30) + "\n" + line + "\n" + prose(rng, "en", 30), "en", None, 1),
        (106, body, "en", "s", 1),
        (107, " ".join(body.split()[:-6] + ["tha"] * 5), "en", "s", 1),
        # A copy of many lines with one of them changed: little is left of it once its lines have gone.
        (110, "\n".join(many := [prose(rng, "en", 12) for _ in range(12)]), "en", "s", 1),
        (111, "\n".join([*many[:11], prose(rng, "en", 9)]), "en", "s", 1),
        # Three languages of which none has half, and letters that no language explains.
        (113, prose(rng, "en", 40) + " " + prose(rng, "fr", 38) + " " + prose(rng, "en", 3), None, "s", 1),
        (114, "qxzjvk wqxkz jqvxw " * 30, "fr", "s", 1),
        (None, prose(rng, "fr", 40), "fr", "s", 1),
        (115, twice := prose(rng, "fr", 45), "fr", "s", 1),
        (115, twice, "fr", "s", 1),
    ]
    rows = clean + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    return str(path), {r[0]: r[1] for r in rows}, line


def test_stages(spark, folder):
    path, texts, line = folder
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == before
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(texts) - set(kept["language"]) == {100, 101, 114}
    assert set(kept["language"]) - set(kept["lines"]) == {103}
    assert line in kept["lines"][104].text and line not in kept["lines"][105].text
    assert kept["lines"][105].n_chars == len(kept["lines"][105].text) and kept["lines"][104].n_chars == 1
    assert set(kept["lines"]) - set(kept["near_copies"]) == {107, 111} and len(kept["lines"][111].text) < 80
    assert None in kept["near_copies"]
    assert set(kept["near_copies"]) - set(kept["decontaminated"]) == {102}
    assert 113 in kept["language"]
    assert set(range(60)) <= set(kept["decontaminated"])


def test_texts_of_earlier_are_made_once(spark, folder, monkeypatch):
    """What the near-copy join reads several times is a table, not a join of texts."""
    from postworks.llm import jaccard_join

    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 100").withColumn("text", F.expr("if(doc_id % 2 = 0, text, substring_index(text, '\\n', 3))"))
    plans = []
    join = jaccard_join.join_components
    monkeypatch.setattr(jaccard_join, "join_components", lambda nodes, **how: plans.append((nodes._jdf.queryExecution().executedPlan().toString(), nodes.count())) or join(nodes, **how))
    corpus_pipeline.near_copies(spark, docs, path)
    assert plans[0][1] == 60 + 30 and "Exchange" not in plans[0][0] and "Join" not in plans[0][0]


def test_run(spark, folder):
    path, texts, _ = folder
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    assert set(found) == set(texts) - {100, 101, 102, 103, 107, 111, 114}
    for i in range(60):
        ids = library.encode(texts[i]) + [2]
        assert list(found[i].ids) == ids and found[i].n_tokens == len(ids)
        assert found[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_empty_table(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_no_two_survivors_are_near_copies(spark):
    """Of each group of the documents as they are given one survives at most."""
    from postworks.llm import jaccard_join

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    groups = {r.doc_id: r.component_id for r in jaccard_join.join_components(docs).collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    survivors = [groups[r.doc_id] for r in docs.select("doc_id").collect()]
    assert len(survivors) == len(set(survivors)) > 800


def test_changed_texts_are_exact_whatever_the_filter_lets_pass(spark, monkeypatch):
    """A filter of ones lets all pass; texts that are the same, that docs has no more, or of no id are left out all the same."""
    given = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "c"), (4, None), (5, "e"), (None, "n"), (6, ""), (2, "b c")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (4, None), (5, ""), (None, "m"), (6, "")], "doc_id long, text string")
    for words in (None, -1):
        if words:
            made = corpus_pipeline.id_filter
            monkeypatch.setattr(corpus_pipeline, "id_filter", lambda *a: made(*a) * 0 - 1)
        assert sorted(tuple(r) for r in corpus_pipeline._changed(docs, given).collect()) == [(2, "b c"), (2, "b c"), (5, "e")]
