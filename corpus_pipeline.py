"""The corpus pipeline: raw documents to encoded training documents, in five stages.

Each stage works on what the one before it kept, as a table of documents
(doc_id, text, lang, source, n_chars), which is written and read again between
them. The last stage returns the encoded documents instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.llm import contamination, jaccard_join, language_mixture, line_dedup, queries, sentencepiece_codec
from postworks.llm.scratch import keep, passing_tables, small_batches, written
from postworks.llm.sketch import id_filter, maybe_in


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some mixture of the learned languages explains better than chance does; those without letters go.

    How many languages a document is in doesn't matter.
    """
    found = language_mixture.identify(docs, queries.language_model(docs))
    return found.where((F.col("found.lang_pred") != language_mixture.UNKNOWN) & (F.col("found.fit") > language_mixture.CHANCE)).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines, n_chars counted anew; those of which nothing is left go."""
    found = line_dedup.dedup_lines(docs, min_chars=line_dedup.SHORT_CHARS, exact_chars=1)
    changed = F.coalesce(F.size("lines.removed"), F.lit(0)) > 0
    kept = found.where(~changed | F.col("lines.text").rlike(r"\S"))
    text = {"text": F.col("lines.text"), "n_chars": F.when(changed, F.length("lines.text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[text.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def _changed(docs: DataFrame, given: DataFrame) -> DataFrame:
    """(doc_id, text) of the given documents that docs has with another text, written, as the join reads its nodes several times.

    Which differ is told by hashes alone, and no text is shuffled: those that a
    filter lets pass are read where they are, without the few that it lets pass wrongly.
    """
    hashed = lambda df: df.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    now, earlier = hashed(docs).select("doc_id", "hash").distinct(), hashed(given)
    small_batches(given.sparkSession)
    hashes = written(earlier.select("doc_id", "hash").distinct(), "hashes")
    changed = written(hashes.join(now.select("doc_id").distinct(), "doc_id", "left_semi").join(now, ["doc_id", "hash"], "left_anti").select("hash"), "changed")
    words = id_filter(changed, "hash")
    wrong = written(maybe_in(hashes.select("hash"), "hash", words).join(changed, "hash", "left_anti"), "wrong")
    return written(maybe_in(earlier, "hash", words).join(wrong, "hash", "left_anti").select("doc_id", "text"), "before")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies; of rows that repeat id and text one.

    Documents are held against each other as they are and as they were before
    lines were removed: what is left of a copy whose lines have gone resembles
    its source no more.
    """
    # Each document is one node as it is, and a second one as it was, where that differs; the join takes both for one document.
    # Nodes are twice the id (ids have 62 bits).
    before = _changed(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    nodes = docs.select(F.shiftleft("doc_id", 1).alias("doc_id"), "text").union(before.select(F.shiftleft("doc_id", 1) + 1, "text"))
    document = lambda node: F.shiftright(node, 1)
    found = jaccard_join.join_components(nodes, document=document, document_of=lambda ids: ids >> 1).select(document(F.col("doc_id")).alias("doc_id"), "component_id")
    gone = written(found.where("component_id != doc_id").select("doc_id").distinct(), "copies")
    # Only texts that a filter takes for gone ones are shuffled.
    words = id_filter(gone, "doc_id")
    doubtful = maybe_in(docs, "doc_id", words).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    kept = maybe_in(docs, "doc_id", words, wanted=False).unionByName(doubtful)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.limit(1).count():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than traces of the benchmark."""
    found = contamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~contamination.is_contaminated(F.col("found"))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, with digests of them and of what they decode to."""
    coded = sentencepiece_codec.encode_decode(docs, queries.piece_model_path())
    return sentencepiece_codec.digests(coded, "doc_id", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: Edit joins and mixtures of languages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with passing_tables(spark):
        for name, stage in STAGES[:-1]:
            with passing_tables(spark):
                docs = keep(written(stage(spark, docs, sf_dir), name))
        docs = keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
