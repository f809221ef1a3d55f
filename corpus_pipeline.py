"""The corpus pipeline: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the
columns of ``documents``, and further columns that the input has, whatever their names. Null texts are rejected by the
language stage; an empty table passes through as one. Rows are told apart by their places, not their ids: of rows alike,
whatever their ids, one stays, while texts of fewer words than one stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapoint.llm import disclosure, gru_language, minhash, packing, subword_classifier
from contrapoint.llm.common import drop_staged, held_out, staged, staged_so_far
from contrapoint.llm.queries import WORD_BPE

#: A document leaves if no language reaches this mean probability, or if its chance of good quality is less.
LEAST_LANGUAGE, LEAST_QUALITY = 0.35, 0.5
#: Words that a worker remembers while it tokenises, beside what the stages before hold.
KEPT_WORDS = 250_000
#: Near-duplicates share this part of their five-word shingles.
SHINGLE, SIMILARITY = 5, 0.8


def _beside(docs: DataFrame) -> DataFrame:
    """The text and the whole row, so that an operator's columns can't clash with the row's."""
    return docs.select("text", F.struct(*docs.columns).alias("doc"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; those without text or letters go."""
    model = gru_language.fit(docs, lambda i: ~held_out(i, 4, 2))
    rows = gru_language.predict(_beside(docs), model)
    return rows.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier, fitted on the labelled rows, takes for good ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = subword_classifier.fit(docs, labels, "quality", lambda i: ~held_out(i, 4, 2))
    return subword_classifier.score(_beside(docs), model).where(F.col("score") >= LEAST_QUALITY).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of the least id; a null id comes last.

    Rows are told apart by their own numbers, as ids may repeat or be missing.
    """
    rows = staged(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("doc")), "numbered")
    found = minhash.near_duplicates(rows.select(F.col("number").alias("doc_id"), "doc.text"), SHINGLE, SIMILARITY)
    ids = rows.select("number", F.col("doc.doc_id").alias("id"))
    members = staged(found.select(F.col("doc_id").alias("number"), "component_id").join(ids, "number"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "number"
    )).alias("first")).select("first.number")
    gone = staged(members.join(first, "number", "left_anti").select("number"), "copies")
    return rows.join(gone, "number", "left_anti").select("doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, by their kind."""
    return disclosure.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 4096."""
    return packing.pack_documents(docs, WORD_BPE, capacity=4096, kept_words=KEPT_WORDS)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The trained stages can't be written in SQL; tests recompute all rows plainly from the models that the stages fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and what led to it is deleted."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
            drop_staged(spark, since, but=1)
    return docs
