"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Toxic documents go, one document of each group of near duplicates stays, documents that hold benchmark items go,
personal data becomes placeholders, and what is left is encoded. Every stage but the last returns the columns of
documents and drops others. Null and empty texts and null ids are never toxic, near duplicates or contaminated, so their rows
stay; equal rows and rows that share an id stay or go together; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import bpe, contamination, jaccard, privacy, toxicity
from docflow.llm.common import broadcast_if_small, checkpoint, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SMALL = 1_000_000  # ids that may be broadcast


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose id is in gone; rows without an id stay."""
    return docs.join(broadcast_if_small(checkpoint(gone.select("doc_id").distinct()), SMALL), "doc_id", "left_anti").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic; it learns from the labelled rows that aren't held out."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = toxicity.learn_folds(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each class of similar documents; rows that share an id are one document."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return _without(docs, jaccard.similar(docs).where("class_id <> doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold items of the benchmark."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return _without(docs, contamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that reveal it by placeholders; n_chars follows the text."""
    small_batches(spark)
    out = privacy.sanitise(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of each document."""
    import public_tokenizers

    small_batches(spark)
    out = bpe.with_tokens(docs.select("doc_id", "text", "lang", "source"), path or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("privacy", private), ("bpe", encoded)]
#: No stage can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
