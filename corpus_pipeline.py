"""The corpus pipeline: language ID, quality rules, near-duplicates, repeated passages, packing.

Each stage takes the documents that the stage before it kept. All but the last return the columns
of documents; a stage that cuts texts sets n_chars to the new length. Rows with null or empty
texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.llm import langid, near, packing, quality, repeats
from procurelake.llm.spark import prepared, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, by naive Bayes trained on all labelled documents."""
    prepared(spark)
    return langid.keep(docs, langid.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a language's histograms."""
    prepared(spark)
    return quality.kept(docs, quality.references(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of similarity 0.8 or more."""
    prepared(spark)
    return near.kept(docs, 80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents with smaller ids have too; what has no text left goes."""
    prepared(spark)
    return repeats.trimmed(docs).where(F.col("text") != "")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All ids of the documents in sequences."""
    import public_tokenizers

    prepared(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("quality rules", rules), ("near-duplicates", near_duplicates), ("repeated passages", passages), ("packing", packed)]
#: No SQL says what these stages return; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
