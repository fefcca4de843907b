"""Corpus pipeline: toxicity, language, near copies, packing; every stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollspan.llm import langid, near_copies, packing, toxicity
from tollspan.llm.common import free_name, remainder, table
from tollspan.session import fresh_path

def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance does not call toxic; null and empty texts stay."""
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    score = free_name(docs.columns, "_toxicity")
    return docs.withColumn(score, toxicity.toxicity(model, F.col("text"))).filter(F.col(score) < 0.5).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter, null or empty, go.

    A document goes as well where its language is less certain than that of nearly all texts the model was fitted on.
    """
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    found = free_name(docs.columns, "_language")
    sure = (F.col(f"{found}.lang") != langid.UNDETERMINED) & (F.col(f"{found}.score") >= model.least)
    return docs.withColumn(found, langid.language(model, F.col("text"))).filter(sure).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8, the smallest doc_id stays."""
    return near_copies.drop_near_copies(docs, shingle=5, similarity=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of token windows, as op8 gives them."""
    return packing.packed_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("packing", packing_stage),
]

#: The models and the packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
