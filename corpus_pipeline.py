"""A corpus from documents to packed sequences: language, near copies, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm import jaccard, language_id, mixing, packing, secrets
from gridpoint.llm.common import table, written

#: Share of the tokens that the mixture keeps.
KEPT = 0.9


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: without a letter, or far from every language for their length. Short clean ones stay.

    A document without a language takes the predicted one, by which the mixture then weighs it.
    """
    return language_id.intelligible(docs, fill=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near copies. Documents are told apart by key and text, as keys may repeat; null keys come last."""
    keyed = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    stay = jaccard.jaccard_components(keyed, "_row").where(F.col("_row") == F.col("component_id")).select("_row").distinct()
    return keyed.join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; widely copied examples stay."""
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked probabilities."""
    return mixing.sampled(docs, KEPT, null_keys=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", identify), ("jaccard", one_of_each), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
