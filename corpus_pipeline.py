"""A corpus pipeline of five stages over ``documents``; each stage is written and read again by the next.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents. Rows with a null id or text pass the stages as their operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm import bpe, catalog, decontaminate, jaccard_join, langid, surrogates
from boxwise.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL has no counterpart of language centroids, keyed surrogates or merges; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that no language's centroids accept go."""
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs.select(*COLUMNS), model).filter("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n-gram Jaccard join: of each component one document stays, that with the smallest id.

    Rows that share an id, or have none, are told apart by their texts: those of different components stay.
    """
    return jaccard_join.first_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a copy of a benchmark item go."""
    return decontaminate.clean(docs, catalog.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for personal data; n_chars follows the new text."""
    out = surrogates.replace(docs.select(*COLUMNS), catalog.KEY)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: number and digest of the ids, digest of the text decoded from them."""
    vocabulary = bpe.tokenizer_text(spark, catalog.vocabulary_path())
    return bpe.digests(docs, vocabulary, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", without_benchmarks), ("pii", without_pii), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written to the shared folder and read again."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/boxwise-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
